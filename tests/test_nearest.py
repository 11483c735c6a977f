"""The nearest pair of vectors against all pairs."""

import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from kinfold.operators import nearest
from kinfold.operators.nearest import ODD, Tile, compare, rounded_root

SCHEMA = "vec_id long, embedding array<float>, label int"


def all_pairs(ids, vectors):
    """d, a, b of the nearest pair, each distance summed from left to right."""
    best = (np.inf, 0, 0)
    for i in range(len(ids) - 1):
        s = np.zeros(len(ids) - i - 1)
        for k in range(vectors.shape[1]):
            s += (vectors[i + 1 :, k] - vectors[i, k]) ** 2
        d = np.where(ids[i + 1 :] == ids[i], np.inf, rounded_root(s))
        for k in np.flatnonzero(d <= best[0]) if d.min() <= best[0] else ():
            best = min(best, (float(d[k]), min(int(ids[i]), int(ids[i + 1 + k])), max(int(ids[i]), int(ids[i + 1 + k]))))
    return best


def least(*found):
    """d, a, b of the least of some results of compare."""
    return min(x.key for x in found if x.key is not None)[2:]


@pytest.mark.parametrize("shape", ["apart", "grid", "far off", "repeated ids"])
def test_tiles_against_all_pairs(shape):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 64))
    if shape == "grid":
        vectors = rng.integers(0, 2, (700, 64)).astype(float)
    if shape == "far off":
        vectors = 1e7 + vectors.astype(np.float32).astype(float)
    ids = rng.permutation(700) if shape != "repeated ids" else rng.integers(0, 9, 700)
    d, a, b = all_pairs(ids, vectors)

    def tile(rows):
        along = nearest._projected(vectors[rows], 1)
        order = np.argsort(along)
        return Tile(64, vectors[rows][order], None, ids[rows][order], ids[rows][order], along[order])

    x, y = tile(np.arange(300)), tile(np.arange(300, 700))
    for limit in (np.inf, d):
        assert least(compare(x, x, limit), compare(y, y, limit), compare(x, y, limit)) == (d, a, b)


def test_odd_tile_is_compared_as_plain():
    rng = np.random.default_rng(5)
    vectors, ids = rng.normal(size=(90, 64)), rng.permutation(90)
    odd = Tile(ODD, vectors[:40], np.ones((40, 64), bool), ids[:40], ids[:40], np.zeros(40))
    plain = Tile(64, vectors[40:], None, ids[40:], ids[40:], nearest._projected(vectors[40:], 1))
    assert least(compare(odd, odd), compare(odd, plain), compare(plain, plain)) == all_pairs(ids, vectors)


@pytest.fixture
def sixteen_ranges(spark):
    names = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_many_tiles(spark, tmp_path, sixteen_ranges):
    """Copies with small changes, so that most tiles are too far apart to be compared."""
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(2000, 64)).astype(np.float32)
    vectors[1500:1700] = vectors[:200] + rng.normal(scale=1e-2, size=(200, 64)).astype(np.float32)
    labels = (np.arange(2000) % 3 == 0).astype(int)
    spark.createDataFrame(list(zip(range(2000), vectors.tolist(), labels.tolist(), strict=True)), SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.family: (r.d, r.a, r.b) for r in entry.queries()["nearest_pair"](spark, str(tmp_path)).collect()}
    for label in (0, 1):
        rows = np.flatnonzero(labels == label)
        assert got[str(label)] == all_pairs(rows, vectors[rows].astype(float))


def test_work_of_a_large_label(spark, tmp_path):
    """200 million pairs of one label."""
    vectors = np.random.default_rng(13).normal(size=(20000, 64)).astype(np.float32)
    vectors[19000] = vectors[700]
    vectors[19000, 5] += 0.5
    table = {"vec_id": np.arange(20000), "embedding": list(vectors), "label": np.zeros(20000, np.int32)}
    pq.write_table(pa.table(table), f"{tmp_path}/embeddings.parquet")
    began = time.time()
    (row,) = entry.queries()["nearest_pair"](spark, str(tmp_path)).collect()
    assert time.time() - began < 60
    assert (row.d, row.a, row.b) == (0.5, 700, 19000)
