"""The pipeline's near copies against brute force over five-word shingles."""

import random

import numpy as np
from test_simhash import roots

import corpus_pipeline
from kinfold.llm import near_copies


def slow_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_alike(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def expected(rows):
    sets = {i: slow_shingles(t) for i, t in rows}
    nodes = sorted(sets)
    root = roots(nodes, [(a, b) for k, a in enumerate(nodes) for b in nodes[k + 1 :] if slow_alike(sets[a], sets[b])])
    return set(root.values())


def made(rng):
    """Texts with copies of every similarity, chains of copies, a common passage, and short texts."""
    vocabulary = ["".join(rng.choices("abcdefghé", k=5)) for _ in range(400)]
    common = rng.choices(vocabulary, k=40)
    texts = [None, "", " \n", "one", "One", "one two", "a b c d e", "A b  c d e", "a b c d e f", "x" * 3000, "x" * 2999 + "y"]
    for k in range(60):
        words = rng.choices(vocabulary, k=rng.choice([3, 8, 30, 120, 300]))
        if k % 3 == 0:
            words[2:2] = common
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            for _ in range(rng.choice([1, 1, 2, 4, 7])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n"]).join(words))
    order = rng.sample(range(len(texts)), len(texts))
    return list(zip(order, texts, strict=True))


def test_stage_drops_all_near_copies_and_nothing_else(spark):
    rows = made(random.Random(11))
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(expected(rows))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    kept = {r["doc_id"] for r in near_copies.keep_one(docs).select("doc_id").collect()}
    assert kept == expected(rows) and len(rows) - len(kept) > 70


def test_leading_shingles_meet_whatever_the_common_ones():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = rng.choice(2**40, rng.integers(1, 40), replace=False).astype(np.uint64)
        y = np.concatenate([x[: rng.integers(0, len(x) + 1)], rng.choice(2**40, rng.integers(0, 6)).astype(np.uint64) + np.uint64(2**41)])
        x, y = np.unique(x), np.unique(y)
        crowded = rng.integers(0, 256, 1 << rng.integers(3, 8)).astype(np.uint8)
        a, b = (near_copies.leading(s, crowded) for s in (x, y))
        good = slow_alike(set(x.tolist()), set(y.tolist()))
        assert near_copies.alike(x, y) == good
        assert not good or set(a.tolist()) & set(b.tolist())
        assert not good or near_copies.may_be_alike(near_copies.parities(x), near_copies.parities(y), len(x) + len(y))


def test_crowded_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CROWD", 3)
    rows = [(f"{'same words lead all of these texts' if i < 9 else ''} and {i} goes on its own way {i}",) for i in range(20)]
    texts = [near_copies.shingles(t) for (t,) in rows]
    bits = near_copies.crowded_shingles(spark.createDataFrame([*rows, (None,), ("",)], "text string"))
    marked = lambda h: bool(bits[(h & (near_copies.BITMAP_BITS - 1)) >> 3] >> (h & 7) & 1)
    leads = [set(x[: int(near_copies.WIDER * near_copies.lead_size(len(x)))].tolist()) for x in texts]
    for h in set().union(*leads):
        assert marked(h) == (sum(h in x for x in leads) > 3)


def test_shingles_do_not_depend_on_chunks(monkeypatch):
    text = "some wörds AND\x0b " * 300 + "x" * 5000
    whole = near_copies.shingles(text)
    monkeypatch.setattr(near_copies, "CHUNK_BYTES", 64)
    assert (near_copies.shingles(text) == whole).all() and len(whole) == len(slow_shingles(text))


def test_odd_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "A b c"), (None, "a b c"), (None, "d"), (None, "e"), (3, "f"), (3, "g"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in near_copies.keep_one(docs).collect()))) == sorted(map(str, [(1, "a b c"), (None, "d"), (None, "e"), (3, "f"), (3, "g"), (4, None)]))
    assert near_copies.keep_one(docs.limit(0)).count() == 0
