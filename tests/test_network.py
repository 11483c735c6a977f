"""The sequence network: gradients against finite differences, training over partitions, files."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kinfold.functions.model import ALPHABET
from kinfold.functions.residues import padded, tokens
from kinfold.operators import classify
from kinfold.operators import network as N

TINY = N.Shape(16, 3, (4, 5), 3, 4, (6,), 4)


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 22, (5, 16)), rng.integers(0, 4, 5)
    w = {k: v + rng.normal(0, 0.1, v.shape) for k, v in N.first_weights(TINY).items()}
    loss, grads = N.gradient(x, y, w, TINY)
    assert set(grads) == set(w) and np.isclose(loss, N.focal(N.shares(x, w, TINY), y)[0].sum())
    for name, v in w.items():
        assert grads[name].shape == v.shape
        for at in rng.choice(v.size, min(6, v.size), replace=False):
            found = []
            for step in (1e-5, -1e-5):
                moved = v.copy()
                moved.ravel()[at] += step
                found.append(N.gradient(x, y, {**w, name: moved}, TINY)[0])
            assert np.isclose((found[0] - found[1]) / 2e-5, grads[name].ravel()[at], rtol=1e-4, atol=1e-6), name


def made(n, seed=4):
    """Pairs whose class is told by a word that stands somewhere in the first sequence."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        cls = k % 4
        a = rng.choices(ALPHABET, k=rng.randrange(8, 14))
        at = rng.randrange(len(a) - 3)
        a[at : at + 3] = ["WWW", "CCC", "HHH", "PPP"][cls]
        rows.append(("".join(a), "".join(rng.choices(ALPHABET, k=10)), cls))
    return rows


def test_sums_do_not_depend_on_partitions(spark):
    rows = [(*r, k % 5 == 0) for k, r in enumerate(made(50))]
    table = spark.createDataFrame(rows, "res_a string, res_b string, cls int, held boolean")
    w = N.first_weights(TINY)
    total, seen = N.epoch_sums(table.repartition(5), w, TINY)
    again, same = N.epoch_sums(table.coalesce(1), w, TINY)
    assert np.allclose(total, again) and np.allclose(seen, same) and seen[1] == 40 and seen[3] == 10
    x, y = (np.stack([N.tokens_of(a, b, 16) for a, b, _, held in rows if not held]), np.array([c for *_, c, held in rows if not held]))
    loss, grads = N.gradient(x, y, w, TINY)
    assert np.allclose(total, N._flat(grads)) and np.isclose(loss, seen[0])
    known = table.select("res_a", "res_b", padded(tokens(F.concat_ws("-", "res_a", "res_b")), 16).alias("x")).collect()
    assert all(N.tokens_of(r["res_a"], r["res_b"], 16).tolist() == r["x"] for r in known)


def test_training_beats_letter_shares_where_order_counts(spark, tmp_path):
    shape = N.Shape(32, 6, (12, 12), 8, 8, (16,), 4)
    rows = made(260)
    pairs = spark.createDataFrame([*rows, *rows[:20], (None, "A", 1), ("A", "A", 9)], "res_a string, res_b string, cls int").repartition(4)
    network = N.train(pairs, shape, epochs=30, rate=0.03)
    losses = [h[1] for h in network.history]
    assert losses[-1] < 0.6 * losses[0]
    fresh = pd.DataFrame(made(120, 9), columns=["res_a", "res_b", "cls"])
    right = (network(fresh) == fresh["cls"]).mean()
    assert right > 0.6
    N.save(spark, network, str(tmp_path / "n"))
    again = N.load(spark, str(tmp_path / "n"))
    assert again.shape == shape and (again(fresh) == network(fresh)).all()
    sequences = spark.createDataFrame([("f", k, r[0]) for k, r in enumerate(rows[:4])], "family string, label int, residues string")
    assert classify.strategies(sequences, network).count() == 1


def test_early_stop_and_empty_tables(spark):
    noise = spark.createDataFrame([(a, b, int(k % 2)) for k, (a, b, _) in enumerate(made(30))], "res_a string, res_b string, cls int")
    stopped = N.train(noise, TINY, epochs=40, rate=0.3, patience=2)
    assert len(stopped.history) < 40
    best = min(range(len(stopped.history)), key=lambda k: stopped.history[k][1])
    assert len(stopped.history) - 1 - best == 3
    none = N.train(noise.filter("false"), TINY, epochs=3)
    assert not none.history and len(none(pd.DataFrame({"res_a": ["A"], "res_b": ["C"]}))) == 1
    assert len(none(pd.DataFrame({"res_a": [], "res_b": []}))) == 0
