"""Expectation maximisation: counts against those of single pairs, rising likelihood, restart."""

import itertools
import random

import numpy as np
import pytest

from kinfold.functions.model import ALPHABET, PairModel, ScoreMatrix
from kinfold.operators import align as A
from kinfold.operators import hmm, lattice
from kinfold.operators.pairs import all_pairs

MODEL = PairModel()


def made(seed, sizes=(4, 3, 2, 1)):
    rng, rows = random.Random(seed), []
    for f, n in enumerate(sizes):
        base = rng.choices(ALPHABET, k=30)
        rows += [(f"f{f}", k, "".join(rng.choice(ALPHABET) if rng.random() < 0.3 else c for c in base if rng.random() < 0.9)) for k in range(n)]
    return [*rows, ("f0", 9, ""), ("f1", 9, "XAX")]


def key_value(kernel, c, q, key):
    names = [*kernel.letters, "?"]
    at = lambda x: names.index(x) if x in names else len(names) - 1
    kind, *rest = key.split(":")
    if kind == "init":
        return c.init[q, int(rest[0])]
    if kind == "move":
        return c.moves[q, int(rest[0]), int(rest[1])]
    if kind == "single":
        return c.single[q, at(rest[0])]
    x, y = map(at, rest[0])
    return c.match[q, x, y] + (c.match[q, y, x] if x != y else 0)


@pytest.mark.parametrize("block", [16 << 20, 1])
def test_counts_of_batches_equal_those_of_pairs(block, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK_BYTES", block)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choices(ALPHABET + "X", k=n))
    pairs = [(word(rng.randrange(1, 45)), word(rng.randrange(1, 45))) for _ in range(12)] + [("A", "A"), ("AC", "W"), ("", "A"), (word(3), word(70)), (word(70), word(2))]
    kernel, seen = lattice.Kernel(MODEL, ScoreMatrix.by_groups()), set()
    for numbers, c in kernel.counts(pairs):
        for q, k in enumerate(numbers):
            seen.add(k)
            a, b = pairs[k]
            for key, value in hmm.expected_counts(a, b, MODEL).items():
                assert np.isclose(key_value(kernel, c, q, key), value, atol=1e-9), key
            assert np.isclose(c.logs[q], hmm.total(a, b, MODEL, hmm.forward(a, b, MODEL), hmm.backward(a, b, MODEL)))
    assert seen == {k for k, (a, b) in enumerate(pairs) if a and b}


def test_sums_of_a_step(spark):
    rows = made(3)
    table = spark.createDataFrame(rows, "family string, label int, residues string")
    vector, log = A.step_sums(all_pairs(table).filter("len_a > 0 AND len_b > 0"), MODEL)
    kernel, by_family = lattice.Kernel(MODEL, ScoreMatrix.by_groups()), {}
    for (f, _, a), (g, _, b) in itertools.combinations(rows, 2):
        if f == g and a and b:
            by_family.setdefault(f, []).append((a, b))
    means = [np.mean([np.append(c.vectors()[q], c.logs[q]) for numbers, c in kernel.counts(p) for q in range(len(numbers))], axis=0) for p in by_family.values()]
    want = np.mean(means, axis=0)
    assert np.allclose(vector, want[:-1]) and np.isclose(log, want[-1])


def test_likelihood_never_falls(spark, tmp_path):
    table = spark.createDataFrame(made(4), "family string, label int, residues string")
    done = A.train(table, steps=6)
    assert len(done.logs) == 6 and (np.diff(done.logs) > -1e-9).all() and done.logs[-1] > done.logs[0]
    folder = str(tmp_path)
    A.train(table, steps=2, folder=folder)
    on = A.train(table, steps=6, folder=folder)
    assert len(on.logs) == 4 and np.allclose(on.logs, done.logs[2:], atol=1e-4)
    assert np.allclose(on.model.gap_open, done.model.gap_open, atol=1e-6)
    early = A.train(table, steps=50, tolerance=1.0)
    assert len(early.logs) < 50
    assert A.train(table.filter("family = 'f3'"), steps=3).model == MODEL
