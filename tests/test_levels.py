"""Merges and refinement spread over tasks against those of one task."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions.model import ALPHABET, PairModel, ScoreMatrix
from kinfold.operators import align as A
from kinfold.operators import levels, progressive, trace, tree
from kinfold.operators.lattice import Kernel


def family(seed, n, length):
    rng = random.Random(seed)
    base = "".join(rng.choices(ALPHABET, k=length))
    return ["".join(c if rng.random() < 0.75 else rng.choice(ALPHABET) for c in base if rng.random() < 0.9) for _ in range(n)]


def alone(residues, s1, rounds, keep_order=True):
    """The alignment of one family in one task, and its cells and distances."""
    keys, cells = list(itertools.combinations(range(len(residues)), 2)), {}
    d = np.zeros((len(residues), len(residues)))
    for k, p in Kernel(PairModel(), ScoreMatrix.by_groups())([(residues[a], residues[b]) for a, b in keys], s1):
        (a, b), (x, y) = keys[k], np.nonzero(p >= 0.01)
        cells[a, b] = x + 1, y + 1, p[x, y]
        d[a, b] = d[b, a] = trace.distance(trace.best_trace(p)[1], *p.shape)
    nodes = tree.build_tree(d)
    rows = progressive.progressive(residues, tree.merge_order(nodes), cells, tree.weights(nodes, len(residues)))
    rows = dict(sorted(rows.items())) if keep_order else rows
    now, draw, known = progressive.Rows.of(rows), progressive.glibc_rand(), progressive.Cells(cells)
    for _ in range(rounds):
        now, _ = progressive.realign(now, np.array([next(draw) % 2 == 1 for _ in residues]), known)
    return now.texts(), cells, d, nodes


def tables(spark, families):
    sequences, cells, distances = [], [], []
    for name, (residues, found, d) in families.items():
        sequences += [(name, k, f"h{k}", r) for k, r in enumerate(residues)]
        cells += [(name, a, b, int(i), int(j), float(p)) for (a, b), c in found.items() for i, j, p in zip(*c, strict=True)]
        distances += [(name, a, b, float(d[a, b])) for a, b in itertools.combinations(range(len(residues)), 2)]
    return spark.createDataFrame(sequences, "family string, label int, header string, residues string"), spark.createDataFrame(cells, "family string, a int, b int, i int, j int, p double"), spark.createDataFrame(distances, "family string, a int, b int, d double")


@pytest.mark.parametrize("most,keep_order", [(3, True), (6, False)])
def test_levels_equal_one_task(spark, most, keep_order):
    given = {"x": family(1, 14, 40), "y": family(2, 3, 30), "z": family(3, 8, 25), "one": ["ACD"]}
    found = {f: alone(r, 0, progressive.FEW_ROUNDS if len(r) > most else 0, keep_order) for f, r in given.items()}
    sequences, cells, distances = tables(spark, {f: (r, *found[f][1:3]) for f, r in given.items()})
    trees = A.trees(distances, sequences)
    assert levels.merges_above(trees, most).agg(F.max("level")).first()[0] > 1
    got = A.merge_families(sequences, cells, trees, 0, keep_order, most=most).collect()
    whole = A.merge_families(sequences, cells, trees, 0, keep_order).collect()
    for f, residues in given.items():
        mine = sorted((r for r in got if r["family"] == f), key=lambda r: r["row"])
        assert {r["label"]: r["residues"].replace("-", "") for r in mine} == dict(enumerate(residues))
        assert len({len(r["residues"]) for r in mine}) == 1 and [r["row"] for r in mine] == list(range(len(residues)))
        assert all(r["header"] == f"h{r['label']}" for r in mine)
        if len(residues) > most:
            assert {r["label"]: r["residues"] for r in mine} == found[f][0]
            assert [r["label"] for r in mine] == (sorted if keep_order else list)(found[f][0])
        else:
            assert mine == sorted((r for r in whole if r["family"] == f), key=lambda r: r["row"])


def test_roots_and_levels():
    nodes = alone(family(4, 12, 20), 0, 0)[3]
    roots, above = tree.subtree_roots(nodes, 4), tree.levels_above(nodes, 4)
    for k, node in enumerate(nodes):
        assert nodes[roots[k]].leaves <= max(4, node.leaves) and (k in above) == (node.leaves > 4)
        if k in above:
            assert above[k] == 1 + max(above.get(node.left, 0), above.get(node.right, 0))
    assert tree.subtree_roots(nodes, 12) == [len(nodes) - 1] * len(nodes) and not tree.levels_above(nodes, 12)


def test_draws_are_those_of_the_generator():
    import pandas as pd

    want = [x % 2 == 1 for x in itertools.islice(progressive.glibc_rand(), 300)]
    assert levels._odd(pd.Series([5, 299, 0])).tolist() == [want[5], want[299], want[0]] and levels._odd(pd.Series([7])).tolist() == [want[7]]


def test_each_family_by_its_own_strategy(spark):
    given = {"a": family(5, 5, 30), "b": family(6, 4, 30), "c": family(7, 4, 20), "left out": ["AC"]}
    rows = [(f, k, f"h{k}", r) for f, rs in given.items() for k, r in enumerate(rs)]
    sequences = spark.createDataFrame(rows, "family string, label int, header string, residues string")
    chosen = {"a": (0, 1, 1), "b": (1, 0, 0), "c": (3, 0, 1)}
    strategies = spark.createDataFrame([(f, *s) for f, s in chosen.items()], "family string, s1 int, s2 int, s3 int")
    found = {(r["family"], r["label"]): tuple(r) for r in A.align_by_strategy(sequences, strategies).collect()}
    want = {}
    for f, s in chosen.items():
        want |= {(r["family"], r["label"]): tuple(r) for r in A.align(sequences.filter(F.col("family") == f), s).collect()}
    assert found == want
