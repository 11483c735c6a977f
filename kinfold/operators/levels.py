"""Merges of large families, spread over tasks.

A subtree of bounded size is merged in one task from its own cells. Above, all merges of a level go
at once: the profile of two groups of rows is a join of the stored cells with the columns of their
letters and a sum, which many tasks share; one task for each merge then traces it. Refinement rounds
are merges of a random half with the other.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.residues import letters
from kinfold.operators.progressive import GAP, Rows, glibc_rand, join, progressive, refine
from kinfold.operators.sparse import symmetric
from kinfold.operators.tree import levels_above, merge_order, nodes_of, subtree_roots, weights


def subtrees(tree: DataFrame, sequences: DataFrame, most: int) -> DataFrame:
    """family, label, leaf, root, w, n, merges of every sequence: its place among the leaves, the root of its
    subtree, its weight, the size of its family and, for the first of a subtree, the merges in it."""
    schema = "family string, label int, leaf int, root int, w int, n int, merges array<struct<left_leaves: array<int>, right_leaves: array<int>>>"

    def run(key, frame, members):
        nodes, labels = nodes_of(frame), sorted(members["label"])
        n, roots, w = len(labels), subtree_roots(nodes, most), weights(nodes, len(labels))
        inside: dict[int, list] = {}
        for m in merge_order(nodes):
            if roots[m["left_leaves"][0]] == roots[m["right_leaves"][0]]:
                inside.setdefault(roots[m["left_leaves"][0]], []).append({c: m[c] for c in ("left_leaves", "right_leaves")})
        return pd.DataFrame([(key[0], x, k, roots[k], w[k], n, inside.pop(roots[k], None)) for k, x in enumerate(labels)], columns=["family", "label", "leaf", "root", "w", "n", "merges"])

    return tree.groupBy("family").cogroup(sequences.select("family", "label").groupBy("family")).applyInPandas(run, schema)


def merges_above(tree: DataFrame, most: int) -> DataFrame:
    """family, level, merge, side, node: both sides of every merge of more than most sequences."""

    def run(key, frame):
        nodes = nodes_of(frame)
        rows = [(key[0], level, k, side, x) for k, level in levels_above(nodes, most).items() for side, x in ((1, nodes[k].left), (2, nodes[k].right))]
        return pd.DataFrame(rows, columns=["family", "level", "merge", "side", "node"])

    large = tree.groupBy("family").agg(F.max("n_leaves").alias("all")).filter(F.col("all") > most)
    return tree.join(large.select("family"), "family", "left_semi").groupBy("family").applyInPandas(run, "family string, level int, merge int, side int, node int")


def merge_subtrees(given: DataFrame, cells: DataFrame, parts: DataFrame, keep_order: bool, rounds: bool) -> DataFrame:
    """family, root, label, place, residues, w, n, size: the alignment of each subtree; a whole family is refined as well.

    given: family, label, residues, root, leaf, w, n, s1 of every sequence.
    """
    of = lambda x: given.select("family", F.col("label").alias(x), F.col("root").alias(f"root_{x}"), F.col("leaf").alias(f"leaf_{x}"))
    inner = cells.join(of("a"), ["family", "a"]).join(of("b"), ["family", "b"]).filter("root_a = root_b")
    packed = inner.groupBy("family", F.col("root_a").alias("root"), "leaf_a", "leaf_b").agg(F.collect_list(F.struct("i", "j", "p")).alias("cells"))
    packed = packed.select("family", "root", "leaf_a", "leaf_b", *[F.col(f"cells.{x}").alias(x) for x in ("i", "j", "p")])
    rows = given.join(parts.select("family", "label", "merges"), ["family", "label"])
    schema = "family string, root int, label int, place int, residues string, w int, n int, size int"

    def run(key, own, pairs):
        own = own.sort_values("leaf")
        at = {x: k for k, x in enumerate(own["leaf"])}
        posteriors = {(at[r.leaf_a], at[r.leaf_b]): (r.i, r.j, r.p) for r in pairs.itertuples(index=False)}
        merges = next((m for m in own["merges"] if m is not None), [])
        inside = [{c: [at[x] for x in m[c]] for c in ("left_leaves", "right_leaves")} for m in merges]
        n, w = int(own["n"].iloc[0]), own["w"].tolist()
        aligned = progressive(own["residues"].tolist(), inside, posteriors, w)
        if n == len(own):
            if keep_order:
                aligned = dict(sorted(aligned.items()))
            if rounds and n > 1:
                aligned = refine(aligned, posteriors, int(own["s1"].iloc[0]))
            if keep_order:
                aligned = dict(sorted(aligned.items()))
        labels = own["label"].tolist()
        return pd.DataFrame([(*key, labels[k], place, text, w[k], n, len(own)) for place, (k, text) in enumerate(aligned.items())], columns=[c.split()[0] for c in schema.split(", ")])

    return rows.groupBy("family", "root").cogroup(packed.groupBy("family", "root")).applyInPandas(run, schema)


def merge(groups: DataFrame, cells: DataFrame, weighted: bool) -> DataFrame:
    """family, merge, label, place, residues: the two sides of each merge aligned by their summed cells.

    groups: family, merge, side, place, label, residues and, if weighted, w. Columns that are gaps in
    a whole side fall away first.
    """
    numbered = F.filter(F.transform(letters(F.col("residues")), lambda x, k: F.when(x != "-", k)), lambda k: k.isNotNull())
    extra = ["w"] if weighted else []
    columns = groups.select("family", "merge", "side", "label", *extra, F.posexplode(numbered).alias("at", "col"))
    side = lambda k, label, place: columns.filter(F.col("side") == k).select("family", "merge", F.col("label").alias(label), (F.col("at") + 1).alias(place), F.col("col").alias(f"c{k}"), *[F.col(x).alias(f"{x}{k}") for x in extra])
    met = symmetric(cells).join(side(1, "a", "i"), ["family", "a", "i"]).join(side(2, "b", "j"), ["family", "merge", "b", "j"])
    value = F.col("p") * F.col("w1") * F.col("w2") if weighted else F.col("p")
    sums = met.groupBy("family", "merge", "c1", "c2").agg(F.sum(value).alias("p"))

    def run(key, rows, found):
        rows = rows.sort_values(["side", "place"])
        sides = [Rows(part["label"].tolist(), Rows.of(dict(enumerate(part["residues"]))).letters) for _, part in rows.groupby("side")]
        whole = np.zeros((sides[0].letters.shape[1], sides[1].letters.shape[1]))
        whole[found["c1"].to_numpy(int), found["c2"].to_numpy(int)] = found["p"].to_numpy()
        one, two = ((r.letters != GAP).any(axis=0) for r in sides)
        if weighted:
            whole /= np.prod([part["w"].sum() for _, part in rows.groupby("side")], dtype=float)
        done, _ = join(sides[0].projected(), sides[1].projected(), whole[np.ix_(one, two)])
        return pd.DataFrame([(*key, label, place, text) for place, (label, text) in enumerate(done.texts().items())], columns=["family", "merge", "label", "place", "residues"])

    # of new columns, for both sides of the cogroup come from groups
    rows = groups.select(*[F.col(c).alias(c) for c in ("family", "merge", "side", "place", "label", "residues", *extra)])
    return rows.groupBy("family", "merge").cogroup(sums.groupBy("family", "merge")).applyInPandas(run, "family string, merge int, label int, place int, residues string")


def merge_level(state: DataFrame, cells: DataFrame, schedule: DataFrame) -> DataFrame:
    """state (family, node, place, label, residues, w) after the merges of one level."""
    due = schedule.select("family", "merge", "side", "node")
    rest = state.join(due, ["family", "node"], "left_anti")
    done = merge(state.join(due, ["family", "node"]), cells, True).join(state.select("family", "label", "w"), ["family", "label"])
    return rest.unionByName(done.select("family", F.col("merge").alias("node"), "place", "label", "residues", "w"))


def in_order(state: DataFrame, by: str) -> DataFrame:
    """state (family, place, label, residues) with places from 0 in the order of a column."""
    return state.withColumn("place", (F.row_number().over(Window.partitionBy("family").orderBy(by)) - 1).cast("int"))


@lru_cache(maxsize=1)
def _draws() -> tuple:
    return glibc_rand(), []


def _odd(numbers: pd.Series) -> pd.Series:
    """Whether the draws of these numbers, from 0, of the generator are odd."""
    draw, known = _draws()
    while len(known) <= numbers.max():
        known.append(next(draw) % 2 == 1)
    return pd.Series(known)[numbers].reset_index(drop=True)


def refine_round(state: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """state (family, place, label, residues) after the k-th random split; a family with an empty side stays."""
    sizes = state.groupBy("family").agg(F.count("*").alias("n"))
    odd = F.pandas_udf(_odd, "boolean")
    drawn = state.join(sizes, "family").withColumn("side", F.when(odd((k * F.col("n") + F.col("place")).cast("long")), 1).otherwise(2))
    split = drawn.groupBy("family").agg(F.countDistinct("side").alias("sides")).filter("sides = 2").select("family")
    moved = merge(drawn.join(split, "family").withColumn("merge", F.lit(0)), cells, False)
    return moved.select("family", "place", "label", "residues").unionByName(state.join(split, "family", "left_anti").select("family", "place", "label", "residues"))
