"""Sparse posteriors as tables of cells (family, a, b, i, j, p) and their algebra by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.model import CUTOFF

KEYS = ["family", "a", "b", "i", "j"]


def sparsify(cells: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Cells that reach cutoff."""
    return cells.filter(F.col("p") >= cutoff)


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select("family", F.col("b").alias("a"), F.col("a").alias("b"), F.col("j").alias("i"), F.col("i").alias("j"), "p")


def symmetric(cells: DataFrame) -> DataFrame:
    """Each pair in both orders, so that one join serves all intermediate sequences."""
    return cells.select(*KEYS, "p").unionByName(transpose(cells))


def lookup(cells: DataFrame, points: DataFrame) -> DataFrame:
    """points (family, a, b, i, j, any others) with p, 0 where there is no cell."""
    return points.join(cells.select(*KEYS, "p"), KEYS, "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


def dense(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """All cells of the matrices in sizes (family, a, b, len_a, len_b), 0 where none is stored."""
    grid = sizes.filter("len_a > 0 AND len_b > 0").select("family", "a", "b", "len_b", F.explode(F.sequence(F.lit(1), "len_a")).alias("i"))
    return lookup(cells, grid.select("family", "a", "b", "i", F.explode(F.sequence(F.lit(1), "len_b")).alias("j")))


def _products(cells: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Sums over third sequences z of p(x, z) p(z, y), for stored cells of (x, y) alone.

    The stored columns of a row i of (x, y) travel with it, and so do the cells of a residue k of z
    in y; a product outside of what is stored is never made. Both arrays are bounded by the length
    of y.
    """
    both = symmetric(cells)
    wanted = cells.groupBy("family", F.col("a").alias("x"), F.col("b").alias("y"), "i").agg(F.collect_set("j").alias("js"))
    xz = both.select("family", F.col("a").alias("x"), F.col("b").alias("z"), "i", F.col("j").alias("k"), "p")
    zy = both.select("family", F.col("a").alias("z"), F.col("b").alias("y"), F.col("i").alias("k"), "j", F.col("p").alias("q"))
    if weights is not None:
        zy = zy.join(weights.select("family", F.col("label").alias("z"), F.col("w").alias("wz")), ["family", "z"]).withColumn("q", F.col("q") * F.col("wz")).drop("wz")
    zy = zy.groupBy("family", "z", "y", "k").agg(F.collect_list(F.struct("j", "q")).alias("to"))
    met = xz.join(wanted, ["family", "x", "i"]).join(zy, ["family", "z", "y", "k"])
    hits = F.filter("to", lambda c: F.array_contains("js", c["j"]))
    found = met.select("family", "x", "y", "i", "p", F.explode(hits).alias("c"))
    found = found.select("family", F.col("x").alias("a"), F.col("y").alias("b"), "i", F.col("c.j").alias("j"), (F.col("p") * F.col("c.q")).alias("s"))
    return found.groupBy(*KEYS).agg(F.sum("s").alias("s"))


def consistency(cells: DataFrame, sequences: DataFrame, weights: DataFrame | None = None, cutoff: float = CUTOFF) -> DataFrame:
    """One round of the consistency transformation on the stored cells, those under cutoff left out.

    sequences (family, label) tells the size of each family. Without weights a cell becomes
    (2 p + sum over z of p(x, z) p(z, y)) / n; with weights (family, label, w) it becomes
    ((w_x + w_y) p + sum over z of w_z p(x, z) p(z, y)) / sum of all w.
    """
    base = cells.select(*KEYS, "p").join(_products(cells, weights), KEYS, "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    if weights is None:
        size = sequences.groupBy("family").agg(F.count("*").alias("n"))
        found = base.join(size, "family").withColumn("p", (2 * F.col("p") + F.col("s")) / F.col("n"))
    else:
        of = lambda side: weights.select("family", F.col("label").alias(side), F.col("w").alias(f"w{side}"))
        size = weights.groupBy("family").agg(F.sum("w").alias("n"))
        found = base.join(of("a"), ["family", "a"]).join(of("b"), ["family", "b"]).join(size, "family")
        found = found.withColumn("p", ((F.col("wa") + F.col("wb")) * F.col("p") + F.col("s")) / F.col("n"))
    return sparsify(found.select(*KEYS, "p"), cutoff)


def profile_posterior(cells: DataFrame, columns: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """family, c1, c2, p: sums over pairs of sequences of two groups, at their alignment columns.

    columns (family, side, label, residue, col) maps residues of the sequences of sides 1 and 2.
    With weights (family, label, w) a pair counts w_s w_t / sum of all w_s w_t, else 1.
    """
    both = symmetric(cells)
    side = lambda k, label, residue: columns.filter(F.col("side") == k).select("family", F.col("label").alias(label), F.col("residue").alias(residue), F.col("col").alias(f"c{k}"))
    found = both.join(side(1, "a", "i"), ["family", "a", "i"]).join(side(2, "b", "j"), ["family", "b", "j"])
    value: Column = F.col("p")
    if weights is not None:
        of = lambda x: weights.select("family", F.col("label").alias(x), F.col("w").alias(f"w{x}"))
        members = columns.select("family", "side", "label").distinct().join(weights, ["family", "label"])
        sums = members.groupBy("family").agg((F.sum(F.when(F.col("side") == 1, F.col("w"))) * F.sum(F.when(F.col("side") == 2, F.col("w")))).alias("all"))
        found = found.join(of("a"), ["family", "a"]).join(of("b"), ["family", "b"]).join(sums, "family")
        value = F.col("p") * F.col("wa") * F.col("wb") / F.col("all")
    return found.groupBy("family", "c1", "c2").agg(F.sum(value).alias("p"))


def rms(*models: DataFrame) -> DataFrame:
    """Root of the mean square of several models' cells; a missing cell counts as 0."""
    each = models[0].select(*KEYS, "p")
    for m in models[1:]:
        each = each.unionByName(m.select(*KEYS, "p"))
    return each.groupBy(*KEYS).agg(F.sqrt(F.sum(F.col("p") * F.col("p")) / len(models)).alias("p"))
