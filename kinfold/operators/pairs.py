"""Pairs of the sequences of a family, and measures of two sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.model import ScoreMatrix
from kinfold.functions.residues import letters


def _sides(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    side = lambda x: sequences.select("family", F.col("label").alias(x), F.col("residues").alias(f"res_{x}"), F.length("residues").alias(f"len_{x}"))
    return side("a"), side("b")


def all_pairs(sequences: DataFrame) -> DataFrame:
    """family, a, b, res_a, res_b, len_a, len_b of each two sequences a < b of a family.

    Every pair of a family is the result that alignment needs. A large family is split: the
    equi-join on family is skew-joined by adaptive execution.
    """
    a, b = _sides(sequences)
    return a.join(b, "family").filter("a < b")


def classifier_pairs(sequences: DataFrame) -> DataFrame:
    """Pairs a <= b with self pairs, but without that of the last sequence; label counts from 0."""
    a, b = _sides(sequences)
    n = sequences.groupBy("family").agg(F.count("*").alias("n"))
    return a.join(b, "family").join(n, "family").filter("a <= b AND a < n - 1").drop("n")


def group_pairs(sequences: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs across the two groups of groups (family, label, side), the smaller label first."""
    sided = sequences.join(groups, ["family", "label"])
    one = sided.filter("side = 1").select("family", F.col("label").alias("s"), F.col("residues").alias("res_s"))
    two = sided.filter("side = 2").select("family", F.col("label").alias("t"), F.col("residues").alias("res_t"))
    found = one.join(two, "family")
    pick = lambda x, y: F.when(F.col("s") < F.col("t"), F.col(x)).otherwise(F.col(y))
    return found.select("family", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), pick("res_s", "res_t").alias("res_a"), pick("res_t", "res_s").alias("res_b"))


def positional_identity(a: Column, b: Column) -> Column:
    """Share of equal letters at equal places, of the shorter length; null if that is 0."""
    n = F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.zip_with(letters(a), letters(b), lambda x, y: F.when(x == y, 1)), lambda k: k.isNotNull()))
    return F.when(n > 0, same / n)


def matrix_frame(spark, matrix: ScoreMatrix) -> DataFrame:
    """x, y, s of a scoring matrix; its size is that of an alphabet squared."""
    return spark.createDataFrame(matrix.rows(), "x string, y string, s double")


def positional_scores(pairs: DataFrame, matrix: DataFrame) -> DataFrame:
    """family, a, b, score, columns: summed scores of letters at equal places; unknown letters score 0."""
    places = pairs.select("family", "a", "b", F.posexplode(F.zip_with(letters(F.col("res_a")), letters(F.col("res_b")), lambda x, y: F.struct(x.alias("x"), y.alias("y")))).alias("at", "pair"))
    places = places.filter("pair.x IS NOT NULL AND pair.y IS NOT NULL").select("family", "a", "b", "pair.x", "pair.y")
    counted = places.groupBy("family", "a", "b", "x", "y").agg(F.count("*").alias("n"))
    scored = counted.join(F.broadcast(matrix), ["x", "y"], "left")
    return scored.groupBy("family", "a", "b").agg(F.sum(F.coalesce("s", F.lit(0.0)) * F.col("n")).alias("score"), F.sum("n").alias("columns"))


def path_measures(path: Column, a: Column, b: Column) -> dict[str, Column]:
    """identity of an edit path over B, X, Y: matches at B columns per column of the path."""
    count = lambda p, kinds: F.length(p) - F.length(F.translate(p, kinds, ""))
    steps = F.sequence(F.lit(1), F.length(path))
    head = lambda k: F.substring(path, F.lit(1), k)
    at = lambda k: F.substring(path, k, F.lit(1))
    same = F.filter(steps, lambda k: (at(k) == "B") & (F.substring(a, count(head(k), "BX"), F.lit(1)) == F.substring(b, count(head(k), "BY"), F.lit(1))))
    return {"path_len": F.length(path), "identity": F.when(F.length(path) > 0, F.size(same) / F.length(path))}


def nearest(distances: DataFrame) -> DataFrame:
    """family, a, b, d of the nearest pair; of equal ones that of smallest a, then b. A null d comes last, as in SQL."""
    least = F.min(F.struct(F.col("d").isNull().alias("none"), "d", "a", "b"))
    return distances.groupBy("family").agg(least.alias("m")).select("family", "m.a", "m.b", "m.d")
