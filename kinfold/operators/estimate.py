"""Model parameters counted from sequences: letter shares and log-odds scores. Results are as small as an alphabet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.model import ALPHABET, GAP_COSTS, PairModel, ScoreMatrix
from kinfold.functions.residues import letters


def _alphabet(spark, name: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ALPHABET], f"{name} string")


def letter_shares(sequences: DataFrame) -> DataFrame:
    """x, share of each letter of the alphabet, each counted once more than it occurs."""
    seen = sequences.select(F.explode(letters(F.col("residues"))).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    counted = _alphabet(sequences.sparkSession, "x").join(seen, "x", "left").select("x", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    whole = counted.agg(F.sum("n").alias("all"))
    return counted.crossJoin(F.broadcast(whole)).select("x", (F.col("n") / F.col("all")).alias("share"))  # 20 rows and 1


def model_of(sequences: DataFrame) -> PairModel:
    """The default pair model with the letter shares of sequences."""
    found = {r["x"]: r["share"] for r in letter_shares(sequences).collect()}
    return PairModel(single={x: found[x] for x in ALPHABET})


def log_odds(pairs: DataFrame) -> DataFrame:
    """x, y, s of all letters: twice the log to base 2 of how much oftener than by chance they stand at equal places, rounded.

    pairs: res_a, res_b. Places where one has a letter beyond the alphabet don't count.
    """
    places = pairs.select(F.explode(F.zip_with(letters(F.col("res_a")), letters(F.col("res_b")), lambda x, y: F.struct(x.alias("x"), y.alias("y")))).alias("p"))
    known = places.select("p.x", "p.y").filter(F.col("x").isin(*ALPHABET) & F.col("y").isin(*ALPHABET)).groupBy("x", "y").agg(F.count("*").alias("n"))
    both = known.unionByName(known.select(F.col("y").alias("x"), F.col("x").alias("y"), "n")).groupBy("x", "y").agg(F.sum("n").alias("n"))
    of = lambda c: both.groupBy(F.col("x").alias(c)).agg(F.sum("n").alias(f"n_{c}"))
    spark = pairs.sparkSession
    grid = _alphabet(spark, "x").crossJoin(_alphabet(spark, "y"))  # the alphabet squared
    whole = grid.join(both, ["x", "y"], "left").join(of("x"), "x", "left").join(of("y"), "y", "left").na.fill(0)
    whole = whole.crossJoin(F.broadcast(both.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("all"))))
    odds = (F.col("n") + 1) * F.col("all") / ((F.col("n_x") + 1) * (F.col("n_y") + 1))
    return whole.select("x", "y", (F.round(2 * F.log2(odds)) + 0.0).alias("s"))


def matrix_of(pairs: DataFrame, gaps: tuple[float, float] = GAP_COSTS[160]) -> ScoreMatrix:
    """The scoring matrix of log_odds."""
    return ScoreMatrix(ALPHABET, {(r["x"], r["y"]): float(r["s"]) for r in log_odds(pairs).collect()}, gaps)
