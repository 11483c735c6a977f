"""Sequences, alignments and posterior cells derived from ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.residues import from_text, letters

#: Sequences of a derived family.
FAMILY_SIZE = 4
#: Derived cells reach this; it leaves the cells of equal letters and those near the diagonal.
LEAST_CELL = 0.03


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def benchmark_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family, label, header, residues: each FAMILY_SIZE benchmark items in a row are a family."""
    items = load(spark, sf_dir, "benchmark")
    return items.select(
        F.floor(F.col("item_id") / FAMILY_SIZE).cast("string").alias("family"),
        (F.col("item_id") % FAMILY_SIZE).cast("int").alias("label"),
        F.concat(F.lit("item"), F.col("item_id").cast("string"), F.lit(" benchmark")).alias("header"),
        from_text(F.col("text")).alias("residues"),
    )


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family, label, residues: a user's events in order of time, each type as its first letter's place among the types.

    A sequence is one value, so a user's events are bounded by what one row may hold.
    """
    events = load(spark, sf_dir, "events")
    letter = F.upper(F.substring("event_type", 1, 1))
    each = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", letter.alias("x")))).alias("all"))
    residues = F.array_join(F.transform("all", lambda e: e["x"]), "")
    return each.select((F.col("user_id") % 10).cast("string").alias("family"), F.col("user_id").cast("int").alias("label"), residues.alias("residues"))


def derived_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family, label, header, residues of equal length: every fifth letter is a gap, shifted by label, and ends are filled."""
    rows = benchmark_sequences(spark, sf_dir)
    width = rows.groupBy("family").agg(F.max(F.length("residues")).alias("width"))
    gapped = F.array_join(F.transform(letters(F.col("residues")), lambda x, k: F.when((k + F.col("label")) % 5 == 0, "-").otherwise(x)), "")
    return rows.join(width, "family").select("family", "label", "header", F.rpad(gapped, F.col("width"), "-").alias("residues"))


def derived_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """family, a, b, i, j, p of every pair: 0.5 for equal letters, else 0.1 / (1 + |i - j|), where that reaches LEAST_CELL."""
    one = benchmark_sequences(spark, sf_dir).select("family", "label", F.posexplode(letters(F.col("residues"))).alias("at", "x"))
    a = one.select("family", F.col("label").alias("a"), (F.col("at") + 1).alias("i"), F.col("x"))
    b = one.select("family", F.col("label").alias("b"), (F.col("at") + 1).alias("j"), F.col("x").alias("y"))
    p = F.when(F.col("x") == F.col("y"), 0.5).otherwise(F.lit(0.1) / (1 + F.abs(F.col("i") - F.col("j"))))
    return a.join(b, "family").filter("a < b").select("family", "a", "b", "i", "j", p.alias("p")).filter(F.col("p") >= LEAST_CELL)


def label_weights(sequences: DataFrame) -> DataFrame:
    """family, label, w: 100 and ten more for each label."""
    return sequences.select("family", "label", (F.lit(100) + 10 * F.col("label")).alias("w"))
