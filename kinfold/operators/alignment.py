"""Operators on alignments: rows (family, label, residues) of equal length within a family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.model import STRONG_GROUPS, WEAK_GROUPS
from kinfold.functions.residues import letters

CLUSTAL_BANNER = "CLUSTAL multiple sequence alignment\n\n\n"


def cells(alignment: DataFrame) -> DataFrame:
    """family, label, col (from 1), residue."""
    return alignment.select("family", "label", F.posexplode(letters(F.col("residues"))).alias("at", "residue")).select("family", "label", (F.col("at") + 1).alias("col"), "residue")


def residue_columns(alignment: DataFrame) -> DataFrame:
    """family, label, residue (number from 1), col: where each letter of a sequence stands."""
    order = Window.partitionBy("family", "label").orderBy("col")
    return cells(alignment).filter("residue <> '-'").select("family", "label", F.row_number().over(order).alias("residue"), "col")


def project(alignment: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows in chosen (family, label), without the columns that are gaps in all of them."""
    kept = alignment.join(chosen.select("family", "label").distinct(), ["family", "label"], "left_semi")
    found = cells(kept)
    used = found.groupBy("family", "col").agg(F.max((F.col("residue") != "-").cast("int")).alias("used")).filter("used = 1").select("family", "col")
    rows = found.join(used, ["family", "col"]).groupBy("family", "label").agg(F.array_sort(F.collect_list(F.struct("col", "residue"))).alias("at"))
    return rows.select("family", "label", F.array_join(F.transform("at", lambda x: x["residue"]), "").alias("residues"))


def annotation(alignment: DataFrame) -> DataFrame:
    """family, col, mark: * for one letter, : within a strong group, . within a weak one, else blank.

    Gaps are ignored; a column with a single letter in one row is blank, a column of gaps is *.
    """
    seen = cells(alignment).groupBy("family", "col").agg(F.collect_set(F.when(F.col("residue") != "-", F.upper("residue"))).alias("set"), F.count_if(F.col("residue") != "-").alias("n"), F.count("*").alias("rows"))
    within = lambda groups: F.exists(F.array(*map(F.lit, groups)), lambda g: F.forall("set", lambda x: F.contains(g, x)))
    mark = F.when(F.col("n") == 0, "*").when((F.col("n") == 1) & (F.col("rows") > 1), " ").when(F.size("set") == 1, "*")
    return seen.select("family", "col", mark.when(within(STRONG_GROUPS), ":").when(within(WEAK_GROUPS), ".").otherwise(" ").alias("mark"))


def clustal(alignment: DataFrame, width: int = 60) -> DataFrame:
    """family, text: blocks of width columns, names padded to the longest and four more, marks below."""
    marks = annotation(alignment).groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "mark"))), lambda x: x["mark"]), "").alias("residues"))
    named = alignment.select("family", "label", F.regexp_extract("header", r"^\s*(\S*)", 1).alias("name"), "residues")
    widths = named.groupBy("family").agg((F.max(F.length("name")) + 4).alias("pad"))
    lines = named.unionByName(marks.select("family", F.lit(2**31 - 1).alias("label"), F.lit("").alias("name"), "residues")).join(widths, "family")
    blocks = lines.select("family", "label", "pad", "name", "residues", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("residues") - 1), F.lit(width))).alias("start"))
    line = F.concat(F.rpad("name", F.col("pad"), " "), F.substring("residues", F.col("start") + 1, F.lit(width)), F.lit("\n"))
    each = blocks.select("family", "start", "label", line.alias("line")).groupBy("family", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", "line"))), lambda x: x["line"]), "").alias("block"))
    text = each.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "block"))), lambda x: x["block"]), "\n").alias("text"))
    return text.select("family", F.concat(F.lit(CLUSTAL_BANNER), "text").alias("text"))


def identity(alignment: DataFrame) -> DataFrame:
    """family, identity: mean over pairs of the share of equal letters in columns where both have one.

    Counted by column and letter, so no pairs are formed: a letter seen n times makes n (n - 1) / 2 of them.
    """
    counts = cells(alignment).filter("residue <> '-'").groupBy("family", "col", "residue").agg(F.count("*").alias("n"))
    columns = counts.groupBy("family", "col").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"), (F.sum("n") * (F.sum("n") - 1) / 2).alias("all"))
    return columns.groupBy("family").agg((F.sum("same") / F.sum("all")).alias("identity"))


def merge(one: DataFrame, two: DataFrame) -> DataFrame:
    """The rows of two alignments of equal length as one, by sort_label where there is one."""
    return one.unionByName(two, allowMissingColumns=True)


def relabel(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """rows with label counting from 0 within a family, in the given order."""
    return rows.withColumn("label", F.row_number().over(Window.partitionBy("family").orderBy(*order)) - 1)


def append_files(files: list[DataFrame]) -> DataFrame:
    """Sequences of several inputs of a family, those of later ones after those of earlier ones."""
    tagged = [f.withColumn("_file", F.lit(k)) for k, f in enumerate(files)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    return relabel(every, ["_file", "label"]).drop("_file")
