"""Votes, classes, reports and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.model import CLASS_PRIORS, OTHER_STRATEGY, STRATEGIES


def strategy_vote(votes: DataFrame, priors: tuple[float, ...] = CLASS_PRIORS) -> DataFrame:
    """family, cls: the class whose share of the family's votes, over its prior, is largest; the smallest of equals."""
    counts = votes.groupBy("family", "cls").agg(F.count("*").alias("n"))
    totals = counts.groupBy("family").agg(F.sum("n").alias("total"))
    prior = F.element_at(F.array(*map(F.lit, priors)), F.col("cls") + 1)
    lift = (F.col("n") / F.col("total")) / prior
    best = counts.join(totals, "family").groupBy("family").agg(F.max(F.struct(lift.alias("lift"), (-F.col("cls")).alias("minus"))).alias("best"))
    return best.select("family", (-F.col("best.minus")).alias("cls"))


def strategy_columns(cls: Column) -> list[Column]:
    """s1, s2, s3 of a class."""
    out = []
    for k, name in enumerate(("s1", "s2", "s3")):
        value = F.lit(OTHER_STRATEGY[k])
        for c, strategy in STRATEGIES.items():
            value = F.when(cls == c, strategy[k]).otherwise(value)
        out.append(value.alias(name))
    return out


def top_classes(rows: DataFrame, cls: str, k: int = 4) -> DataFrame:
    """Rows of the k most frequent classes; of equally frequent ones the smaller."""
    most = rows.groupBy(cls).count().orderBy(F.desc("count"), cls).limit(k).select(cls)
    return rows.join(F.broadcast(most), cls, "left_semi")


def pid_bin(pid: Column) -> Column:
    """Bin of a share of identity: up to 0.3, up to 0.6, above."""
    return F.when(pid <= 0.3, "0-30").when(pid <= 0.6, "30-60").when(pid.isNotNull(), "60-100")


def bin_means(pids: DataFrame, sheet: DataFrame) -> DataFrame:
    """bin, families, mean_tc, mean_sp of pids (family, pid) against sheet (family, row, tc, sp).

    The first row of a family in the sheet counts; one that is missing adds 0 but is counted.
    """
    first = sheet.groupBy("family").agg(F.min(F.struct("row", "tc", "sp")).alias("m")).select("family", "m.tc", "m.sp")
    joined = pids.join(first, "family", "left").withColumn("bin", pid_bin(F.col("pid")))
    mean = lambda x: (F.sum(F.coalesce(x, F.lit(0.0))) / F.count("*")).alias(f"mean_{x}")
    return joined.groupBy("bin").agg(F.count("*").alias("families"), mean("tc"), mean("sp"))


def confusion(rows: DataFrame, true: str, pred: str, classes: list[int]) -> DataFrame:
    """A row for each true class with counts of each predicted one, c0, c1, ..."""
    return rows.groupBy(F.col(true).alias("true_class")).agg(*[F.count_if(F.col(pred) == c).alias(f"c{c}") for c in classes])


def class_report(rows: DataFrame, true: str, pred: str, classes: list[int]) -> DataFrame:
    """cls, precision, recall, f1, support, accuracy; a share of nothing is 0."""
    cls = F.explode(F.array(*map(F.lit, classes))).alias("cls")
    hit = (F.col(true) == F.col("cls")) & (F.col(pred) == F.col("cls"))
    counts = rows.select(true, pred, cls).groupBy("cls").agg(
        F.count_if(hit).alias("tp"), F.count_if(F.col(pred) == F.col("cls")).alias("said"), F.count_if(F.col(true) == F.col("cls")).alias("support"), F.avg((F.col(true) == F.col(pred)).cast("double")).alias("accuracy")
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = share(F.col("tp"), F.col("said")), share(F.col("tp"), F.col("support"))
    return counts.select("cls", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), "support", "accuracy")


#: Ranges of the index in which mismatches are numbered; one task sees this many counts.
BLOCKS = 4096


def mismatches_every_second(rows: DataFrame, index: str, true: str, pred: str) -> DataFrame:
    """The first, third, ... mismatch in order of index.

    Numbered in two levels, by BLOCKS ranges of the index and within them, so no task sees all rows.
    """
    low, high = rows.agg(F.min(index), F.max(index)).first()
    width = 1 if low is None else int((high - low) // BLOCKS) + 1
    wrong = rows.filter(~F.col(true).eqNullSafe(F.col(pred))).withColumn("_block", F.floor((F.col(index) - F.lit(low)) / width))
    sizes = wrong.groupBy("_block").agg(F.count("*").alias("_n"))
    before = sizes.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    numbered = wrong.withColumn("_at", F.row_number().over(Window.partitionBy("_block").orderBy(index)))
    return numbered.join(before, "_block").filter((F.col("_before") + F.col("_at")) % 2 == 1).drop("_block", "_at", "_before")


def replace_last(rows: DataFrame, index: str, column: str, changes: DataFrame) -> DataFrame:
    """rows with column replaced by that of changes (index, column) where the index is there."""
    new = changes.select(index, F.col(column).alias("_new"))
    return rows.join(new, index, "left").withColumn(column, F.coalesce("_new", F.col(column))).drop("_new")


def two_level_mean(rows: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """outer, mean: the mean over inner groups of their means."""
    means = rows.groupBy(outer, inner).agg(F.avg(value).alias("m"))
    return means.groupBy(outer).agg(F.avg("m").alias("mean"))


def fold(key: Column, folds: int, seed: int = 929) -> Column:
    """Fold of a row by a hash of its key."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")
