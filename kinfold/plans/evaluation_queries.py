"""Queries over votes, classes, reports and nested means."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions.residues import one_hot
from kinfold.operators import evaluate as E
from kinfold.operators import pairs
from kinfold.plans.pair_queries import _PAIRS, _rounded
from kinfold.plans.registry import query
from kinfold.sources import tables as T

_VOTES = """v AS (SELECT CAST(doc_id % 50 AS VARCHAR) AS family, CAST(quality + 2 * toxic AS INTEGER) AS cls FROM labels)"""


def _votes(spark, sf_dir):
    rows = T.load(spark, sf_dir, "labels")
    return rows.select((F.col("doc_id") % 50).cast("string").alias("family"), (F.col("quality") + 2 * F.col("toxic")).cast("int").alias("cls"))


@query(
    "strategy_vote",
    f"""WITH {_VOTES}, n AS (SELECT family, cls, count(*) AS n FROM v GROUP BY ALL),
    l AS (SELECT *, n / sum(n) OVER (PARTITION BY family) / [0.22, 0.17, 0.21, 0.4][cls + 1] AS lift FROM n)
    SELECT family, cls FROM l QUALIFY row_number() OVER (PARTITION BY family ORDER BY lift DESC, cls) = 1""",
)
def strategy_vote(spark, sf_dir):
    return E.strategy_vote(_votes(spark, sf_dir))


@query(
    "strategy_map",
    f"""WITH {_VOTES} SELECT DISTINCT family, cls, CAST([0, 1, 2, 3][cls + 1] AS INTEGER) AS s1, CAST([1, 0, 0, 0][cls + 1] AS INTEGER) AS s2, CAST([1, 1, 0, 1][cls + 1] AS INTEGER) AS s3 FROM v""",
)
def strategy_map(spark, sf_dir):
    return _votes(spark, sf_dir).distinct().select("family", "cls", *E.strategy_columns(F.col("cls")))


@query("topk_class_filter", "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 4)")
def topk_class_filter(spark, sf_dir):
    return E.top_classes(T.load(spark, sf_dir, "documents").select("doc_id", "source"), "source").select("doc_id", "source")


@query("class_frequency", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def class_frequency(spark, sf_dir):
    return T.load(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query(
    "pid_bins_mean",
    f"""WITH {_PAIRS},
    pid AS (SELECT family, avg(len(list_filter(range(1, least(length(ra), length(rb)) + 1), lambda k: ra[k] = rb[k])) / least(length(ra), length(rb))) AS pid FROM p GROUP BY family),
    sheet AS (SELECT CAST(doc_id % 9 AS VARCHAR) AS family, arg_min(quality, doc_id)::DOUBLE AS tc, arg_min(toxic, doc_id)::DOUBLE AS sp FROM labels GROUP BY doc_id % 9)
    SELECT CASE WHEN pid <= 0.3 THEN '0-30' WHEN pid <= 0.6 THEN '30-60' ELSE '60-100' END AS bin, count(*) AS families,
           round(sum(coalesce(tc, 0)) / count(*), 9) AS mean_tc, round(sum(coalesce(sp, 0)) / count(*), 9) AS mean_sp
    FROM pid LEFT JOIN sheet USING (family) GROUP BY 1""",
)
def pid_bins_mean(spark, sf_dir):
    found = pairs.all_pairs(T.benchmark_sequences(spark, sf_dir))
    pids = found.groupBy("family").agg(F.avg(pairs.positional_identity(F.col("res_a"), F.col("res_b"))).alias("pid"))
    labels = T.load(spark, sf_dir, "labels")
    sheet = labels.select((F.col("doc_id") % 9).cast("string").alias("family"), F.col("doc_id").alias("row"), F.col("quality").cast("double").alias("tc"), F.col("toxic").cast("double").alias("sp"))
    return _rounded(E.bin_means(pids, sheet), "mean_tc", "mean_sp")


@query("confusion_matrix", "SELECT quality AS true_class, count(*) FILTER (toxic = 0) AS c0, count(*) FILTER (toxic = 1) AS c1 FROM labels GROUP BY quality")
def confusion_matrix(spark, sf_dir):
    return E.confusion(T.load(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])


@query(
    "class_report",
    """
    WITH k AS (
        SELECT CAST(cls AS INTEGER) AS cls, count(*) FILTER (quality = cls AND toxic = cls) AS tp, count(*) FILTER (toxic = cls) AS said,
               count(*) FILTER (quality = cls) AS support, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0 END) AS accuracy
        FROM labels, (VALUES (0), (1)) AS c(cls) GROUP BY cls),
    r AS (SELECT *, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM k)
    SELECT cls, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1, support, round(accuracy, 9) AS accuracy FROM r""",
)
def class_report(spark, sf_dir):
    return _rounded(E.class_report(T.load(spark, sf_dir, "labels"), "quality", "toxic", [0, 1]), "precision", "recall", "f1", "accuracy")


@query("mismatch_every_second", "SELECT doc_id, quality, toxic FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM labels WHERE quality <> toxic) WHERE k % 2 = 1")
def mismatch_every_second(spark, sf_dir):
    return E.mismatches_every_second(T.load(spark, sf_dir, "labels"), "doc_id", "quality", "toxic").select("doc_id", "quality", "toxic")


@query(
    "relabel_rows",
    "SELECT doc_id, CASE WHEN k % 2 = 1 THEN toxic ELSE quality END AS quality FROM (SELECT *, CASE WHEN quality <> toxic THEN row_number() OVER (PARTITION BY quality <> toxic ORDER BY doc_id) END AS k FROM labels)",
)
def relabel_rows(spark, sf_dir):
    rows = T.load(spark, sf_dir, "labels")
    changes = E.mismatches_every_second(rows, "doc_id", "quality", "toxic").select("doc_id", F.col("toxic").alias("quality"))
    return E.replace_last(rows.select("doc_id", "quality"), "doc_id", "quality", changes)


@query("em_two_level_mean", "SELECT l_returnflag, round(avg(m), 6) AS mean FROM (SELECT l_returnflag, l_orderkey, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) GROUP BY l_returnflag")
def em_two_level_mean(spark, sf_dir):
    return E.two_level_mean(T.load(spark, sf_dir, "lineitem"), "l_returnflag", "l_orderkey", "l_quantity").withColumn("mean", F.round("mean", 6))


@query("one_hot_class", f"WITH {_VOTES} SELECT family, cls, array_to_string(list_transform(range(4), lambda k: CASE WHEN k = cls THEN 1 ELSE 0 END), '') AS bits, count(*) AS n FROM v GROUP BY ALL")
def one_hot_class(spark, sf_dir):
    rows = _votes(spark, sf_dir).withColumn("bits", F.array_join(one_hot(F.col("cls"), 4), ""))
    return rows.groupBy("family", "cls", "bits").agg(F.count("*").alias("n"))


@query("category_totals", "SELECT source, sum(n_chars)::DOUBLE AS total FROM documents GROUP BY source")
def category_totals(spark, sf_dir):
    """Totals for each group, as the run times of a set of families are summed."""
    return T.load(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").cast("double").alias("total"))
