"""Queries over pairs, distances and sparse posteriors."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions.logspace import best_of_three, focal_loss, log_add
from kinfold.functions.model import ScoreMatrix
from kinfold.operators import pairs, sparse
from kinfold.operators.nearest import nearest_vectors
from kinfold.plans.registry import query
from kinfold.plans.sequence_queries import _BENCH
from kinfold.sources import tables as T

_PAIRS = f"""{_BENCH},
    p AS (SELECT x.family, x.label AS a, y.label AS b, x.residues AS ra, y.residues AS rb
          FROM b x JOIN b y ON x.family = y.family AND x.label < y.label)"""
_DERIVED = f"""{_BENCH},
    r AS (SELECT family, label, k AS at, residues[k] AS x FROM (SELECT *, unnest(range(1, length(residues) + 1)) AS k FROM b)),
    d AS (SELECT u.family, u.label AS a, v.label AS b, u.at AS i, v.at AS j,
                 CASE WHEN u.x = v.x THEN 0.5 ELSE 0.1 / (1 + abs(u.at - v.at)) END::DOUBLE AS p
          FROM r u JOIN r v ON u.family = v.family AND u.label < v.label),
    c AS (SELECT * FROM d WHERE p >= {T.LEAST_CELL})"""
_BOTH = f"{_DERIVED}, s AS (SELECT * FROM c UNION ALL SELECT family, b, a, j, i, p FROM c)"
_MATRIX = ", ".join(f"('{x}', '{y}', {s})" for x, y, s in ScoreMatrix.by_groups().rows())


def _rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 9))
    return df


def _ids(df):
    """Indexes as long, as SQL has them."""
    return df.select(*[F.col(c).cast("long").alias(c) if c in ("i", "j", "c1", "c2") else F.col(c) for c in df.columns])


@query("pair_enumeration", f"WITH {_PAIRS} SELECT family, a, b, length(ra) AS len_a, length(rb) AS len_b FROM p")
def pair_enumeration(spark, sf_dir):
    found = pairs.all_pairs(T.benchmark_sequences(spark, sf_dir))
    return found.select("family", "a", "b", F.col("len_a").cast("long").alias("len_a"), F.col("len_b").cast("long").alias("len_b"))


@query(
    "pair_with_self",
    f"""WITH {_BENCH}, n AS (SELECT family, count(*) AS n FROM b GROUP BY family)
    SELECT x.family, x.label AS a, y.label AS b FROM b x JOIN b y ON x.family = y.family AND x.label <= y.label JOIN n ON n.family = x.family WHERE x.label < n.n - 1""",
)
def pair_with_self(spark, sf_dir):
    return pairs.classifier_pairs(T.benchmark_sequences(spark, sf_dir)).select("family", "a", "b")


@query("pair_across_groups", f"WITH {_PAIRS} SELECT family, a, b FROM p WHERE a % 2 <> b % 2")
def pair_across_groups(spark, sf_dir):
    rows = T.benchmark_sequences(spark, sf_dir)
    return pairs.group_pairs(rows, rows.select("family", "label", (F.col("label") % 2 + 1).alias("side"))).select("family", "a", "b")


@query(
    "pair_identity",
    f"""WITH {_PAIRS}
    SELECT family, a, b, round(len(list_filter(range(1, least(length(ra), length(rb)) + 1), lambda k: ra[k] = rb[k])) / least(length(ra), length(rb)), 9) AS identity FROM p""",
)
def pair_identity(spark, sf_dir):
    found = pairs.all_pairs(T.benchmark_sequences(spark, sf_dir))
    return _rounded(found.select("family", "a", "b", pairs.positional_identity(F.col("res_a"), F.col("res_b")).alias("identity")), "identity")


@query(
    "pair_score",
    f"""WITH {_PAIRS}, m(x, y, s) AS (VALUES {_MATRIX}),
    k AS (SELECT family, a, b, ra[k] AS x, rb[k] AS y FROM (SELECT *, unnest(range(1, least(length(ra), length(rb)) + 1)) AS k FROM p))
    SELECT family, a, b, CAST(sum(coalesce(s, 0)) AS DOUBLE) AS score, count(*) AS columns FROM k LEFT JOIN m USING (x, y) GROUP BY family, a, b""",
)
def pair_score(spark, sf_dir):
    found = pairs.all_pairs(T.benchmark_sequences(spark, sf_dir))
    return pairs.positional_scores(found, pairs.matrix_frame(spark, ScoreMatrix.by_groups()))


@query(
    "nearest_pair",
    """
    WITH d AS (
        SELECT CAST(x.label AS VARCHAR) AS family, x.vec_id AS a, y.vec_id AS b,
               round(sqrt(list_sum(list_transform(range(1, 65), lambda k: (x.embedding[k]::DOUBLE - y.embedding[k]::DOUBLE) ** 2))), 6) AS d
        FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id)
    SELECT family, m.a AS a, m.b AS b, m.d AS d FROM (SELECT family, min({'d': d, 'a': a, 'b': b}) AS m FROM d GROUP BY family)""",
)
def nearest_pair(spark, sf_dir):
    rows = T.load(spark, sf_dir, "embeddings")
    return nearest_vectors(rows.select(F.col("label").cast("string").alias("family"), F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("e")))


@query("sparse_threshold", f"WITH {_DERIVED} SELECT family, a, b, i, j, round(p, 9) AS p FROM c WHERE p >= 0.05")
def sparse_threshold(spark, sf_dir):
    return _ids(_rounded(sparse.sparsify(T.derived_cells(spark, sf_dir), 0.05), "p"))


@query("sparse_transpose", f"WITH {_DERIVED} SELECT family, b AS a, a AS b, j AS i, i AS j, round(p, 9) AS p FROM c")
def sparse_transpose(spark, sf_dir):
    return _ids(_rounded(sparse.transpose(T.derived_cells(spark, sf_dir)), "p"))


@query("sparse_lookup", f"WITH {_DERIVED} SELECT family, a, b, i, j, CASE WHEN p >= 0.05 THEN round(p, 9) ELSE 0 END AS p FROM c")
def sparse_lookup(spark, sf_dir):
    cells = T.derived_cells(spark, sf_dir)
    return _ids(_rounded(sparse.lookup(sparse.sparsify(cells, 0.05), cells.drop("p")), "p"))


@query(
    "sparse_dense",
    f"""WITH {_DERIVED},
    g AS (SELECT u.family, u.label AS a, v.label AS b, u.at AS i, v.at AS j FROM r u JOIN r v ON u.family = v.family AND u.label < v.label)
    SELECT family, a, b, i, count(*) AS columns, count(p) AS cells, round(sum(coalesce(p, 0)), 9) AS p, round(sum(coalesce(p, 0) * j), 6) AS pj
    FROM g LEFT JOIN c USING (family, a, b, i, j) GROUP BY ALL""",
)
def sparse_dense(spark, sf_dir):
    """The rows of the dense matrices of whole sequences, each summed up."""
    cells = T.derived_cells(spark, sf_dir)
    found = sparse.dense(cells, pairs.all_pairs(T.benchmark_sequences(spark, sf_dir)))
    sums = [F.count("*").alias("columns"), F.count_if(F.col("p") > 0).alias("cells"), F.round(F.sum("p"), 9).alias("p"), F.round(F.sum(F.col("p") * F.col("j")), 6).alias("pj")]
    return _ids(found.groupBy("family", "a", "b", "i").agg(*sums))


def _consistency_sql(weight: str, self_term: str, size: str) -> str:
    return f"""WITH {_BOTH},
    n AS (SELECT family, count(*) AS n, sum(100 + 10 * label) AS w FROM b GROUP BY family),
    z AS (SELECT u.family, u.a AS a, v.b AS b, u.i AS i, v.j AS j, sum(u.p * v.p * {weight}) AS s
          FROM s u JOIN s v ON u.family = v.family AND u.b = v.a AND u.j = v.i AND u.a < v.b GROUP BY ALL)
    SELECT * FROM (
        SELECT c.family, c.a, c.b, c.i, c.j, round(({self_term} * c.p + coalesce(z.s, 0)) / n.{size}, 9) AS p
        FROM c JOIN n USING (family) LEFT JOIN z USING (family, a, b, i, j)) WHERE p >= 0.01"""


@query("consistency_unweighted", _consistency_sql("1", "2", "n"))
def consistency_unweighted(spark, sf_dir):
    return _ids(_rounded(sparse.consistency(T.derived_cells(spark, sf_dir), T.benchmark_sequences(spark, sf_dir)), "p"))


@query("consistency_weighted", _consistency_sql("(100 + 10 * u.b)", "(200 + 10 * c.a + 10 * c.b)", "w"))
def consistency_weighted(spark, sf_dir):
    rows = T.benchmark_sequences(spark, sf_dir)
    return _ids(_rounded(sparse.consistency(T.derived_cells(spark, sf_dir), rows, T.label_weights(rows)), "p"))


def _profile_sql(value: str) -> str:
    return f"""WITH {_BOTH},
    w AS (SELECT family, max(length(residues)) AS width FROM b GROUP BY family),
    k AS (SELECT family, label, col, row_number() OVER (PARTITION BY family, label ORDER BY col) AS residue
          FROM (SELECT *, unnest(range(1, length(residues) + 1)) AS col FROM b) WHERE (col - 1 + label) % 5 <> 0)
    SELECT s.family, x.col AS c1, y.col AS c2, round(sum({value}), 9) AS p
    FROM s JOIN k x ON x.family = s.family AND x.label = s.a AND x.residue = s.i AND x.label < 2
           JOIN k y ON y.family = s.family AND y.label = s.b AND y.residue = s.j AND y.label >= 2
    GROUP BY ALL"""


def _profile(spark, sf_dir, weighted):
    from kinfold.operators.alignment import residue_columns

    columns = residue_columns(T.derived_alignment(spark, sf_dir)).withColumn("side", F.when(F.col("label") < 2, 1).otherwise(2))
    weights = T.label_weights(T.benchmark_sequences(spark, sf_dir)) if weighted else None
    return _ids(_rounded(sparse.profile_posterior(T.derived_cells(spark, sf_dir), columns, weights), "p"))


@query("profile_posterior", _profile_sql("s.p"))
def profile_posterior(spark, sf_dir):
    return _profile(spark, sf_dir, False)


@query("profile_posterior_weighted", _profile_sql("s.p * (100 + 10 * s.a) * (100 + 10 * s.b) / ((100 + 110) * (120 + 130))"))
def profile_posterior_weighted(spark, sf_dir):
    return _profile(spark, sf_dir, True)


@query("rms_combine", f"WITH {_DERIVED} SELECT family, a, b, i, j, round(sqrt((p * p + CASE WHEN p >= 0.05 THEN 4 * p * p ELSE 0 END) / 2), 9) AS p FROM c")
def rms_combine(spark, sf_dir):
    cells = T.derived_cells(spark, sf_dir)
    return _ids(_rounded(sparse.rms(cells, sparse.sparsify(cells, 0.05).withColumn("p", 2 * F.col("p"))), "p"))


@query("logsumexp", "SELECT event_id, round(ln(exp(v) + exp(v / 2) + exp(-v)), 9) AS total FROM (SELECT event_id, value / (1 + abs(value)) AS v FROM events)")
def logsumexp(spark, sf_dir):
    events = T.load(spark, sf_dir, "events").select("event_id", (F.col("value") / (1 + F.abs("value"))).alias("v"))
    return _rounded(events.select("event_id", log_add(F.col("v"), F.col("v") / 2, -F.col("v")).alias("total")), "total")


@query("best_of_three", "SELECT event_id, CASE WHEN x >= y AND x >= z THEN 'D' WHEN y >= z THEN 'L' ELSE 'U' END AS step FROM (SELECT event_id, event_id % 5 AS x, user_id % 5 AS y, event_id % 3 AS z FROM events)")
def best_of_three_(spark, sf_dir):
    e = T.load(spark, sf_dir, "events")
    return e.select("event_id", best_of_three(F.col("event_id") % 5, F.col("user_id") % 5, F.col("event_id") % 3).alias("step"))


@query("focal_loss", "SELECT doc_id, round(-[2, 3, 2, 1][c + 1] * (1 - q) ** 2 * ln(q), 9) AS loss FROM (SELECT doc_id, quality + 2 * toxic AS c, least(1 - 1e-7, greatest(1e-7, (doc_id % 101) / 100)) AS q FROM labels)")
def focal_loss_(spark, sf_dir):
    rows = T.load(spark, sf_dir, "labels")
    return _rounded(rows.select("doc_id", focal_loss((F.col("doc_id") % 101) / 100, F.col("quality") + 2 * F.col("toxic")).alias("loss")), "loss")
