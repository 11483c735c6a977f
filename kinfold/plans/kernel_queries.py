"""Queries of the sequential kernels: posteriors, trees, alignments, features, training."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from kinfold.functions import udfs
from kinfold.functions.residues import TOKENS
from kinfold.operators import align as A
from kinfold.operators import classify as C
from kinfold.operators import network as N
from kinfold.operators.pairs import all_pairs
from kinfold.plans import kernel_sql as K
from kinfold.plans.pair_queries import _PAIRS
from kinfold.plans.registry import query
from kinfold.sources import tables as T
from kinfold.sources.parameters import feature_text
from kinfold.sources.shared import stored


def _pairs(spark, sf_dir):
    return all_pairs(T.benchmark_sequences(spark, sf_dir))


@query("align_family")
def align_family(spark, sf_dir):
    """Final alignments of the families of the benchmark table, all models combined."""
    return A.align(T.benchmark_sequences(spark, sf_dir))


@query("align_weighted")
def align_weighted(spark, sf_dir):
    """The same with the partition function alone, a weighted tree and weighted consistency."""
    return A.align(T.benchmark_sequences(spark, sf_dir), (1, 1, 1))


def _rounded(df, column):
    return df.withColumn(column, F.round(column, 6))


@query("pair_distance", K.distance_sql(K.hmm_posterior()))
def pair_distance(spark, sf_dir):
    return _rounded(A.score_pairs(_pairs(spark, sf_dir), s1=0).select("family", "a", "b", "d"), "d")


@query("partition_distance", K.distance_sql(K.partition_posterior()))
def partition_distance(spark, sf_dir):
    return _rounded(A.score_pairs(_pairs(spark, sf_dir), s1=1).select("family", "a", "b", "d"), "d")


@query("posterior_hmm", K.cells_sql(K.hmm_posterior()))
def posterior_hmm(spark, sf_dir):
    return _rounded(A.cells_of(A.score_pairs(_pairs(spark, sf_dir), s1=0)), "p")


@query("posterior_partition", K.cells_sql(K.partition_posterior()))
def posterior_partition(spark, sf_dir):
    return _rounded(A.cells_of(A.score_pairs(_pairs(spark, sf_dir), s1=1)), "p")


@query("linkage_tree", K.tree_sql("tree"))
def linkage_tree(spark, sf_dir):
    """Trees by the distances of the partition function, rounded as in partition_distance."""
    return _rounded(A.trees(partition_distance(spark, sf_dir), T.benchmark_sequences(spark, sf_dir)), "dist")


@query("plain_linkage_tree", K.tree_sql("tree", plain=True))
def plain_linkage_tree(spark, sf_dir):
    """The same with plain means of distances."""
    return _rounded(A.trees(partition_distance(spark, sf_dir), T.benchmark_sequences(spark, sf_dir), 1), "dist")


@query("seq_weights", K.tree_sql("weights"))
def seq_weights(spark, sf_dir):
    return A.sequence_weights(linkage_tree(spark, sf_dir))


@query("merge_schedule", K.tree_sql("merges"))
def merge_schedule(spark, sf_dir):
    """Merges of the guide trees; the leaves of each side joined by blanks."""
    found = A.merge_schedules(linkage_tree(spark, sf_dir))
    for side in ("left_leaves", "right_leaves"):
        found = found.withColumn(side, F.array_join(F.transform(side, lambda x: x.cast("string")), " "))
    return found


_EACH = ("identity", "emission", "score")


@query("pair_features", K.viterbi_sql("SELECT family, a, b, path_len, path, pair, " + ", ".join(f"round({c}, 6) AS {c}" for c in _EACH) + " FROM named"))
def pair_features(spark, sf_dir):
    found = A.pair_features(_pairs(spark, sf_dir))
    for c in _EACH:
        found = _rounded(found, c)
    return found


@query("pair_feature_text", K.viterbi_sql("SELECT family, a, b, printf('%d, %s, %s, %.6f, %.6f, %.6f;', path_len, path, pair, identity, emission, score) AS record FROM named"))
def pair_feature_text(spark, sf_dir):
    return feature_text(A.pair_features(_pairs(spark, sf_dir)))


@query("family_features", K.viterbi_sql("SELECT family, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}, round(stddev_pop({c}), 6) AS sd_{c}" for c in _EACH) + " FROM named GROUP BY family"))
def family_features(spark, sf_dir):
    found = A.family_features(A.pair_features(_pairs(spark, sf_dir)))
    for c in found.columns[1:]:
        found = _rounded(found, c)
    return found


@query("em_counts", K.expected_counts_sql())
def em_counts(spark, sf_dir):
    return _rounded(A.expected_parameters(_pairs(spark, sf_dir)), "value")


EM_STEPS = 4


@query("em_trace")
def em_trace(spark, sf_dir):
    """Log probabilities of the benchmark families under the first EM_STEPS models of training, and the models' gap probabilities."""
    done = A.train(T.benchmark_sequences(spark, sf_dir), steps=EM_STEPS)
    gaps = [(m.gap_open[0], m.gap_open[2], m.gap_extend[0], m.gap_extend[2]) for m in done.models]
    rows = [(k, round(log, 6), *(round(x, 9) for x in g)) for k, (log, g) in enumerate(zip(done.logs, gaps, strict=False))]
    return spark.createDataFrame(rows, "step int, log_probability double, open_1 double, open_2 double, longer_1 double, longer_2 double")


@query("family_times", f"WITH {_PAIRS} SELECT family, count(*) AS pairs, CAST(sum(length(ra) * length(rb)) AS BIGINT) AS cells, true AS timed FROM p GROUP BY family")
def family_times(spark, sf_dir):
    """Pairs and cells of each family, and whether its kernels took time by the workers' clocks, no more than the whole run did."""
    pairs, began = _pairs(spark, sf_dir), time.perf_counter()
    sizes = pairs.groupBy("family").agg(F.count("*").alias("pairs"), F.sum(F.col("len_a").cast("long") * F.col("len_b")).alias("cells"))
    seconds = stored(A.score_pairs(pairs, s1=1, timed=True).groupBy("family").agg(F.sum("seconds").alias("seconds")))
    most = (time.perf_counter() - began) * spark.sparkContext.defaultParallelism
    return sizes.join(seconds, "family").select("family", "pairs", "cells", F.col("seconds").between(1e-9, most).alias("timed"))


#: Epochs of the query's network.
NETWORK_EPOCHS = 8


@query("classify_strategy")
def classify_strategy(spark, sf_dir):
    """Strategies by a network fitted on the length classes of the pairs."""
    pairs = _pairs(spark, sf_dir)
    cls = F.least(F.lit(3), F.floor(F.abs(F.col("len_a") - F.col("len_b")) / 30)).cast("int")
    network = N.train(pairs.select("res_a", "res_b", cls.alias("cls")), epochs=NETWORK_EPOCHS)
    return C.strategies(T.benchmark_sequences(spark, sf_dir), network)


@query(
    "classifier_input",
    f"""WITH {_PAIRS},
    t AS (SELECT family, a, b, list_filter(list_transform(string_split(ra || '-' || rb, ''), lambda x: instr('{TOKENS}', x)), lambda k: k > 0) AS x FROM p)
    SELECT family, a, b, array_to_string(list_concat(list_transform(range(greatest(0, 512 - len(x))), lambda k: 0), x[greatest(1, len(x) - 511):]), ' ') AS x FROM t""",
)
def classifier_input(spark, sf_dir):
    return C.encoded(_pairs(spark, sf_dir)).select("family", "a", "b", F.array_join("x", " ").alias("x"))


@query("udf_identity", f"WITH {_PAIRS} SELECT family, a, b, round(len(list_filter(range(1, least(length(ra), length(rb)) + 1), lambda k: ra[k] = rb[k])) / least(length(ra), length(rb)), 9) AS identity, round(ln(exp(a) + exp(b)), 9) AS total FROM p")
def udf_identity(spark, sf_dir):
    """The registered functions pair_identity and log_add, from SQL."""
    udfs.register(spark)
    return _pairs(spark, sf_dir).selectExpr("family", "a", "b", "round(pair_identity(res_a, res_b), 9) AS identity", "round(log_add(cast(a AS double), cast(b AS double)), 9) AS total")


@query("udtf_posterior", K.cells_sql(K.partition_posterior()))
def udtf_posterior(spark, sf_dir):
    """posterior_partition by the table function posterior_cells, from SQL."""
    udfs.register(spark)
    return spark.sql("SELECT family, a, b, i, j, round(p, 6) AS p FROM {pairs}, LATERAL posterior_cells(res_a, res_b, 1)", pairs=_pairs(spark, sf_dir))
