"""The quality classifier: statistics by plain counting, rules against plain evaluation, accuracy on held-out rows."""

import math
import random
import zlib

import pytest

from kinfold.llm import quality as Q

DOCS = "doc_id long, text string, size string, label string"


def text_of(rng, good):
    words = ["the", "And", "of", "sing", "thing", "reading", "Other", "was", "in", "est"]
    found = [rng.choice(words) + rng.choice(["", "", ".", ","]) for _ in range(rng.randrange(20, 80))]
    if not good:
        found = [w.upper() + "!!" for w in found] if rng.random() < 0.5 else [rng.choice("#$%&") * 3 + w for w in found]
    return " ".join(found)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    labels = [(k, rng.random() < 0.8) for k in range(600)]
    docs = [(k, text_of(rng, good), "x", "y") for k, good in labels] + [(None, "A text.", "", ""), (9001, None, None, None), (9002, "", "", ""), (5, "again", "", ""), (9003, "w" * 300_000, "", "")]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([(k, int(g), "z") for k, g in labels], "doc_id long, quality int, text string"), dict(labels)


def test_held_out_accuracy(tables):
    docs, labels, truth = tables
    rows = Q.classify(docs, labels).collect()
    assert len(rows) == 605 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(out) > 80 and sum(r["predicted"] == truth[r["doc_id"]] for r in out) / len(out) > 0.97
    assert {c: k for c, k in Q.classify(docs, labels).dtypes} == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}


def test_rules_as_columns(spark, tables):
    docs, labels, _ = tables
    made = Q.statistics(docs)
    ensemble = Q.fit(Q.training_rows(made, labels))
    assert ensemble.rules and Q.Ensemble.from_json(ensemble.to_json()) == ensemble
    for r in made.withColumn("score", ensemble.score()).collect():
        fires = [w for rule, w in ensemble.rules if all(r[c] > x for c, x in rule.above) and all(r[c] <= x for c, x in rule.below)]
        assert math.isclose(r["score"], 1 / (1 + math.exp(-ensemble.intercept - sum(fires))), rel_tol=1e-9)
    rule = Q.Rule().also("size", 3.0, True).also("size", 2.0, True).also("upper", 0.5, False).also("upper", 0.4, False)
    assert rule == Q.Rule((("size", 3.0),), (("upper", 0.4),))


def test_no_label_of_a_held_out_row_is_learned(tables):
    docs, labels, _ = tables
    made = Q.statistics(docs)
    flipped = labels.withColumn("quality", Q.F.when(Q.held_out(Q.F.col("doc_id")), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    ordered = lambda x: sorted(map(tuple, Q.training_rows(made, x).collect()))
    assert ordered(labels) == ordered(flipped)


def test_statistics():
    s = dict(zip(Q.STATISTICS, Q.statistics_of("Ab 12 AB AB\n\nx#! é.\nx#! é."), strict=True))
    n = len("Ab 12 AB AB\n\nx#! é.\nx#! é.".encode())
    assert s["size"] == math.log1p(n) and s["digits"] == 2 / n and s["symbols"] == 2 / n and s["exclaims"] == 2 / n and s["breaks"] == 3 / n
    assert s["odd_words"] == 2 / 8 and s["loud_words"] == 2 / 8 and s["repeats"] == 1 / 7 and s["distinct_words"] == 5 / 8 and s["top_word"] == 2 / 8
    assert s["distinct_lines"] == 2 / 3 and s["distinct_runs"] == 1.0 and s["longest_word"] == math.log1p(3)
    runs = Q.STATISTICS.index("distinct_runs")
    assert Q.statistics_of("a b c d e " * 40)[runs] == 5 / 196
    assert Q.statistics_of(None) == Q.statistics_of("") == [0.0] * len(Q.STATISTICS)
    assert len(Q.statistics_of(" \n ")) == len(Q.STATISTICS) and len(Q.statistics_of("퟿" * 5000)) == len(Q.STATISTICS)


def test_labels_of_one_kind_and_empty_tables(spark, tables):
    docs, labels, _ = tables
    ones = Q.classify(docs, labels.filter("quality = 1")).select("score").distinct().collect()
    assert len(ones) == 1 and ones[0]["score"] > 0.99
    none = Q.classify(docs.limit(3), labels.filter("quality IS NULL")).collect()
    assert len(none) == 3 and {r["score"] for r in none} == {0.5}
    assert Q.classify(docs.filter("false"), labels).count() == 0
    both = spark.createDataFrame([(1, 1, ""), (1, 0, ""), (1, None, ""), (None, 0, ""), (2, 0, ""), (2, 0, ""), (2, 1, "")], "doc_id long, quality int, text string")
    assert sorted(r["label"] for r in Q.training_rows(Q.statistics(docs), both).collect()) == [0.0, 1.0]
