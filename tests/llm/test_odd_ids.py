"""Rows that share a null or repeated doc_id are merged only if their texts are equal."""

from kinfold.llm import exact_dedup


def test_exact_dedup_keeps_different_texts_of_an_id(spark):
    rows = [(None, "a"), (None, "b"), (1, "c"), (1, "d"), (1, "d"), (2, "d e"), (3, " de"), (1, "d e f"), (0, "def")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(str, (tuple(r) for r in exact_dedup.keep_one(docs).collect())))
    assert kept == sorted(map(str, [(None, "a"), (None, "b"), (1, "c"), (1, "d"), (2, "d e"), (1, "d e f")]))
