"""Exact deduplication by content sort.

Each input batch is reduced to one row per distinct normalised text. The rows are
range-partitioned by sampled splitters of (first bytes, digest of the whole text), so that
texts with a common beginning still spread; Spark's external sort places equal texts next
to each other, and neighbours are compared in full, byte by byte. The rows of a hot group
that reach one task are at most one per input batch, never one per copy.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import WHITE_SPACE, hex_sha256, packed, pieces, restrict, unpacked

#: Bytes of a text that lead its sort key; the digest of the whole text follows.
HEAD_BYTES = 32

_REDUCED = "head binary, digest binary, content binary, n_chars long, keep_id long, copies long"
_GROUPS = "digest binary, n_bytes long, keep_id long, group_size long"
_MEMBERS = "doc_id long, digest binary, n_bytes long, n_chars long"


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, WHITE_SPACE)


def _better(n_chars: int, doc_id: int | None, than: tuple[int, int | None]) -> bool:
    """More code points first, then the smaller identifier; a null identifier comes last."""
    return (-n_chars, doc_id is None, doc_id or 0) < (-than[0], than[1] is None, than[1] or 0)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int | None, str | None]]:
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        best: dict[bytes, list] = {}
        for doc_id, text in _rows(batch):
            content, n_chars = normalised(text), len(text or "")
            entry = best.get(content)
            if entry is None:
                best[content] = [n_chars, doc_id, 1]
                continue
            entry[2] += 1
            if _better(n_chars, doc_id, (entry[0], entry[1])):
                entry[:2] = n_chars, doc_id
        contents, entries = list(best), list(best.values())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([c[:HEAD_BYTES] for c in contents], pa.binary()),
                pa.array([sha256(c).digest() for c in contents], pa.binary()),
                pa.array(contents, pa.binary()),
                pa.array([e[0] for e in entries], pa.int64()),
                pa.array([e[1] for e in entries], pa.int64()),
                pa.array([e[2] for e in entries], pa.int64()),
            ],
            names=["head", "digest", "content", "n_chars", "keep_id", "copies"],
        )


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in sorted order; the group that a batch ends in is carried to the next batch."""
    open_group: list | None = None  # digest, content, n_chars, keep_id, copies

    def emit(groups: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([g[0] for g in groups], pa.binary()),
                pa.array([len(g[1]) for g in groups], pa.int64()),
                pa.array([g[3] for g in groups], pa.int64()),
                pa.array([g[4] for g in groups], pa.int64()),
            ],
            names=["digest", "n_bytes", "keep_id", "group_size"],
        )

    for batch in pieces(batches):
        closed = []
        for digest, content, n_chars, keep_id, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if open_group is not None and open_group[1] == content:
                open_group[4] += copies
                if _better(n_chars, keep_id, (open_group[2], open_group[3])):
                    open_group[2:4] = n_chars, keep_id
                continue
            if open_group is not None:
                closed.append(open_group)
            open_group = [digest, content, n_chars, keep_id, copies]
        yield emit(closed)
    if open_group is not None:
        yield emit([open_group])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts = batch.column(1).to_pylist()
        contents = [normalised(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()),
                pa.array([sha256(c).digest() for c in contents], pa.binary()),
                pa.array([len(c) for c in contents], pa.int64()),
                pa.array([len(t or "") for t in texts], pa.int64()),
            ],
            names=["doc_id", "digest", "n_bytes", "n_chars"],
        )


def groups(docs: DataFrame) -> DataFrame:
    """One row per distinct normalised text: digest, n_bytes, keep_id, group_size."""
    return (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .mapInArrow(_reduce, _REDUCED)
        .repartitionByRange("head", "digest")
        .sortWithinPartitions("head", "digest", "content")
        .select("digest", "content", "n_chars", "keep_id", "copies")
        .mapInArrow(_compare_neighbours, _GROUPS)
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Judge every row of docs (doc_id, text, any others).

    Returns doc_id, keep_id, group_size, kept, text_sha256 for every row. A null text counts
    as empty. Of equal texts the one with the most code points stays, of those the smallest
    doc_id, a null doc_id last. Repeated rows with one doc_id are each returned and share
    the verdict of their doc_id; an empty table gives an empty result.
    """
    members = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_digests, _MEMBERS)
    return members.join(groups(docs), ["digest", "n_bytes"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any others) without the rows that exact_dedup drops.

    Of rows that share doc_id and normalised text, null or not, one stays: that with the most code
    points, of those the first in the order of texts; other columns don't matter. Rows that share a
    doc_id alone are judged each by its text. Columns may have any names. An empty table gives an
    empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    content = F.translate(text, WHITE_SPACE.decode(), "")
    key = lambda digest: F.struct(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"))
    rows = packed(docs, key=key(hex_sha256(content)), order=F.struct((-F.length(text)).alias("size"), hex_sha256(text).alias("digest")))
    return unpacked(restrict(rows, exact_dedup(docs).filter("kept").select(key(F.col("text_sha256")).alias("key")), F.col("order")))
