"""Removal of byte strings that occur more than once, by suffix arrays of shards.

Equal texts are merged first. Winnowing picks anchors: of every STRING bytes, the K-byte
strings with the smallest hash are anchors, so two equal STRING-byte strings have an anchor in
common, at the same place. Around each anchor that occurs at least twice lies its context, which
holds all such strings; equal contexts of an anchor are merged, too. A shard holds all
different contexts of some anchors. Its suffix array, by induced sorting, and the permuted
common prefixes show which STRING-byte strings stand in two contexts of an anchor. An anchor
with too many different contexts for one shard is settled by digests of its strings, spread
over all tasks. Both ways are exact; the texts are shuffled once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import hex_sha256, pieces, scratch, scratch_path, shuffle_partitions, stored
from kinfold.llm.suffix_array import permuted_prefixes, suffix_array

STRING = 200
#: Bytes of an anchor.
K = 100
#: Two contexts with a common string agree on some extension of the anchor in these steps; each has one key for a step.
STEPS = 4
#: Bytes of contexts that one suffix array is made of; one anchor has at most SHARD_CONTEXTS there.
SHARD_BYTES = 1_000_000
SHARD_CONTEXTS = 20_000
#: Bytes of a text whose anchors are found at once.
CHUNK = 1 << 20
#: Stands between contexts; UTF-8 has no such byte.
_END = 0xFE
#: Contexts that a task remembers; one that it has forgotten carries its bytes again.
SEEN = 200_000
#: Rows that a task hands back at once.
ROWS = 50_000
_POWER = 0x9E3779B97F4A7C15

_ANCHORS = "tid binary, at long, anchor long"
_CONTEXTS = "tid binary, at long, anchor long, context binary, lead int, body binary"
_EXTENTS = "anchor long, context binary, low int, high int"


def _window_hashes(raw: np.ndarray) -> np.ndarray:
    """A mixed hash of the K bytes from each position on."""
    h, power, width = raw.astype(np.uint64) + np.uint64(1), np.uint64(_POWER), 1
    with np.errstate(over="ignore"):
        while 2 * width <= K:
            h = h[:-width] * power + h[width:]
            power, width = power * power, 2 * width
        if rest := K - width:  # the second part overlaps with the first
            h = h[:-rest] * power + h[rest:]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, of) -> np.ndarray:
    """of (minimum or maximum) over each width values in a row."""
    done = 1
    out = values
    while 2 * done <= width:
        out = of(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return of(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a text: the smallest of any window of STRING - K + 1 hashes, all if equal."""
    width = STRING - K + 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, max(0, len(raw) - STRING + 1), CHUNK):
        # a window belongs to the chunk in which it starts
        h = _window_hashes(raw[start : start + CHUNK + STRING - 1])
        least = _sliding(h, width, np.minimum)
        top = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        chosen = np.flatnonzero(_sliding(top, width, np.maximum) == h)
        found.append((chosen + start, h[chosen]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, h = (np.concatenate(x) for x in zip(*found, strict=True))
    at, first = np.unique(at, return_index=True)
    return at, h[first]


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(held: list[tuple]) -> pa.RecordBatch:
        at, h = (np.concatenate([x[k] for x in held]) for k in (1, 2))
        tids = pa.array([x[0] for x in held], pa.binary()).take(pa.array(np.repeat(np.arange(len(held)), [len(x[1]) for x in held])))
        return pa.RecordBatch.from_arrays([tids, pa.array(at, pa.int64()), pa.array(h.view(np.int64))], names=["tid", "at", "anchor"])

    held, size = [], 0
    for batch in pieces(batches):
        for tid, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            at, h = anchors(np.frombuffer(body, np.uint8))
            for k in range(0, len(at), ROWS):
                held.append((tid, at[k : k + ROWS], h[k : k + ROWS]))
                size += len(held[-1][1])
                if size >= ROWS:
                    yield packed(held)
                    held, size = [], 0
    if held:
        yield packed(held)


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each repeated anchor of a text; the first in a task with some context, at least, carries its bytes."""
    seen: set[bytes] = set()
    names = [c.split()[0] for c in _CONTEXTS.split(", ")]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    for batch in pieces(batches):
        rows: list[tuple] = []
        tids, texts, every, hashes = batch.columns
        for tid, raw, places, found in zip(tids.to_pylist(), texts.cast(pa.binary()).to_pylist(), every.to_pylist(), hashes.to_pylist(), strict=True):
            for at, anchor in zip(places, found, strict=True):
                low = max(0, at - (STRING - K))
                part = raw[low : at + STRING]
                key = blake2b(part, digest_size=16, salt=(at - low).to_bytes(2, "little")).digest()
                rows.append((tid, at, anchor, key, at - low, None if key in seen else part))
                seen.add(key)
                if len(seen) > SEEN:
                    seen.clear()
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def step_bounds() -> list[int]:
    return [(STRING - K) * i // STEPS for i in range(STEPS + 1)] + [STRING - K + 1]


def keys(body: bytes, lead: int) -> list[tuple[int, bytes]]:
    """Extensions of the anchor, one of which any two contexts with a common string have in common.

    If such contexts agree on l bytes before the anchor and r after it, l + r is STRING - K at
    least. With bounds from 0 to STRING - K in steps, bound i up to l and bound i + 1 above it,
    they agree on bound i before and on all that bound i + 1 leaves after the anchor.
    """
    need, bounds, found = STRING - K, step_bounds(), []
    for i, low in enumerate(bounds[:-1]):
        after = max(0, need - bounds[i + 1] + 1)
        if lead >= low and len(body) - lead - K >= after:
            found.append((i, body[lead - low : lead + K + after]))
    return found


def _with_partner(rows: list[tuple]) -> list[tuple]:
    """The contexts of an anchor that have a key in common with another one."""
    first: dict[tuple[int, bytes], int] = {}
    kept: set[int] = set()
    for k, (_, _, lead, body, _) in enumerate(rows):
        for key in keys(body, lead):
            other = first.setdefault(key, k)
            if other != k:
                kept |= {other, k}
    return [rows[k] for k in sorted(kept)]


def repeated_in_shard(bodies: list[bytes], leads: list[int], owners: list[int]) -> list[tuple[int, int] | None]:
    """Of each context, where its strings that another context of the same owner has begin and end."""
    sizes = np.array([len(b) for b in bodies])
    joined = bytes([_END]).join(bodies) + bytes([_END])
    s = np.append(np.frombuffer(joined, np.uint8) + np.uint8(1), np.uint8(0))
    firsts = np.cumsum(sizes + 1) - (sizes + 1)
    of = np.append(np.repeat(np.arange(len(bodies), dtype=np.int32), sizes + 1), np.int32(len(bodies) - 1))
    offset = np.arange(len(s), dtype=np.int32) - firsts.astype(np.int32)[of]
    room = np.maximum(0, sizes.astype(np.int32)[of] - offset)
    sa = suffix_array(s)
    prefix = permuted_prefixes(s, sa, room, int(sizes.max()))
    run = np.cumsum(prefix[sa] < STRING, dtype=np.int32)
    full = room[sa] >= STRING
    at, run = sa[full], run[full]
    context = of[at]
    place = offset[at] - np.array(leads, np.int32)[context] + 2 * STRING
    key = (run.astype(np.int64) * len(bodies) + np.array(owners)[context]) * (4 * STRING) + place
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(s), bool)
    twice[at[order[np.append(same, False) | np.append(False, same)]]] = True
    # in order of position, the first and the last of each context bound what is repeated
    hits = np.flatnonzero(twice)
    context = of[hits]
    change = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(hits) else hits
    found: list[tuple[int, int] | None] = [None] * len(bodies)
    for k, low, high in zip(context[change].tolist(), offset[hits[change]].tolist(), offset[hits[np.append(change[1:], len(hits)) - 1]].tolist() if len(hits) else [], strict=True):
        found[k] = low, high + STRING
    return found


def _search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: anchor, context, lead, body, copies. Anchors with one context need no suffix array."""
    waiting: list[list[tuple]] = []  # the anchors of the next shard
    group: list[tuple] = []
    size = 0

    def answer(rows: list[tuple], spans: list[tuple[int, int] | None]) -> pa.RecordBatch:
        out = []
        for (anchor, context, lead, body, copies), span in zip(rows, spans, strict=True):
            if copies > 1 and len(body) >= STRING:
                span = (0, len(body))
            if span:
                out.append((anchor, context, span[0] - lead, span[1] - lead))
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32()]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "context", "low", "high"])

    def search() -> pa.RecordBatch:
        rows = [r for g in waiting for r in g]
        owners = [k for k, g in enumerate(waiting) for _ in g]
        waiting.clear()
        return answer(rows, repeated_in_shard([r[3] for r in rows], [r[2] for r in rows], owners))

    alone: list[tuple] = []  # contexts without a partner

    def close() -> int:
        """The group is complete; bytes that it adds to the next shard."""
        nonlocal group
        # contexts with copies are repeated as a whole; only others have to be compared
        pairs = _with_partner(group) if any(r[4] == 1 for r in group) else []
        whole = {r[1] for r in pairs}
        alone.extend(r for r in group if r[1] not in whole)
        if pairs:
            waiting.append(pairs)
        group = []
        return sum(len(r[3]) + 1 for r in pairs)

    for batch in pieces(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and row[0] != group[0][0]:
                size += close()
            group.append(row)
            if size >= SHARD_BYTES:
                yield search()
                size = 0
            if len(alone) >= ROWS:
                yield answer(alone, [None] * len(alone))
                alone = []
    if group:
        close()
    if waiting:
        yield search()
    if alone:
        yield answer(alone, [None] * len(alone))


def _key_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, context, step, key of the keys of each context."""
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary())
    for batch in pieces(batches):
        rows = [(anchor, context, i, blake2b(part, digest_size=16).digest()) for anchor, context, lead, body in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, part in keys(body, lead)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "context", "step", "key"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, context, begin (the string's start less the anchor's), digest of the STRING-byte strings that steps allow."""
    bounds = step_bounds()
    held, begins, digests = [], [], []  # (anchor, context, number of strings), and of each string

    def packed() -> pa.RecordBatch:
        index = pa.array(np.repeat(np.arange(len(held)), [h[2] for h in held]))
        columns = [pa.array([h[0] for h in held], pa.int64()).take(index), pa.array([h[1] for h in held], pa.binary()).take(index), pa.array(begins, pa.int32()), pa.array(digests, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "context", "begin", "digest"])

    for batch in pieces(batches):
        for anchor, context, lead, body, steps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            most = min(lead, STRING - K)
            reach = [before for i in sorted(steps) for before in range(bounds[i], min(bounds[i + 1], most + 1)) if len(body) >= lead - before + STRING]
            held.append((anchor, context, len(reach)))
            begins += [-x for x in reach]
            digests += [blake2b(body[lead - x : lead - x + STRING], digest_size=16).digest() for x in reach]
            if len(begins) >= ROWS:
                yield packed()
                held, begins, digests = [], [], []
    if held:
        yield packed()


def extents(contexts: DataFrame, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """anchor, context, low, high: what is repeated of each context, counted from its anchor; no row if nothing is.

    contexts: anchor, context, lead, body, copies, one row for each different context of an anchor.
    """
    crowded = stored(contexts.groupBy("anchor").count().filter(F.col("count") > shard_contexts).select("anchor"))
    few = contexts.join(crowded, "anchor", "left_anti").select("anchor", "context", "lead", "body", "copies")
    found = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_search_shards, _EXTENTS)
    if crowded.isEmpty():
        return found
    many = contexts.join(crowded, "anchor", "left_semi").select("anchor", "context", "lead", "body", "copies")
    keyed = many.select("anchor", "context", "lead", "body").mapInArrow(_key_digests, "anchor long, context binary, step int, key binary")
    shared = stored(keyed.groupBy("anchor", "step", "key").count().filter("count > 1").drop("count"))
    steps = keyed.join(shared, ["anchor", "step", "key"], "left_semi").groupBy("anchor", "context").agg(F.collect_set("step").alias("steps"))
    strings = many.join(steps, ["anchor", "context"]).select("anchor", "context", "lead", "body", "steps")
    strings = strings.mapInArrow(_strings, "anchor long, context binary, begin int, digest binary")
    twice = stored(strings.groupBy("anchor", "begin", "digest").count().filter("count > 1").drop("count"))
    hits = strings.join(twice, ["anchor", "begin", "digest"], "left_semi")
    spread = hits.groupBy("anchor", "context").agg(F.min("begin").alias("low"), (F.max("begin") + STRING).cast("int").alias("high"))
    whole = many.filter((F.col("copies") > 1) & (F.length("body") >= STRING))
    whole = whole.select("anchor", "context", (-F.col("lead")).alias("low"), (F.length("body") - F.col("lead")).cast("int").alias("high"))
    # a context with copies has all its strings twice
    both = spread.join(whole.select("anchor", "context"), ["anchor", "context"], "left_anti").unionByName(whole)
    return found.unionByName(both)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    for batch in pieces(batches):
        rows = []
        tids, texts, counts, found = batch.columns
        for tid, raw, copies, spans in zip(tids.to_pylist(), texts.cast(pa.binary()).to_pylist(), counts.to_pylist(), found.to_pylist(), strict=True):
            runs, n = [], len(raw)
            if copies > 1 and n >= STRING:
                runs = [[0, n]]
            else:
                for low, high in sorted((s["low"], s["high"]) for s in spans or []):
                    if runs and low <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], high)
                    else:
                        runs.append([low, high])
            kept = b"".join(raw[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), n], strict=True))
            rows.append((tid, n, n - len(kept), len(runs), sha256(kept).hexdigest()))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["tid", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _tid(text):
    return F.substring(F.unhex(hex_sha256(text)), 1, 16)


def _cleaned(texts: DataFrame, shard_contexts: int) -> DataFrame:
    """tid and the result of each different text; texts: tid, body, copies, in buckets of tid."""
    long = texts.filter(F.octet_length("body") >= STRING)
    every = stored(long.select("tid", "body").mapInArrow(_find_anchors, _ANCHORS))
    # written, so that the joins below have two plain exchanges, of which Spark splits the hot parts
    again = stored(every.groupBy("anchor").count().filter("count > 1").select("anchor"))
    places = every.join(again, "anchor", "left_semi").groupBy("tid").agg(F.collect_list(F.struct("at", "anchor")).alias("places"))  # of one text
    cuts = stored(long.select("tid", "body").join(places, "tid").select("tid", "body", F.transform("places", lambda p: p["at"]).alias("at"), F.transform("places", lambda p: p["anchor"]).alias("found")).mapInArrow(_cut_contexts, _CONTEXTS))
    contexts = stored(cuts.groupBy("anchor", "context").agg(F.first("lead").alias("lead"), F.first("body", ignorenulls=True).alias("body"), F.count("*").alias("copies")))
    found = stored(extents(contexts, shard_contexts))
    spans = cuts.select("tid", "at", "anchor", "context").join(found, ["anchor", "context"])
    spans = spans.select("tid", F.struct((F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high")).alias("span"))
    spans = spans.groupBy("tid").agg(F.collect_list("span").alias("spans"))  # of one text
    cleaned = texts.select("tid", "body", "copies").join(spans, "tid", "left").select("tid", "body", "copies", "spans")
    return stored(cleaned.mapInArrow(_remove, "tid binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), keep=True)


def remove_repeated(docs: DataFrame, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text, any others).

    Every byte covered by a 200-byte string that also starts elsewhere, in the same text or in
    another, is removed. A null text counts as empty; texts under 200 bytes stay whole. Repeated
    rows are copies of one another, whatever their doc_id; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("body"))
    texts = rows.groupBy(_tid("body").alias("tid")).agg(F.first("body").alias("body"), F.count("*").alias("copies"))
    name = f"kinfold_texts_{uuid.uuid4().hex}"
    with scratch(spark):
        try:
            # buckets let the texts meet their anchors and spans without another shuffle of them; they stand in the shared folder
            written = texts.write.bucketBy(shuffle_partitions(spark), "tid").option("compression", "zstd")
            written.option("path", scratch_path(spark)).saveAsTable(name)
            cleaned = _cleaned(spark.table(name), shard_contexts)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    return rows.select("doc_id", _tid("body").alias("tid")).join(cleaned, "tid").drop("tid")
