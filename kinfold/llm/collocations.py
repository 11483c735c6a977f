"""Phrase collocations: count-min sketches, then exact counts of what survives them, scores and subsumption.

Each task of the first pass adds the n-grams of its texts to a count-min sketch of fixed size whose
cells saturate at the least count; merged cells tell, by one bit each, whether they reach it. A sketch
never underestimates, so an n-gram with a cell that stays below is rare. Longer n-grams have a sketch
of their own, after that of the shorter ones, which takes in only those whose parts may be frequent: so
rare ones don't fill its cells. The last pass counts what both let through exactly, in Spark's own
aggregation; what they let through in error falls away there.
N-grams are told apart by their words, not by hashes, in both passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import pieces, release, stored

#: Words of the longest phrase.
LONGEST = 5
LEAST_COUNT = 100
#: Phrases that are reported for each language.
TOP = 2000
#: Rows of the sketch, and cells of a row as a power of two. About 4 n-grams / LEAST_COUNT cells make a sketch that
#: lets few rare n-grams through; a smaller one costs time and shuffle in the second pass, never a result.
DEPTH, WIDTH_BITS = 3, 24
#: Lengths of phrases that share a sketch.
STAGES = ((1, 2), (3, LONGEST))
#: Cells that travel together when sketches are merged.
BLOCK_CELLS = 1 << 14
#: Partitions of the scan that share a task, so that a sketch stays small beside its input and counts meet before they are shuffled.
PARTITIONS_A_TASK = 8
#: Counts that a task of the second pass combines before it passes them on.
COMBINE_ROWS = 1 << 20
#: Bytes of text that are counted at once.
CHUNK_BYTES = 2 << 20

#: Between pieces, and between the words of a piece.
_SPLIT, _BLANK = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANK)], _KIND[list(_SPLIT)] = 1, 2
_MORE_WORDS = re.compile(rb"(?:[ \t]*[^ \t.,;:!?\n\x0b\x0c\r]+){0,%d}" % (LONGEST - 1))
_EDGE = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]|\Z")
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FACTOR
    return x ^ (x >> np.uint64(32))


def _chunks(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A text in parts of about CHUNK_BYTES: the part and up to LONGEST - 1 words after it, and how many bytes are the part's own."""
    at = 0
    while True:
        cut = _EDGE.search(text, min(len(text), at + CHUNK_BYTES)).start()
        yield text[at : _MORE_WORDS.match(text, cut).end()], cut - at
        if (at := cut) >= len(text):
            return


@dataclass
class Grams:
    """The different phrases of n words in some texts: hash, count, and where the first of each stands."""

    n: int
    hashes: np.ndarray
    counts: np.ndarray
    first: np.ndarray


class Words:
    """The words of some texts, each with a language. Texts are bytes with A-Z lower-cased."""

    def __init__(self, items: list[tuple[str, bytes, int]]):
        """items: language, text, and the bytes at whose words phrases may start."""
        raw = np.frombuffer(b"\n".join(t for _, t, _ in items), np.uint8)
        sizes = np.array([len(t) + 1 for _, t, _ in items], np.int64)
        begins = np.cumsum(sizes) - sizes
        kind = _KIND[raw]
        inside = kind == 0
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, self.lengths = edges[::2], edges[1::2] - edges[::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
        item = np.searchsorted(begins, starts, "right") - 1
        self.own = starts - begins[item] < np.array([own for *_, own in items], np.int64)[item]
        self.letters = raw[inside]
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.names = sorted({lang for lang, *_ in items})
        self.lang = np.searchsorted(self.names, [lang for lang, *_ in items])[item] if len(starts) else np.zeros(0, np.int64)

    def totals(self) -> list[tuple[str, int]]:
        """Languages and how many words they have."""
        return list(zip(self.names, np.bincount(self.lang[self.own], minlength=len(self.names)).tolist(), strict=True))

    def _single(self) -> tuple[np.ndarray, int, np.ndarray]:
        """A number for each word and language, how many there are, and their hashes."""
        arrow = pa.Array.from_buffers(pa.large_binary(), len(self.lengths), [None, pa.py_buffer(self.offsets.astype(np.int64)), pa.py_buffer(self.letters)])
        coded = arrow.dictionary_encode()
        words = coded.dictionary.to_pylist()
        codes, pairs = pd.factorize(self.lang * len(words) + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        marks = [x.encode() + b" " for x in self.names]
        hashes = np.array([xxhash.xxh64_intdigest(marks[p // len(words)] + words[p % len(words)]) for p in pairs.tolist()], np.uint64)
        return codes, len(pairs), hashes

    def grams(self, passes=None, longest: int = LONGEST) -> Iterator[Grams]:
        """Phrases of 1, 2 .. longest words. passes, if given, tells from n and hashes which can be frequent; the others are left out."""
        if not len(self.lengths):
            return
        words, size, single = self._single()
        at, codes, hashes = np.arange(len(words)), words, single
        for n in range(1, longest + 1):
            if n > 1:
                # a phrase is as rare as its first and its last n - 1 words
                alive = np.full(len(words) + 1, -1, np.int64)
                alive[at] = codes
                at = at[at + n - 1 < len(words)]
                at = at[(alive[at + 1] >= 0) & (self.piece[at] == self.piece[at + n - 1])]
                before = alive[at]
                codes, keys = pd.factorize(before * size + words[at + n - 1])
                hashes = _mix(hashes[keys // size] * _FACTOR + single[keys % size])
            first = np.zeros(len(hashes), np.int64)
            first[codes[::-1]] = at[::-1]
            counts = np.bincount(codes[self.own[at]], minlength=len(hashes))
            good = np.ones(len(hashes), bool) if passes is None else passes(n, hashes)
            shown = good & (counts > 0)
            yield Grams(n, hashes[shown], counts[shown], first[shown])
            if not good.all():
                kept = good[codes]
                at, codes = at[kept], (np.cumsum(good) - 1)[codes[kept]]
                hashes = hashes[good]
            if not len(at):
                return

    def phrases(self, found: Grams) -> pa.Array:
        """The phrases' words joined by blanks."""
        words = (found.first[:, None] + np.arange(found.n)).ravel()
        sizes = self.lengths[words] + 1
        ends = np.cumsum(sizes)
        inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        source = np.repeat(self.offsets[words], sizes) + inner
        out = self.letters[np.minimum(source, len(self.letters) - 1)]
        out[ends - 1] = 0x20
        bounds = np.concatenate([[0], ends[found.n - 1 :: found.n]])
        keep = np.ones(len(out), bool)
        keep[bounds[1:] - 1] = False  # the blank after the last word
        offsets = bounds - np.arange(len(bounds))
        return pa.Array.from_buffers(pa.large_string(), len(found.first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[keep])])


def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The texts of batches (lang, text) as Words of about CHUNK_BYTES each."""
    items, size = [], 0
    for batch in pieces(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part, own in _chunks((text or "").encode().lower()):
                items.append((lang, part, own))
                size += len(part)
                if size >= CHUNK_BYTES:
                    yield Words(items)
                    items, size = [], 0
    if items:
        yield Words(items)


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch."""
    return _mix(hashes + np.uint64((row + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - bits)


def add(sketch: np.ndarray, at: np.ndarray, counts: np.ndarray, least: int) -> None:
    """Add counts at cells of one row; a cell stops at least."""
    shift = np.uint64(int(least).bit_length())
    packed = np.sort((at << shift) | np.minimum(counts, least).astype(np.uint64))
    where = packed >> shift
    starts = np.flatnonzero(np.diff(where, prepend=np.uint64(1 << 63)))
    sums = np.add.reduceat((packed & np.uint64((1 << int(shift)) - 1)).astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    where = where[starts].astype(np.int64)
    sketch[where] = np.minimum(least, sketch[where] + sums)


def sketch(texts: DataFrame, least: int = LEAST_COUNT, depth: int = DEPTH, bits: int = WIDTH_BITS, sizes: tuple[int, int] = (1, LONGEST), passes=None) -> np.ndarray:
    """depth packed bitmaps of 2 ** bits: the cells that reach least. texts: lang, text.

    Phrases of sizes[0] to sizes[1] words count, of which passes, if given, leaves out those with a rare part.

    What the driver collects has this size whatever the texts are. A block of cells meets its
    counterparts of all tasks, BLOCK_CELLS bytes from each.
    """
    kind = np.min_scalar_type(least)
    width, block = 1 << bits, min(BLOCK_CELLS, 1 << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((depth, width), kind)
        for words in words_of(batches):
            for found in words.grams(passes, sizes[1]):
                for k in range(depth if found.n >= sizes[0] else 0):
                    add(rows[k], cells(found.hashes, k, bits), found.counts, least)
        rows = rows.reshape(-1, block)
        used = np.flatnonzero(rows.any(axis=1))
        for k in used.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([rows[k].tobytes()], pa.binary())], names=["block", "cells"])
        del rows
        release()

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(block, np.int64)
        for batch in batches:
            for x in batch.column("cells"):
                total = np.minimum(least, total + np.frombuffer(x.as_buffer(), kind))
        bits_of = np.packbits(total >= least, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bits_of], pa.binary())], names=["block", "cells"])

    parts = texts.mapInArrow(run, "block int, cells binary")
    merged = parts.groupBy("block").applyInArrow(merge, "block int, cells binary")
    found = np.zeros((depth * width // block, block >> 3), np.uint8)
    for r in merged.toLocalIterator():
        found[r["block"]] = np.frombuffer(r["cells"], np.uint8)
    return found.reshape(depth, -1)


def combined(counts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, phrase, f with equal phrases summed, as far as COMBINE_ROWS rows reach."""
    held, size = [], 0
    for batch in counts:
        held.append(batch)
        size += batch.num_rows
        if size >= COMBINE_ROWS:
            held = _summed(held)
            size = sum(x.num_rows for x in held)
            if size > COMBINE_ROWS // 2:
                yield from held
                held, size = [], 0
    if held:
        yield from _summed(held)


def _summed(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    total = pa.Table.from_batches(held).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
    return total.rename_columns(["lang", "phrase", "f"]).combine_chunks().to_batches()


def _passing(shared, depth: int, bits: int, sizes: tuple[int, int], before):
    """Tells which phrases of n words can be frequent: by the broadcast sketch of their length, or by those before; all of a length that has none."""

    def passes(n: int, hashes: np.ndarray) -> np.ndarray:
        good = np.ones(len(hashes), bool)
        if n < sizes[0]:
            return before(n, hashes)
        for k in range(depth if n <= sizes[1] else 0):
            at = cells(hashes, k, bits).astype(np.int64)
            good &= (shared.value[k][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return good

    return passes


def frequent(texts: DataFrame, least: int = LEAST_COUNT, depth: int = DEPTH, bits: int = WIDTH_BITS) -> DataFrame:
    """lang, phrase, f of all phrases of 1 to LONGEST words with f >= least, and the number of all words as the phrase ''. Stored."""
    texts = texts.coalesce(max(texts.sparkSession.sparkContext.defaultParallelism, texts.rdd.getNumPartitions() // PARTITIONS_A_TASK))
    passes = None
    for sizes in STAGES:
        passes = _passing(texts.sparkSession.sparkContext.broadcast(sketch(texts, least, depth, bits, sizes, passes)), depth, bits, sizes, passes)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in words_of(batches):
            totals = words.totals()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in totals], pa.string()), pa.array([""] * len(totals), pa.string()), pa.array([n for _, n in totals], pa.int64())], names=["lang", "phrase", "f"])
            for found in words.grams(passes):
                if len(found.first):
                    langs = pa.array(words.names, pa.string()).take(pa.array(words.lang[found.first]))
                    yield pa.RecordBatch.from_arrays([langs, words.phrases(found).cast(pa.string()), pa.array(found.counts, pa.int64())], names=["lang", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from combined(counted(batches))
        release()

    counts = texts.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return stored(counts.filter((F.col("f") >= least) | (F.col("phrase") == "")))


def _part(words: str, begin: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, begin, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of each phrase of two words or more, at its lowest-scoring cut."""
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    parts = counts.filter("phrase <> ''")
    totals = counts.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    many = parts.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words")).filter(F.size("words") > 1)
    cuts = many.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part("words", F.lit(1), F.col("k")).alias("left"), _part("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    of = lambda side, f: parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(totals, "lang")
    cuts = cuts.withColumns({"x": exact("a") * F.lit(1000).cast("decimal(4,0)") * exact("n"), "y": exact("l") * exact("r")})
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("x div y").alias("score"), "k", "l", "r", "a", "n")).alias("best"))
    return best.select("lang", "phrase", F.split("phrase", " ").alias("words"), "best.a", "best.l", "best.r", "best.n", "best.score")


def subsumed(candidates: DataFrame, percent: int = 100) -> DataFrame:
    """lang, phrase of candidates that stand inside a longer one which has at least percent of their count."""
    size = F.size("words")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda k: F.array_join(F.slice("words", k, n), " "))))
    inner = candidates.filter(size > 2).select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(spans)).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return candidates.join(most, ["lang", "phrase"]).filter(100 * F.col("longer") >= percent * F.col("a")).select("lang", "phrase")


#: Lots of a language's phrases that are ranked apart, before the best of all lots are ranked together.
LOTS = 64


def collocations(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP, percent: int = 100, bits: int = WIDTH_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language of docs (text, lang, any others).

    Phrases have 2 to LONGEST words and occur at least least times within pieces of text between
    . , ; : ! ? and line ends. A null text counts as empty, a null language as "und"; repeated rows
    and ids count each time; an empty table, or one without frequent phrases, gives no row. Equal
    scores are ordered by count, then by the phrase's bytes.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    candidates = stored(scored(frequent(texts, least, DEPTH, bits)))
    kept = candidates.join(subsumed(candidates, percent), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    lot = kept.withColumn("lot", F.pmod(F.xxhash64("phrase"), F.lit(LOTS)))
    lot = lot.withColumn("place", F.row_number().over(Window.partitionBy("lang", "lot").orderBy(*order))).filter(F.col("place") <= top)
    ranked = lot.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
