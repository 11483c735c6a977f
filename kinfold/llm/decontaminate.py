"""Benchmark decontamination by spaced seeds.

Fixed masks pick some tokens of a window and ignore the others, so a hash of the picked ones
survives substitutions at the ignored places. Wherever the allowed substitutions of a window or
of a whole shorter item are, some mask at some place ignores them all. The hashes of all windows of the training texts
are looked up among those of the benchmark items; around each hit the text and the item are
aligned and the overlap is verified token by token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import pieces, slices

#: 1: the token counts, 0: it is ignored.
MASKS = ("1101100101", "1010011011", "1110010011", "1100111001")
SPAN = 10
#: An overlap is a window of so many aligned tokens of which this share agrees; shorter items must do so as a whole.
WINDOW = 13
SHARE = 0.8
#: Items of fewer tokens are not looked for.
LEAST_TOKENS = 1
#: Characters of benchmark items that are broadcast at once; a larger benchmark takes a pass for each block.
BLOCK_CHARS = 4_000_000
#: Bytes of text that are turned into tokens at once.
CHUNK_BYTES = 1 << 21

_HITS = "doc_id long, item_id long, start_token long, matched long, window long, item_tokens long"
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_POWERS = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64))
_FACTORS = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hash_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of raw."""
    inside = _WORD[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.flatnonzero(inside)
    lengths = stops - starts
    first = np.cumsum(lengths) - lengths
    place = (np.arange(len(at)) - np.repeat(first, lengths)) & 1023
    return _mix(np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place], first)), starts


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words (ASCII letters and digits and all other non-ASCII characters)."""
    return token_arrays([text])[0]


def token_arrays(texts: list[str | None]) -> list[np.ndarray]:
    """tokens of each text; many short texts, or parts of a long one, go through at once."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        lengths = np.array([len(part) + 1 for _, part in held])
        hashes, starts = _hash_words(np.frombuffer(b"\n".join(part for _, part in held), np.uint8))
        for (i, _), piece in zip(held, np.split(hashes, np.searchsorted(starts, np.cumsum(lengths)[:-1])), strict=True):
            found[i].append(piece)
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        raw = (text or "").lower().encode()
        at = 0
        while at < len(raw):
            to = min(len(raw), at + CHUNK_BYTES)
            while to < len(raw) and _WORD[raw[to]]:  # never inside a word
                to += 1
            held.append((i, raw[at:to]))
            size += to - at
            at = to
            if size >= CHUNK_BYTES:
                flush()
                size = 0
    if held:
        flush()
    return [np.concatenate(f) if f else np.zeros(0, np.uint64) for f in found]


def _seeds(hashes: np.ndarray, offsets: list[int], span: int, salt: int) -> np.ndarray:
    """The hash of the picked tokens of each window of span tokens."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, salt, np.uint64)
    for k, o in enumerate(offsets):
        total += hashes[o : o + n] * _FACTORS[k]
    return _mix(total)


def short_masks(n: int) -> list[list[int]]:
    """The places picked in an item of n tokens, n under WINDOW: blocks without as many as substitutions are allowed."""
    wrong = n - int(np.ceil(SHARE * n))
    blocks = [b.tolist() for b in np.array_split(np.arange(n), (1, 3, 5)[wrong])]
    return [sorted(x for k, b in enumerate(blocks) if k not in out for x in b) for out in combinations(range(len(blocks)), wrong)]


class Index:
    """Seeds of benchmark items, by mask; items shorter than WINDOW have masks of their length."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items = [(i, t) for (i, _), t in zip(items, token_arrays([x for _, x in items]), strict=True) if len(t) >= LEAST_TOKENS]
        masks = [([k for k, c in enumerate(m) if c == "1"], SPAN, None) for m in MASKS]
        masks += [(offsets, n, n) for n in sorted({len(t) for _, t in self.items if len(t) < WINDOW}) for offsets in short_masks(n)]
        self.masks = []
        for salt, (offsets, span, only) in enumerate(masks):
            rows = [(s, k, at) for k, (_, t) in enumerate(self.items) if (len(t) >= WINDOW if only is None else len(t) == only) for at, s in enumerate(_seeds(t, offsets, span, salt).tolist())]
            if rows:
                seeds, item, at = (np.array(c, np.uint64 if j == 0 else np.int64) for j, c in enumerate(zip(*rows, strict=True)))
                order = np.argsort(seeds, kind="stable")
                present = np.zeros(1 << 20, bool)
                present[seeds >> np.uint64(44)] = True
                self.masks.append((offsets, span, salt, present, seeds[order], item[order], at[order]))

    def hits(self, hashes: np.ndarray) -> set[tuple[int, int]]:
        """(item, token of the text at which the item would begin) for every seed that agrees."""
        found = set()
        for offsets, span, salt, present, seeds, item, at in self.masks:
            own = _seeds(hashes, offsets, span, salt)
            where = np.flatnonzero(present[own >> np.uint64(44)])
            low, high = np.searchsorted(seeds, own[where], "left"), np.searchsorted(seeds, own[where], "right")
            for p, a, b in zip(where[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                found.update((k, p - q) for k, q in zip(item[a:b].tolist(), at[a:b].tolist(), strict=True))
        return found

    def overlap(self, hashes: np.ndarray, k: int, begin: int) -> tuple[int, int, int] | None:
        """Start in the text, agreeing tokens and length of the best window of item k laid at begin, if good enough."""
        item = self.items[k][1]
        window = min(WINDOW, len(item))
        lo, hi = max(0, begin), min(len(hashes), begin + len(item))
        if hi - lo < window:
            return None
        same = np.cumsum(np.concatenate([[0], hashes[lo:hi] == item[lo - begin : hi - begin]]))
        counts = same[window:] - same[:-window]
        best = int(counts.argmax())
        return (lo + best, int(counts[best]), window) if counts[best] >= np.ceil(SHARE * window) else None

    def search(self, hashes: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """item -> its best overlap with the text; of equal ones the first."""
        best: dict[int, tuple[int, int, int]] = {}
        for k, begin in sorted(self.hits(hashes)):
            if (found := self.overlap(hashes, k, begin)) and (k not in best or (-found[1], found[0]) < (-best[k][1], best[k][0])):
                best[k] = found
        return best


@dataclass
class _Blocks:
    items: DataFrame
    count: int

    def __iter__(self) -> Iterator[list[tuple[int, str]]]:
        for k in range(self.count):
            part = self.items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.count)) == k)
            yield [(r["item_id"], r["text"]) for r in part.collect()]


def _blocks(benchmark: DataFrame) -> _Blocks:
    """The benchmark in blocks of about BLOCK_CHARS characters, each of which is broadcast alone."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return _Blocks(items, max(1, -(-chars // BLOCK_CHARS)))


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text, any others) and item of benchmark (item_id, text) that overlap.

    start_token, matched and window tell the best window. Null and empty texts, and items under
    LEAST_TOKENS tokens, overlap with nothing; null identifiers are carried along; repeated rows
    are each reported; empty tables give an empty result.
    """
    spark = docs.sparkSession
    found = None
    for items in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(Index(items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in pieces(batches):
                ids, rows = batch.column(0).to_pylist(), []
                for doc_id, hashes in zip(ids, token_arrays(batch.column(1).to_pylist()), strict=True):
                    rows += [(doc_id, index.items[k][0], *hit, len(index.items[k][1])) for k, hit in index.search(hashes).items()]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in _HITS.split(", ")])

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _HITS)
        found = part if found is None else found.unionByName(part)
    return found


def _is_clean(shared):
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([not shared.value.search(t) for part in slices(texts) for t in token_arrays(part.to_pylist())], pa.bool_())

    return F.arrow_udf(clean, "boolean")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text, any others) without the rows that overlap with any item of benchmark.

    Rows are judged where they stand, without a shuffle, by their text alone: null and repeated
    doc_ids and repeated rows are carried along. Null and empty texts stay. An empty benchmark
    drops nothing; an empty table gives an empty result.
    """
    for items in _blocks(benchmark):
        docs = docs.filter(_is_clean(docs.sparkSession.sparkContext.broadcast(Index(items)))(F.col("text").cast("string")))
    return docs
