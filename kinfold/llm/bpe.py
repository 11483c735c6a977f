"""BPE encoding and decoding with a contiguous rank array.

A short word is held as an array of part boundaries with, beside each, the rank of the
merge of the parts that meet there. The array is scanned for its minimum, that boundary is
deleted and the two neighbouring ranks are looked up again, until no merge is left. A long
word keeps the same state in a heap over linked parts, which gives the same merges without
the quadratic scans. Words recur, so each task keeps a bounded cache of encoded words.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import pieces, release

#: Words of more parts than this are merged by heap; the results are the same.
SHORT_WORD = 128
#: Words held by each of the two generations of a worker's cache.
CACHE_WORDS = 100_000
#: White space of the Unicode standard, as the tokenizer's \s has it (without U+001C to U+001F).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_NO_MERGE = 1 << 60

# What the library's Unicode tables have beyond version 15.1, as first and last code points.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Capitals beyond version 15.1: first and last code point, and that of the first one's small letter.
NEW_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)

_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


class Strange:
    """Code points that this Python's lower() or regex's classes treat otherwise than the library does."""

    def __init__(self) -> None:
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        self._stand_ins: dict[int, str] = {}
        for kind, first, new, name in (("x", "L", NEW_LETTERS, r"\p{L}"), ("0", "N", NEW_NUMBERS, r"\p{N}")):
            ours = set(regex.findall(name, every))
            added = {chr(c) for a, b in new for c in range(a, b + 1)}
            # a letter stands for a letter, a private code point for one that is neither letter nor number
            self._stand_ins |= {ord(c): kind for c in added - ours}
            self._stand_ins |= {ord(c): "\ue000" for c in ours - added if not unicodedata.category(c).startswith(first)}
        self._small = {c: chr(small + c - a) for a, b, small in NEW_CAPITALS for c in range(a, b + 1)}
        odd = frozenset(map(chr, {*self._stand_ins, *self._small, *map(ord, self._small.values())}))
        self._maybe = regex.compile(f"[{min(odd)}-\U0010ffff]").search
        self._absent = odd.isdisjoint

    def holds(self, text: str) -> bool:
        """Whether text has such a code point; few texts do."""
        return not text.isascii() and bool(self._maybe(text)) and not self._absent(text)

    def lower(self, text: str) -> str:
        return text.translate(self._small).lower()

    def shadow(self, text: str) -> str:
        """text with code points, one for one, that regex classes as the library does text's."""
        return text.translate(self._stand_ins)


class Tokenizer:
    """A tokenizer file of the "tokenizers" library whose model is BPE over byte letters with word ends."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or spec.get("decoder"):
            raise ValueError("only plain BPE models without a decoder are supported")
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"unknown normalizer {steps}")
        blank = spec["normalizer"]["normalizers"][1]
        # words are parted by white space either way, so this step has nothing to do
        if (blank["pattern"], blank["content"]) != ({"Regex": "\\s+"}, " "):
            raise ValueError(f"unknown replacement {blank}")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("unknown pre-tokenizer")
        pattern = split["pattern"]["Regex"].replace("[^\\s", f"[^{_SPACE}")
        self._find = regex.compile(pattern)
        self._words = self._find.findall
        self._strange = Strange()
        self._ids: dict[str, int] = model["vocab"]
        self.tokens: dict[int, str] = {i: t for t, i in self._ids.items()}
        self._suffix: str = model.get("end_of_word_suffix") or ""
        self._letters = byte_letters()
        #: (left id, right id) -> (rank, merged id); a smaller rank merges first.
        self._merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self._merges[self._ids[left], self._ids[right]] = (rank, self._ids[left + right])
        self._added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self._added.items()}
        names = sorted(self._added, key=len, reverse=True)
        self._split_added = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None

    @classmethod
    def from_file(cls, path: str) -> Tokenizer:
        return cls(json.loads(Path(path).read_text()))

    def words(self, text: str) -> Iterator[str]:
        """The words of a text, and its special tokens, in order."""
        pieces = self._split_added(text) if self._split_added else [text]
        for k, piece in enumerate(pieces):
            if k % 2:
                yield piece
            elif piece:
                # a capital sigma becomes the plain small one, wherever it stands
                plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
                if self._strange.holds(plain):
                    lowered = self._strange.lower(plain)
                    yield from (lowered[m.start() : m.end()] for m in self._find.finditer(self._strange.shadow(lowered)))
                else:
                    yield from self._words(plain.lower())

    def encode_word(self, word: str) -> list[int]:
        if word in self._added:
            return [self._added[word]]
        letters = [self._letters[b] for b in word.encode()]
        letters[-1] += self._suffix
        parts = [self._ids[x] for x in letters if x in self._ids]
        return self._merge_scan(parts) if len(parts) <= SHORT_WORD else self._merge_heap(parts)

    def _merge_scan(self, parts: list[int]) -> list[int]:
        find, none = self._merges.get, (_NO_MERGE, -1)
        ranks = [find(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            lowest = min(ranks)
            if lowest[0] == _NO_MERGE:
                break
            at = ranks.index(lowest)
            parts[at] = lowest[1]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = find((parts[at - 1], parts[at]), none)
            if at < len(ranks):
                ranks[at] = find((parts[at], parts[at + 1]), none)
        return parts

    def _merge_heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        merges = self._merges
        heap = [(*merges[p], i, p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in merges]
        heap = [(rank, i, new, pair) for rank, new, i, pair in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j] = new, -1
            after[i], after[j] = after[j], -1
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (found := merges.get(p := (parts[left], parts[right]))):
                    heapq.heappush(heap, (found[0], left, found[1], p))
        return [p for p in parts if p >= 0]

    def encode(self, text: str | None) -> list[int]:
        return [i for word in self.words(text or "") for i in self.encode_word(word)]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


class WordCache(dict):
    """word -> (its ids, their tokens), each joined by a space; two generations of bounded size."""

    def __init__(self, tokenizer: Tokenizer, limit: int = CACHE_WORDS):
        super().__init__()
        self._tokenizer, self._limit, self._old = tokenizer, limit, {}

    def __missing__(self, word: str) -> tuple[str, str]:
        if (found := self._old.get(word)) is None:
            ids = self._tokenizer.encode_word(word)
            found = " ".join(map(str, ids)), self._tokenizer.decode(ids)
        if len(word) <= SHORT_WORD:
            if len(self) >= self._limit:
                self._old = dict(self)
                self.clear()
            self[word] = found
        return found


    def forget(self) -> None:
        """At the end of a task, for a worker lives on through other stages."""
        self.clear()
        self._old = {}


@lru_cache(maxsize=4)
def _of_worker(spec: str) -> WordCache:
    """One tokenizer and cache for each Python worker."""
    return WordCache(Tokenizer(json.loads(spec)))


def _per_text(spec: str, fields: list[tuple[str, pa.DataType]], make: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _of_worker(spec.value)
        for batch in pieces(batches):
            rows = [make(cache, text or "") for text in batch.column(1).to_pylist()]
            columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=["doc_id", *(n for n, _ in fields)])
        cache.forget()
        release()

    return run


def _encoded(cache: WordCache, text: str) -> tuple[list[int], int]:
    ids = [int(i) for w in cache._tokenizer.words(text) for i in cache[w][0].split(" ") if i]
    return ids, len(ids)


def _encoded_decoded(cache: WordCache, text: str) -> tuple[list[int], int, str]:
    found = [x for w in cache._tokenizer.words(text) if (x := cache[w])[0]]
    ids = [int(i) for x in found for i in x[0].split(" ")]
    return ids, len(ids), sha256(" ".join([x[1] for x in found]).encode()).hexdigest()


def _digest(cache: WordCache, text: str) -> tuple[int, str, str]:
    found = [x for w in cache._tokenizer.words(text) if (x := cache[w])[0]]
    ids, decoded = " ".join([x[0] for x in found]), " ".join([x[1] for x in found])
    return ids.count(" ") + 1 if ids else 0, sha256(ids.encode()).hexdigest(), sha256(decoded.encode()).hexdigest()


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _spec(spark: SparkSession, path: str):
    """The tokenizer file, read once by the driver and broadcast; its size does not depend on the documents."""
    return spark.sparkContext.broadcast(Path(path).read_text())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), n_tokens of every row of docs (doc_id, text, any others).

    A null or empty text has no ids; null and repeated doc_ids and repeated rows are carried along;
    an empty table gives an empty result.
    """
    fields = [("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64())]
    run = _per_text(_spec(docs.sparkSession, path), fields, _encoded)
    return _inputs(docs).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """encode, and decoded_sha256 of the text that decode makes of the ids. Null and repeated doc_ids and empty tables as there."""
    fields = [("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("decoded_sha256", pa.string())]
    run = _per_text(_spec(docs.sparkSession, path), fields, _encoded_decoded)
    return _inputs(docs).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, decoded_sha256 string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the tokens of ids joined by a space. Null ids give an empty text, unknown ones are left out."""
    spec = _spec(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _of_worker(spec.value)._tokenizer
        for batch in pieces(batches):
            texts = [tokenizer.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, as digests.

    A null text counts as empty; its digests are those of the empty string. Null and repeated doc_ids
    and repeated rows are carried along; an empty table gives an empty result.
    """
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return _inputs(docs).mapInArrow(_per_text(_spec(docs.sparkSession, path), fields, _digest), _RESULT)
