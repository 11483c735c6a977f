"""Phrase collocations against plain counting, over small thresholds and narrow sketches."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from kinfold.llm import collocations as C

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    """lang, rank, phrase, a, l, r, n, score by plain loops over rows (text, lang)."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(ASCII_LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + n])) for n in range(1, 6) for i in range(len(words) - n + 1))
    often = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    found = []
    for (lang, w), a in often.items():
        if any(g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) and 100 * b >= 100 * a for (g, v), b in often.items()):
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found.append((lang, -score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]], totals[lang]))
    rank, out = Counter(), []
    for lang, score, a, phrase, left, right, n in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n, -score))
    return out


def run(spark, rows, least, top, bits=10):
    docs = spark.createDataFrame([(k % 3 or None, t, g, "x") for k, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, phrase string")
    return sorted(map(tuple, C.collocations(docs.repartition(3), least, top, bits=bits).collect()))


def made(seed):
    rng = random.Random(seed)
    words = ["a", "B", "c", "dd", "\u00e9\u00c9", "\u4e2d\u6587", "x-y", "\u00a0", "z" * 70]
    joins = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!?"]
    rows = [("".join(rng.choice(words) + rng.choice(joins) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None])) for _ in range(30)]
    return rows + [(None, "en"), ("", None), (" .\n", "fr"), (" a a a a a a a a a ", "en"), ("solo", "only"), *[("a B c dd", "en")] * 9]


@pytest.mark.parametrize("seed,least,top", [(0, 3, 2000), (1, 8, 5), (2, 11, 2000)])
def test_against_plain_counts(spark, seed, least, top):
    rows = made(seed)
    want = sorted(plain(rows, least, top))
    assert want and run(spark, rows, least, top) == want


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    rows = made(3) + [("a B c " * 4000, "en"), ("w" * 50_000 + " a B", "en")]
    monkeypatch.setattr(C, "CHUNK_BYTES", 64)
    assert list(C._chunks(b"")) == [(b"", 0)]
    words = list(C.words_of(iter([__import__("pyarrow").RecordBatch.from_pydict({"lang": [g or "und" for _, g in rows], "text": [t for t, _ in rows]})])))
    got = Counter()
    for w in words:
        for f in w.grams():
            for lang, phrase, n in zip(w.lang[f.first].tolist(), w.phrases(f).to_pylist(), f.counts.tolist(), strict=True):
                got[w.names[lang], phrase] += n
    want = Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(ASCII_LOWER)):
            v = re.findall("[^ \t]+", piece)
            want.update((lang or "und", " ".join(v[i : i + n])) for n in range(1, 6) for i in range(len(v) - n + 1))
    assert got == want


def test_sketch_never_underestimates():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    row, true = np.zeros(64, np.uint8), np.zeros(64, np.int64)
    for _ in range(6):
        n = rng.integers(1, 300, 500)
        at = C.cells(hashes, 0, 6)
        C.add(row, at, n, 100)
        np.add.at(true, at.astype(np.int64), np.minimum(n, 100))
        assert (row == np.minimum(true, 100)).all()


def test_empty_tables_and_exact_scores(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert C.collocations(empty, bits=10).count() == 0
    assert run(spark, [("a b", "en")], 2, 10) == []
    counts = [("en", "", 10**15), ("en", "a", 10**14), ("en", "b", 10**13 + 7), ("en", "a b", 10**13)]
    table = spark.createDataFrame(counts, "lang string, phrase string, f long")
    (row,) = C.scored(table).collect()
    assert row["score"] == 1000 * 10**13 * 10**15 // (10**14 * (10**13 + 7))


def test_counts_are_combined_within_bounds(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(C, "COMBINE_ROWS", 8)
    rng = random.Random(4)
    rows = [("en", rng.choice("abcdefghijklm"), rng.randrange(5)) for _ in range(100)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k : k + 3], strict=True)], names=["lang", "phrase", "f"]) for k in range(0, 100, 3)]
    want, got, size = Counter(), Counter(), 0
    for _, p, n in rows:
        want[p] += n
    for b in C.combined(iter(batches)):
        size += b.num_rows
        for r in b.to_pylist():
            got[r["phrase"]] += r["f"]
    assert got == want and size < 100
