"""Suffix arrays and the removal of repeated strings against brute force."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from kinfold.llm import suffix_dedup
from kinfold.llm.suffix_array import permuted_prefixes, suffix_array

N = suffix_dedup.STRING


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(400):
        letters = rng.choice([1, 2, 3, 20])
        b = bytes(rng.randrange(1, letters + 1) for _ in range(rng.randrange(1, 80))) + b"\0"
        s = np.frombuffer(b, np.uint8)
        sa = suffix_array(s)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        room = np.array([next(j for j in range(i, len(b)) if b[j] in (0, 3)) - i for i in range(len(b))])
        prefix = permuted_prefixes(s, sa, room, int(room.max()) + 1)
        for i, j in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
            common = next(k for k in range(len(b)) if b[i + k : i + k + 1] != b[j + k : j + k + 1])
            assert prefix[i] == min(common, room[i], room[j])


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + N] for r in raws for i in range(len(r) - N + 1))
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - N + 1):
            if seen[r[i : i + N]] > 1:
                gone[i : i + N] = True
        runs = int(np.diff(gone.astype(int), prepend=0).clip(0).sum())
        yield len(r), int(gone.sum()), runs, sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()


def corpus(rng):
    letters = "abcdé \n"
    fresh = lambda n: "".join(rng.choices(letters, k=n))
    passages = [fresh(rng.choice([150, 199, 200, 201, 260, 700])) for _ in range(8)]
    texts = [None, "", "short", passages[5], "x" * 450, "x" * 199, "x" * 200, "xy" * 300, fresh(40) + "x" * 230 + fresh(40)]
    for _ in range(60):
        parts = [fresh(rng.randrange(0, 300)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randrange(1, 6))]
        texts.append("".join(parts))
    line = fresh(230)
    texts += [line + fresh(100) + line, texts[20], texts[20], fresh(3000)]
    near = list(fresh(1500))
    for _ in range(12):
        near[rng.randrange(1500)] = "!"
        texts.append("".join(near))
    return texts


@pytest.mark.parametrize("shard_contexts", [5000, 3])
def test_removal(spark, shard_contexts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 20_000)
    texts = corpus(random.Random(7))
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, tid int")
    found = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.remove_repeated(docs, shard_contexts).collect()}
    for i, want in enumerate(brute(texts)):
        assert found[i] == want, i


def test_anchors_do_not_depend_on_chunks(monkeypatch):
    raw = np.frombuffer("".join(random.Random(3).choices("ab", k=5000)).encode(), np.uint8)
    whole = [x.tolist() for x in suffix_dedup.anchors(raw)]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    assert [x.tolist() for x in suffix_dedup.anchors(raw)] == whole
    for i in range(len(raw) - N + 1):
        assert any(i <= a <= i + N - suffix_dedup.K for a in whole[0])


def test_edges(spark):
    docs = spark.createDataFrame([(1, "z" * 10), (1, "y" * 10 + "q" * 250), (None, "y" * 10 + "q" * 250)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in suffix_dedup.remove_repeated(docs).collect()) == [0, 260, 260]
    assert suffix_dedup.remove_repeated(docs.limit(0)).count() == 0
