"""How the near stage finds its pairs: SimHash first, and few comparisons in groups that have a centre."""

import random

import test_near_copies as slow

from kinfold.llm import near_copies, simhash


def compared(spark, monkeypatch, texts):
    """Pairs of texts that go to the exact check, call by call, and the doc_ids that stay."""
    node = {int(near_copies.xxhash.xxh64_intdigest(near_copies.shingles(t).tobytes())): i for i, t in enumerate(texts)}
    calls, check = [], near_copies.verified

    def spy(pairs, *rest):
        calls.append([tuple(sorted((node[r["a"] % 2**64], node[r["b"] % 2**64]))) for r in pairs.collect()])
        return check(pairs, *rest)

    monkeypatch.setattr(near_copies, "verified", spy)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in near_copies.keep_one(docs).collect()}
    assert kept == slow.expected(list(enumerate(texts)))
    return calls, kept


def test_simhash_pairs_are_checked_first(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    texts = [" ".join(base)]
    for _ in range(5):
        words = list(base)
        words[rng.randrange(900)] = "other"
        texts.append(" ".join(words))
    texts += [" ".join(f"v{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5)]
    fps = [simhash.fingerprint(t) for t in texts]
    near = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if (fps[i] ^ fps[j]).bit_count() <= simhash.LINK_BITS and fps[i] != fps[j]}
    first = {f: fps.index(f) for f in fps}
    calls, _ = compared(spark, monkeypatch, texts)
    assert near and len(calls[0]) >= len({(first[fps[i]], first[fps[j]]) for i, j in near})
    assert all((fps[i] ^ fps[j]).bit_count() <= simhash.LINK_BITS for i, j in calls[0])


def test_few_comparisons_around_a_centre(spark, monkeypatch):
    """Copies that are alike to one text but hardly to each other: that text links them, so nothing is left to compare with all others."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(250)]
    texts = []
    for k in range(120):
        words = list(base)
        for at in rng.sample(range(2, 247, 5), 4):
            words[at] = f"own{k}x{at}"
        texts.append(" ".join(words))
    texts.insert(77, " ".join(base))
    calls, kept = compared(spark, monkeypatch, texts)
    assert kept == {0} and not calls[-1]
