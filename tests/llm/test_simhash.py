"""Fingerprints, links and components against brute force."""

import random

import numpy as np
import xxhash

from kinfold.llm import simhash
from kinfold.llm.components import components


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_fingerprints(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "one TWO", "É é\xa0x\x1fy z\tq", *(" ".join(rng.choices(["a", "B", "cc", "dÉ", "\n"], k=rng.randrange(1, 50))) for _ in range(200))]
    for chunk in (1 << 16, 7):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def clustered(rng, n):
    values = set()
    while len(values) < n:
        center = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 30)):
            v = center
            for b in rng.sample(range(64), rng.randrange(0, 5)):
                v ^= 1 << b
            values.add(v - (1 << 64) if v >> 63 else v)
    return sorted(values)


def test_every_link_is_found_once_whatever_the_plan(spark):
    values = np.array(clustered(random.Random(2), 700))
    want = {(int(a), int(b)) for i, a in enumerate(values) for b in values[i + 1 :] if int(np.bitwise_count(np.uint64(int(a ^ b) & (1 << 64) - 1))) <= 3}
    fps = spark.createDataFrame([(int(v),) for v in values], "fp long")
    found = simhash.link_fingerprints(fps).collect()
    assert sorted((r["a"], r["b"]) for r in found) == sorted(want)
    thirds = [list(range(0, 20)), list(range(20, 42)), list(range(42, 64))]
    quarters = [list(range(k, 64, 4)) for k in range(4)]
    for partitions in ([(thirds[0], 0), (thirds[1], 1), (thirds[2], 0)], [(thirds[1], 1), (thirds[2], 1)], [(q, 0) for q in quarters]):
        found = simhash.near_pairs(fps, partitions).collect()
        assert sorted((r["a"], r["b"]) for r in found) == sorted(want)


def test_thresholds_are_the_cheapest():
    rng = random.Random(3)
    for m in (2, 3, 4):
        costs = [[rng.random() * 10 for _ in range(5)] for _ in range(m)]
        total = 3 - m + 1
        every = [(sum(costs[i][t + 1] for i, t in enumerate(ts)), list(ts)) for ts in np.ndindex(*[5] * m) for ts in [[t - 1 for t in ts]] if sum(ts) == total]
        cost, thresholds = simhash.allocate(costs, total)
        assert sum(thresholds) == total and abs(cost - min(every)[0]) < 1e-9
    groups = simhash.group_bits(np.eye(64, dtype=int) * 5, 10, 3)
    assert sorted(b for g in groups for b in g) == list(range(64))


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(250)] + [(7, 7), (-5, 3)]
    found = {r["u"]: r["v"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for p in links for x in p}, links)
    assert found == {n: r for n, r in want.items() if n != r}


def test_near_duplicates_and_edges(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = []
    for k in range(120):
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 2, 5, 400]))
        rows.append((3 * k, " ".join(words)))
        if k % 2 and len(words) > 300:
            words[7] = "changed"
            rows.append((3 * k + 1, " ".join(words)))
    rows += [(900, None), (901, ""), (902, "dup dup"), (902, "dup dup"), (None, "alone here")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, fp int")
    found = simhash.near_duplicates(docs).collect()
    fps = {t: slow_fingerprint(t) for _, t in rows}
    values = sorted(set(fps.values()))
    links = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 3]
    root = roots(values, links)
    least = {}
    for i, t in rows:
        r = root[fps[t]]
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    want = sorted((str(i), f"{fps[t]:016x}", str(least[root[fps[t]]])) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in found) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
