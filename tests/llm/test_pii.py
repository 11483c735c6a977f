"""Personal data against Python's regular expressions, and what learned contexts add."""

import random
import re
from hashlib import sha256

from kinfold.llm import pii


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    find = lambda p: list(re.finditer(p, text))
    kinds = {
        "email": find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        "ip": [m for m in find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m for m in find(r"[0-9]([\x20-]?[0-9])+") if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m for m in find(r"\+[0-9][\x20().0-9-]+[0-9]") if 9 <= len(digits(m[0])) <= 15],
    }
    joined = ",".join(f"{k}:{m.start()}:{m.end()}" for k, v in kinds.items() for m in v)
    return (*(len(v) for v in kinds.values()), sha256(joined.encode()).hexdigest(), joined)


PARTS = ["a.b", "@", "mail", ".", "com", "x_y%", "+1", " (301) ", "555-0346", "1", "255", "256", "0007", "4111111111111111", "4111 1111 1111 1111", "-", " ", "é", "😀", "9" * 30, "\n", "12.34.56.78", ".9", "+", "79927398713000"]


def test_base_spans_match_python(spark):
    rng = random.Random(8)
    made = ["".join(rng.choices(PARTS, k=rng.randrange(1, 18))) for _ in range(500)]
    many = " ".join(f"u{i}@m.io 10.0.{i % 300}.1" for i in range(700))
    texts = ["", "plain", many, "a" * 10_000, "1" * 10_000, "1 " * 50_000, "+1" + " " * 20_000, "a@b@c.d", "a@b.c_d@e.f", *made]
    long = [(-2, "a" * 300_000, 0), (-3, "1" * 300_000, 0)]  # Python's own search takes too long on these
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(-1, None, 0), *long], "doc_id long, text string, digest int")
    found = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    for i, t in [*enumerate(texts), (-1, "")]:
        r = found[i]
        *counts, digest, joined = base(t)
        assert [r[f"n_{k}"] for k in pii.KINDS] == counts and r["base_sha256"] == digest, t
        kept = ",".join(x for x in r["spans"].split(",") if not x.startswith(pii.LEARNED))
        assert kept == joined, t
    assert len(found) == len(texts) + 3 and found[-2]["n_spans"] == found[-3]["n_spans"] == 0


def slow_patterns(text, a, b):
    """By plain string functions: the words around text[a:b]."""
    before, after = text[:a].lower(), text[b:].lower()
    left = re.split(r"\s+", before.rstrip("\"'([< \t\n\r\x0b\x0c")) if before[-1:] in "\"'([< \t\n\r\x0b\x0c" and before else []
    left = [w for w in left if w]
    right = after.split()[0] if after[:1].isspace() and after.split() else ""
    found = [("l", *left[-1:])] if left else []
    found += [("ll", *left[-2:])] if len(left) > 1 else []
    return found + ([("lr", left[-1], right)] if left and right else [])


def slow_learned(rows):
    """The spans of trusted patterns, by plain loops over all occurrences."""
    places = []
    for i, text in rows:
        seeds = [m.span() for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"\+[0-9][\x20().0-9-]+[0-9]") for m in re.finditer(p, text)]
        for a, b in seeds:
            places += [(i, a, b, text[a:b], p, True) for p in slow_patterns(text, a, b)]
        for m in re.finditer(pii._IDENTIFIER.replace("*+", "*"), text):
            if len(m[0]) >= pii.LEAST_CHARS:
                places += [(i, *m.span(), m[0], p, False) for p in slow_patterns(text, *m.span())]
    edges, seeds = {}, {p[3] for p in places if p[5]}
    for *_, instance, pattern, seed in places:
        e = edges.setdefault((pattern, instance), [0, 0])
        e[seed] += 1
    edges = {k: max(v) for k, v in edges.items()}
    by_pattern = {}
    for (pattern, instance), n in edges.items():
        by_pattern.setdefault(pattern, {})[instance] = n
    by_pattern = {k: v for k, v in by_pattern.items() if len(v) >= pii.LEAST_TRUSTED}
    totals = dict.fromkeys(by_pattern, 0)
    for _, text in rows:
        w = text.lower().split()
        for k, x in enumerate(w):
            for p in [("l", x), *([("ll", x, w[k + 1])] if k + 1 < len(w) else []), *([("lr", x, w[k + 2])] if k + 2 < len(w) else [])]:
                if p in totals:
                    totals[p] += 1
    trust, score = {i: float(i in seeds) for v in by_pattern.values() for i in v}, {}
    for _ in range(pii.ROUNDS):
        for p, v in by_pattern.items():
            enough = sum(trust[i] >= pii.CONFIDENCE for i in v) >= pii.LEAST_TRUSTED
            score[p] = sum(n * trust[i] for i, n in v.items()) / max(totals[p], sum(v.values())) if enough else 0.0
        trust = {i: 1.0 if i in seeds else max(score[p] for p, v in by_pattern.items() if i in v) for i in trust}
    return {(i, a, b) for i, a, b, _, p, _ in places if score.get(p, 0) >= pii.CONFIDENCE}


def test_scores_match_plain_python(spark):
    rng = random.Random(6)
    words, kinds = "mail phone call id ref the of a badge".split(), ["u{0}@m.io", "+1 (301) 555-{0}", "AB-{0}", "x{0}", "plain"]
    weights = {"mail": [9, 0, 3, 0, 1], "phone": [0, 9, 2, 0, 1], "badge": [0, 0, 6, 0, 1], "id": [3, 0, 5, 0, 2]}
    rows = []
    for i in range(120):
        parts = []
        for _ in range(6):
            w = rng.choice(words)
            parts += [w + rng.choice(["", ":"]), rng.choice(["", '"', "("]) + rng.choices(kinds, weights.get(w, [1, 1, 1, 3, 20]))[0].format(rng.randrange(1000, 1025)), rng.choice(["now", "then", "and"])]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(parts)))
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = {(i, int(x.split(":")[1]), int(x.split(":")[2])) for i, s in found.items() for x in s.split(",") if x.startswith(pii.LEARNED)}
    taken = {(i, int(x.split(":")[1]), int(x.split(":")[2])) for i, s in found.items() for x in s.split(",") if x and not x.startswith(pii.LEARNED)}
    want = {(i, a, b) for i, a, b in slow_learned(rows) if not any(i == k and c < b and a < d for k, c, d in taken)}
    assert got == want and len(want) > 20


def test_new_instances_induce_new_patterns(spark):
    """AB codes are learned after phone numbers' word; only they then vouch for the word badge, and it for XY codes."""
    rows = [f"phone +1 (301) 555-{1000 + i} ends" for i in range(9)] + [f"phone AB-{100 + i} ends" for i in range(6)]
    rows += [f"badge AB-{100 + i} holds" for i in range(6)] + ["badge XY-77901 holds", "year 20261 passed", "plain words"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r["doc_id"]: r["n_learned"] for r in pii.find_personal_data(docs).collect()}
    assert [found[i] for i in range(9, 15)] == [1] * 6 and found[rows.index("badge XY-77901 holds")] == 1
    assert found[rows.index("year 20261 passed")] == 0 and sum(found[i] for i in range(9)) == 0
    once = {r["doc_id"]: r["n_learned"] for r in pii.find_personal_data(docs, rounds=1).collect()}
    assert once[rows.index("badge XY-77901 holds")] == 0


def test_contexts_discover_identifiers(spark):
    seeded = [f"My phone: +1 (301) 555-{1000 + i} is here" for i in range(8)]
    new = ["Your phone: AB-77812 please", "the phone: nothing here", "the year 20261 passed", "the +1 (301) 555-7777 number"]
    filler = ["the weather and the year and the rest"] * 20
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(seeded + new + filler)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    text = new[0]
    at = text.index("AB-77812")
    assert found[8]["spans"] == f"learned:{at}:{at + 8}" and found[8]["n_learned"] == 1
    assert sum(r["n_learned"] for r in found.values()) == 1
    assert all(found[i]["spans"].count(":") == 2 for i in range(8))


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "x a@b.io"), (1, "x a@b.io"), (None, "x a@b.io")], "doc_id long, text string")
    assert [r["n_email"] for r in pii.find_personal_data(docs).collect()] == [1, 1, 1]
    assert pii.find_personal_data(docs.limit(0)).count() == 0
