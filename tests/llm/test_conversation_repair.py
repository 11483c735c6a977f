"""Conversation repair against a search over all edit sequences."""

import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from kinfold.llm import conversation_repair as R

COLUMNS = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        rule = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[conv]
        if rule:
            text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
            out[conv] += [(turn, "user" if rule == 4 else role, text)] * (2 if rule == 3 else 1)
    for rows in out.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(r[2].encode()).hexdigest()))
    return out


def faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        last = text.strip(BLANK)[-1:]
        found.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows, bad):
    """Edits by uniform-cost search over (turns used, initials so far as the pattern's state); ties by the letters."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(lines)
        if (i, state) in done:
            continue
        done.add((i, state))
        grown = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[grown]
        heapq.heappush(heap, (cost + 5, audit + "I", i, grown, (*lines, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
            if bad[i] not in ("blank", "duplicate"):
                extra = 5 * (bad[i] == "truncated")
                if (kept := step.get((state, role[:1]))) is not None:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, kept, (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, grown, (*lines, f"{name}:{text}")))


def plain(rows):
    found = []
    for conv, turns in damaged(rows).items():
        bad = faults(turns)
        given = [t for t, *_ in turns if t is not None]
        gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(turns))
        cost, audit, repaired = cheapest(turns, bad)
        found.append((conv, gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, audit, sha256(repaired.encode()).hexdigest()))
    return sorted(found, key=str)


def made(seed, n=60, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "tool", "assistant", "", "aside", None]])
        for k in range(rng.randrange(1, longest)):
            turn = rng.choice([k, k, k, k, 2 * k, None, 3])
            role = roles[k % len(roles)] if rng.random() < 0.7 else rng.choice(roles)
            rows.append((conv, turn, role, rng.choice(["Yes.", "No!", "cut off", " \n", "", None, f"Turn {k}?", f"w{k}. \t", "é.", "x\x00"])))
    return rows


def run(spark, rows, **more):
    return sorted(map(tuple, R.repair(spark.createDataFrame(rows, COLUMNS), **more).collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_against_search(spark, seed):
    rows = made(seed)
    assert run(spark, rows + rows[:7]) == plain(rows + rows[:7])


def test_units_of_few_turns(spark):
    """A conversation of many units and partitions has the result of one."""
    rows = made(5, 4) + [(99, k, ["user", "assistant"][k % 7 % 2], f"Turn {k % 50}{'.' * (k % 3 > 0)}") for k in range(160)] + [(98, 1, "user", "same.")] * 40
    want = plain(rows)
    automaton = R.Automaton()
    cut = [r for r in rows if r[0] == 99]
    turns, bad = damaged(cut)[99], faults(damaged(cut)[99])
    code = bytes(R.MUST_GO if b in ("blank", "duplicate") else 2 * "sua-".index(r[1][0] if r[1][:1] in "sua" else "-") + (b == "truncated") for r, b in zip(turns, bad, strict=True))
    assert automaton.costs(code, R.END)[0] == cheapest(turns, bad)[0]
    for size in (1, 2, 7):
        v = R.END
        for at in reversed(range(0, len(code), size)):
            part = code[at : at + size]
            v = R._with_inserts(tuple(min(automaton.costs(part, R.EXITS[k])[q] + v[k] for k in range(4)) for q in range(4)))
        assert v == automaton.costs(code, R.END)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        cut = R.units(R.marked(R.damage(spark.createDataFrame(rows, COLUMNS))), 3)
        assert cut.filter("conv_id = 99").count() > 30
        assert run(spark, rows, unit_turns=3) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_automaton_is_small_and_cached():
    a = R.Automaton()
    rng = random.Random(1)
    for _ in range(300):
        a.scan(bytes(rng.randrange(9) for _ in range(50)), R.END)
    assert len(a.vectors) < 100


def test_odd_tables(spark):
    assert R.repair(spark.createDataFrame([], COLUMNS)).count() == 0
    gone = next(k for k in range(100) if zlib.crc32(f"1:{k}".encode()) % 20 == 0)
    (row,) = run(spark, [(1, gone, "user", "Hello.")])
    assert row == (1, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
    rows = [(3, 1, "user", "a. " * 200_000), (3, 2, "assistant", None), (None, None, None, None), (4, None, "user", "Hi."), (4, None, "user", "Hi.")]
    assert run(spark, rows) == plain(rows)
    odd = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "'x' AS copies", "1 AS symbol", "2 AS part", "'y' AS key", "3 AS rule")
    assert sorted(map(tuple, R.repair(odd).collect()), key=str) == plain(rows)
