"""The seeds of decontamination meet every overlap that its definition counts."""

import random
from itertools import combinations

import numpy as np
import pytest
from test_text_operators import brute

from kinfold.llm import decontaminate as D


@pytest.mark.parametrize("n", range(1, D.WINDOW + 4))
def test_every_allowed_pattern_is_found(n):
    item = " ".join(f"w{k}" for k in range(n))
    index = D.Index([(7, item)])
    window = min(n, D.WINDOW)
    wrong = window - int(np.ceil(D.SHARE * window))
    for at in range(n - window + 1):
        for places in combinations(range(window), wrong):
            part = [f"x{k}" if k in places else f"w{at + k}" for k in range(window)]
            found = index.search(D.tokens(" ".join(["before", *part, "after"])))
            assert list(found) == [0] and found[0][1:] == (window - wrong, window), (n, at, places)


def test_short_items_and_two_substitutions(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefé", k=4))
    items = [(n, " ".join(word() for _ in range(n))) for n in (1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14, 25)]
    docs = []
    for k in range(200):
        part = rng.choice(items)[1].split()
        for _ in range(rng.randrange(4)):
            part[rng.randrange(len(part))] = "zzz"
        docs.append((k, " ".join([word() for _ in range(rng.randrange(20))] + part + [word() for _ in range(rng.randrange(9))])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.find_overlaps(frame, bench).collect()} == brute(docs, items)
