"""Sketches of long phrases hold only what may be frequent."""

import random

import numpy as np

from kinfold.llm import collocations as C


def test_rare_phrases_do_not_fill_the_last_sketch(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) + " one two three four" * (k % 4 == 0) for k in range(400)]
    found, make = [], C.sketch
    monkeypatch.setattr(C, "sketch", lambda *a, **b: found.append(make(*a, **b)) or found[-1])
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    got = {r["phrase"]: r["f"] for r in C.frequent(docs, 10, 3, 13).collect()}
    assert got["one two three four"] == 100 and got[""] == 400 * 60 + 400
    assert np.unpackbits(found[-1]).mean() < 0.05
