"""Pair classifiers that pick a family's strategy. Any function of pairs to classes can be plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions.residues import PAD_LENGTH, padded, tokens
from kinfold.operators.evaluate import strategy_columns, strategy_vote
from kinfold.operators.pairs import classifier_pairs

CLASSES = 4
LETTERS = 21
FOLDS, PATIENCE, EPOCHS, SEED = 4, 20, 30, 929

#: Classes of the pairs of a pandas frame (res_a, res_b).
Classifier = Callable[[pd.DataFrame], np.ndarray]


def encoded(pairs: DataFrame, length: int = PAD_LENGTH) -> DataFrame:
    """pairs with x: the letters of 'A-B' as numbers, padded in front to length."""
    return pairs.withColumn("x", padded(tokens(F.concat_ws("-", "res_a", "res_b")), length))


def letter_shares(a: str, b: str) -> np.ndarray:
    """Features of a pair: letter shares of both, in order of total, their difference, length ratio and logs."""
    from kinfold.functions.model import ALPHABET

    count = lambda s: np.array([s.upper().count(x) for x in ALPHABET], float) / max(1, len(s))
    p, q = count(a), count(b)
    short, long = sorted((len(a), len(b)))
    return np.concatenate([(p + q) / 2, np.abs(p - q), [short / max(1, long), np.log1p(short), np.log1p(long)]])


@dataclass
class SoftmaxClassifier:
    """Linear softmax over standardised letter_shares, fitted by gradient descent with early stopping."""

    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def features(self, frame: pd.DataFrame) -> np.ndarray:
        x = np.stack([letter_shares(a, b) for a, b in zip(frame["res_a"], frame["res_b"], strict=True)])
        return np.column_stack([(x - self.mean) / self.spread, np.ones(len(x))])

    def __call__(self, frame: pd.DataFrame) -> np.ndarray:
        return (self.features(frame) @ self.weights).argmax(axis=1)


def fit(rows: pd.DataFrame, classes: int = CLASSES, epochs: int = 300, rate: float = 0.1, seed: int = SEED) -> SoftmaxClassifier:
    """rows: res_a, res_b, cls, held (whether a row only decides when to stop). A bounded sample, as a frame."""
    raw = np.stack([letter_shares(a, b) for a, b in zip(rows["res_a"], rows["res_b"], strict=True)])
    model = SoftmaxClassifier(np.zeros((raw.shape[1] + 1, classes)), raw.mean(axis=0), np.where(raw.std(axis=0) > 1e-6, raw.std(axis=0), 1.0))
    x = model.features(rows)
    y = np.eye(classes)[rows["cls"].to_numpy()]
    held = rows["held"].to_numpy(bool)
    w = np.random.default_rng(seed).normal(0, 0.01, (x.shape[1], classes))
    best, best_loss, idle = w, np.inf, 0
    for _ in range(epochs):
        z = np.exp(x @ w - (x @ w).max(axis=1, keepdims=True))
        p = z / z.sum(axis=1, keepdims=True)
        loss = -np.log(np.clip((p * y).sum(axis=1), 1e-7, 1))
        now = loss[held].mean() if held.any() else loss.mean()
        if now < best_loss - 1e-9:
            best, best_loss, idle = w.copy(), now, 0
        elif (idle := idle + 1) > PATIENCE:
            break
        w = w - rate * x[~held].T @ (p - y)[~held] / max(1, (~held).sum())
    return SoftmaxClassifier(best, model.mean, model.spread)


def cross_validated(pairs: DataFrame, sample_rows: int = 20_000) -> tuple[list[float], SoftmaxClassifier]:
    """Accuracy on each of FOLDS folds with like shares of the classes, each with a fresh model, and a model of all rows.

    pairs: res_a, res_b, cls. Equal rows count once. About sample_rows rows, chosen by hash, reach the driver.
    """
    known = pairs.select("res_a", "res_b", "cls").dropna().distinct()
    n = max(1, known.count())
    key = F.concat_ws("-", "res_a", "res_b")
    share = min(1_000_000, int(1_000_000 * sample_rows / n) + 1)
    chosen = known.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) < share)
    order = Window.partitionBy("cls").orderBy(F.xxhash64(key, F.lit(SEED)), "res_a", "res_b")
    rows = chosen.select("res_a", "res_b", "cls", ((F.row_number().over(order) - 1) % FOLDS).alias("fold")).orderBy("res_a", "res_b", "cls").toPandas()
    scores = []
    for k in range(FOLDS):
        train, test = rows[rows["fold"] != k], rows[rows["fold"] == k]
        if len(train) and len(test):
            model = fit(train.assign(held=np.arange(len(train)) % 5 == 0))
            scores.append(float((model(test) == test["cls"]).mean()))
    return scores, fit(rows.assign(held=np.arange(len(rows)) % 5 == 0))


def save(spark: SparkSession, model: SoftmaxClassifier, path: str) -> None:
    """The model as a small Parquet table: a row for each feature."""
    last = len(model.weights) - 1
    rows = [(k, [float(w) for w in model.weights[k]], float(model.mean[k]) if k < last else None, float(model.spread[k]) if k < last else None) for k in range(last + 1)]
    spark.createDataFrame(rows, "feature int, weights array<double>, mean double, spread double").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> SoftmaxClassifier:
    rows = spark.read.parquet(path).orderBy("feature").collect()
    return SoftmaxClassifier(np.array([r["weights"] for r in rows]), np.array([r["mean"] for r in rows[:-1]]), np.array([r["spread"] for r in rows[:-1]]))


def classify(pairs: DataFrame, classifier: Classifier) -> DataFrame:
    """pairs (family, a, b, res_a, res_b) with cls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame[["family", "a", "b"]].assign(cls=classifier(frame).astype("int32"))

    return pairs.select("family", "a", "b", "res_a", "res_b").mapInPandas(run, "family string, a int, b int, cls int")


def strategies(sequences: DataFrame, classifier: Classifier) -> DataFrame:
    """family, cls, s1, s2, s3: the vote of the family's classifier pairs."""
    votes = classify(classifier_pairs(sequences), classifier)
    return strategy_vote(votes).select("family", "cls", *strategy_columns(F.col("cls")))
