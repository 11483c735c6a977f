"""The sequence network: embedding, convolutions, a recurrence in both directions, attention and dense layers.

Layers are NumPy functions with their gradients. Each epoch broadcasts the weights, workers add up the
gradients of their rows, sums of blocks meet in Spark, and the driver gets one gradient and takes one
step, so a result doesn't depend on how rows are dealt. Normalisation is by position, not by batch, for
the same reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.residues import PAD_LENGTH, TOKENS
from kinfold.sources.shared import stored

# Fixed values.
SELU_SCALE, SELU_ALPHA = 1.0507009873554805, 1.6732632423543772
FOCAL_GAMMA, FOCAL_WEIGHTS = 2.0, (2.0, 3.0, 2.0, 1.0)
EPOCHS, PATIENCE, SEED = 30, 20, 929

#: Rows that a worker takes through the layers at once.
ROWS = 32
#: Numbers of a gradient that travel together.
BLOCK = 4096

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Shape:
    """Sizes of the layers; length must be divisible by 2 for each of filters."""

    length: int = PAD_LENGTH
    embedding: int = 8
    filters: tuple[int, ...] = (32, 64, 128, 32)
    hidden: int = 128
    attention: int = 64
    dense: tuple[int, ...] = (256, 32)
    classes: int = 4


#: A network that trains in seconds.
SMALL = Shape(256, 8, (16, 16, 16, 16), 16, 16, (32,))


def first_weights(shape: Shape, seed: int = SEED) -> Weights:
    rng, w = np.random.default_rng(seed), {}

    def layer(name: str, fan: int, *size: int) -> None:
        w[name] = rng.normal(0, 1 / np.sqrt(fan), size)
        w[f"{name}_b"] = np.zeros(size[-1])

    w["embed"] = rng.normal(0, 0.5, (len(TOKENS) + 1, shape.embedding))
    before = shape.embedding
    for k, n in enumerate(shape.filters):
        layer(f"conv{k}", 3 * before, 3, before, n)
        w[f"scale{k}"], w[f"shift{k}"] = np.ones(n), np.zeros(n)
        before = n
    for way in "fb":
        layer(f"lstm_{way}", before + shape.hidden, before + shape.hidden, 4 * shape.hidden)
        w[f"lstm_{way}_b"][shape.hidden : 2 * shape.hidden] = 1.0  # what is held is kept at first
    layer("attend", 2 * shape.hidden, 2 * shape.hidden, shape.attention)
    w["point"] = rng.normal(0, 1 / np.sqrt(shape.attention), shape.attention)
    before = 2 * shape.hidden
    for k, n in enumerate((*shape.dense, shape.classes)):
        layer(f"dense{k}", before, before, n)
        before = n
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _selu(x: np.ndarray) -> tuple[np.ndarray, Callable]:
    low = SELU_ALPHA * np.exp(np.minimum(x, 0))
    return SELU_SCALE * np.where(x > 0, x, low - SELU_ALPHA), lambda d: d * SELU_SCALE * np.where(x > 0, 1, low)


def _affine(x: np.ndarray, w: Weights, name: str, grads: Weights) -> tuple[np.ndarray, Callable]:
    def back(d: np.ndarray) -> np.ndarray:
        grads[name] = x.reshape(-1, x.shape[-1]).T @ d.reshape(-1, d.shape[-1])
        grads[f"{name}_b"] = d.reshape(-1, d.shape[-1]).sum(axis=0)
        return d @ w[name].T

    return x @ w[name] + w[f"{name}_b"], back


def _convolved(x: np.ndarray, w: Weights, name: str, grads: Weights) -> tuple[np.ndarray, Callable]:
    n = x.shape[1]
    wide = np.pad(x, ((0, 0), (1, 1), (0, 0)))
    found = sum(wide[:, k : k + n] @ w[name][k] for k in range(3)) + w[f"{name}_b"]

    def back(d: np.ndarray) -> np.ndarray:
        flat = d.reshape(-1, d.shape[-1])
        grads[name] = np.stack([wide[:, k : k + n].reshape(-1, x.shape[-1]).T @ flat for k in range(3)])
        grads[f"{name}_b"] = flat.sum(axis=0)
        out = np.zeros_like(wide)
        for k in range(3):
            out[:, k : k + n] += d @ w[name][k].T
        return out[:, 1:-1]

    return found, back


def _normal(x: np.ndarray, w: Weights, k: int, grads: Weights) -> tuple[np.ndarray, Callable]:
    spread = np.sqrt(x.var(axis=-1, keepdims=True) + 1e-5)
    z = (x - x.mean(axis=-1, keepdims=True)) / spread

    def back(d: np.ndarray) -> np.ndarray:
        grads[f"scale{k}"], grads[f"shift{k}"] = (d * z).sum(axis=(0, 1)), d.sum(axis=(0, 1))
        d = d * w[f"scale{k}"]
        return (d - d.mean(axis=-1, keepdims=True) - z * (d * z).mean(axis=-1, keepdims=True)) / spread

    return z * w[f"scale{k}"] + w[f"shift{k}"], back


def _pooled(x: np.ndarray) -> tuple[np.ndarray, Callable]:
    pairs = x.reshape(len(x), -1, 2, x.shape[-1])
    second = pairs[:, :, 1] > pairs[:, :, 0]

    def back(d: np.ndarray) -> np.ndarray:
        return np.stack([np.where(second, 0, d), np.where(second, d, 0)], axis=2).reshape(x.shape)

    return np.where(second, pairs[:, :, 1], pairs[:, :, 0]), back


def _recurrent(x: np.ndarray, w: Weights, name: str, grads: Weights) -> tuple[np.ndarray, Callable]:
    """States after each step of a long short-term memory, from the first step to the last."""
    rows, steps, _ = x.shape
    h = w[name].shape[1] // 4
    state, cell, held = np.zeros((rows, h)), np.zeros((rows, h)), []
    out = np.zeros((rows, steps, h))
    for t in range(steps):
        given = np.concatenate([x[:, t], state], axis=1)
        z = given @ w[name] + w[f"{name}_b"]
        i, f, o, g = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
        before, cell = cell, f * cell + i * g
        high = np.tanh(cell)
        state = o * high
        held.append((given, i, f, o, g, before, high))
        out[:, t] = state

    def back(d: np.ndarray) -> np.ndarray:
        grads[name], grads[f"{name}_b"] = np.zeros_like(w[name]), np.zeros_like(w[f"{name}_b"])
        into, d_state, d_cell = np.zeros_like(x), np.zeros((rows, h)), np.zeros((rows, h))
        for t in reversed(range(steps)):
            given, i, f, o, g, before, high = held[t]
            ds = d[:, t] + d_state
            dc = d_cell + ds * o * (1 - high * high)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), ds * high * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            grads[name] += given.T @ dz
            grads[f"{name}_b"] += dz.sum(axis=0)
            dx = dz @ w[name].T
            into[:, t], d_state, d_cell = dx[:, : x.shape[2]], dx[:, x.shape[2] :], dc * f
        return into

    return out, back


def _attended(x: np.ndarray, w: Weights, grads: Weights) -> tuple[np.ndarray, Callable]:
    """The mean of the steps, weighted by how well each fits what the layer points at."""
    z, back_z = _affine(x, w, "attend", grads)
    high = np.tanh(z)
    fit = high @ w["point"]
    share = np.exp(fit - fit.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)

    def back(d: np.ndarray) -> np.ndarray:
        d_share = np.einsum("rth,rh->rt", x, d)
        d_fit = share * (d_share - (share * d_share).sum(axis=1, keepdims=True))
        grads["point"] = np.einsum("rt,rta->a", d_fit, high)
        return share[:, :, None] * d[:, None, :] + back_z(d_fit[:, :, None] * w["point"] * (1 - high * high))

    return np.einsum("rt,rth->rh", share, x), back


def _layers(x: np.ndarray, w: Weights, shape: Shape, grads: Weights) -> tuple[np.ndarray, list[Callable]]:
    """Logits of rows of tokens, and the gradients of the layers from first to last; the first gets the tokens' rows."""
    backs: list[Callable] = []

    def through(step: tuple[np.ndarray, Callable]) -> np.ndarray:
        backs.append(step[1])
        return step[0]

    def embedded(d: np.ndarray) -> None:
        grads["embed"] = np.zeros_like(w["embed"])
        np.add.at(grads["embed"], x, d)

    now = through((w["embed"][x], embedded))
    for k in range(len(shape.filters)):
        now = through(_convolved(now, w, f"conv{k}", grads))
        now = through(_selu(now))
        now = through(_normal(now, w, k, grads))
        now = through(_pooled(now))
    ahead, back_ahead = _recurrent(now, w, "lstm_f", grads)
    behind, back_behind = _recurrent(now[:, ::-1], w, "lstm_b", grads)
    h = shape.hidden
    now = through((np.concatenate([ahead, behind[:, ::-1]], axis=2), lambda d: back_ahead(d[:, :, :h]) + back_behind(d[:, ::-1, h:])[:, ::-1]))
    now = through(_attended(now, w, grads))
    for k in range(len(shape.dense)):
        now = through(_affine(now, w, f"dense{k}", grads))
        now = through(_selu(now))
    return through(_affine(now, w, f"dense{len(shape.dense)}", grads)), backs


def shares(x: np.ndarray, w: Weights, shape: Shape) -> np.ndarray:
    """Probabilities of the classes of rows of tokens."""
    z, _ = _layers(x, w, shape, {})
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def focal(p: np.ndarray, y: np.ndarray, weights: tuple[float, ...] = FOCAL_WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """Focal loss of each row, and its gradient by the logits; probabilities are cut off at 1e-7."""
    weight = np.resize(np.asarray(weights), p.shape[1])[y]
    own = np.clip(p[np.arange(len(y)), y], 1e-7, 1 - 1e-7)
    loss = -weight * (1 - own) ** FOCAL_GAMMA * np.log(own)
    by_own = weight * (FOCAL_GAMMA * (1 - own) ** (FOCAL_GAMMA - 1) * np.log(own) - (1 - own) ** FOCAL_GAMMA / own)
    return loss, (by_own * own)[:, None] * (np.eye(p.shape[1])[y] - p)


def gradient(x: np.ndarray, y: np.ndarray, w: Weights, shape: Shape) -> tuple[float, Weights]:
    """Summed loss of the rows and its gradient."""
    grads: Weights = {}
    z, backs = _layers(x, w, shape, grads)
    p = np.exp(z - z.max(axis=1, keepdims=True))
    loss, d = focal(p / p.sum(axis=1, keepdims=True), y)
    for back in reversed(backs):
        d = back(d)
    return float(loss.sum()), grads


def tokens_of(a: str, b: str, length: int) -> np.ndarray:
    """Numbers of the letters of "a-b" as residues.padded makes them."""
    found = [k for x in f"{a}-{b}".upper() if (k := TOKENS.find(x) + 1)][-length:]
    return np.array([0] * (length - len(found)) + found, np.int64)


@dataclass
class Network:
    """A classifier of pairs: a function of a frame (res_a, res_b) to classes."""

    shape: Shape
    weights: Weights
    #: For each epoch: mean loss of training and of held rows, share of held rows that are right.
    history: list[tuple[float, float, float]] = field(default_factory=list)

    def __call__(self, frame: pd.DataFrame) -> np.ndarray:
        found = []
        for at in range(0, len(frame), ROWS):
            part = frame.iloc[at : at + ROWS]
            x = np.stack([tokens_of(a, b, self.shape.length) for a, b in zip(part["res_a"], part["res_b"], strict=True)])
            found.append(shares(x, self.weights, self.shape).argmax(axis=1))
        return np.concatenate(found) if found else np.zeros(0, int)


def _flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _unflat(vector: np.ndarray, like: Weights) -> Weights:
    found, at = {}, 0
    for k in sorted(like):
        found[k] = vector[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return found


def epoch_sums(rows: DataFrame, w: Weights, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Summed gradient of the training rows, and loss and rows of training, loss, rows and right answers of held ones.

    rows: res_a, res_b, cls, held. What is shuffled is one gradient for each task, in blocks.
    """
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = shared.value
        total, seen = np.zeros(sum(x.size for x in now.values())), np.zeros(5)
        for frame in frames:
            for at in range(0, len(frame), ROWS):
                part = frame.iloc[at : at + ROWS]
                x = np.stack([tokens_of(a, b, shape.length) for a, b in zip(part["res_a"], part["res_b"], strict=True)])
                y, held = part["cls"].to_numpy(int), part["held"].to_numpy(bool)
                if (~held).any():
                    loss, grads = gradient(x[~held], y[~held], now, shape)
                    total += _flat(grads)
                    seen[:2] += loss, (~held).sum()
                if held.any():
                    p = shares(x[held], now, shape)
                    seen[2:] += focal(p, y[held])[0].sum(), held.sum(), (p.argmax(axis=1) == y[held]).sum()
        blocks = [seen, *np.split(total, range(BLOCK, len(total), BLOCK))]
        yield pd.DataFrame({"block": range(len(blocks)), "v": blocks})

    def added(key, frame):
        return pd.DataFrame({"block": [key[0]], "v": [np.sum(frame["v"].tolist(), axis=0)]})

    schema = "block int, v array<double>"
    parts = rows.select("res_a", "res_b", "cls", "held").mapInPandas(run, schema).groupBy("block").applyInPandas(added, schema)
    found = [np.array(r["v"]) for r in sorted(parts.collect(), key=lambda r: r["block"])]
    return (np.concatenate(found[1:]), found[0]) if found else (np.zeros(0), np.zeros(5))


def train(pairs: DataFrame, shape: Shape = SMALL, epochs: int = EPOCHS, rate: float = 0.01, patience: int = PATIENCE, seed: int = SEED, hold=stored) -> Network:
    """A network of pairs (res_a, res_b, cls): the weights of the epoch with the least loss of held rows.

    A fifth of the pairs, chosen by hash, is held and only decides when to stop, which is after patience
    epochs without a smaller loss; without held rows the training loss decides. Null values and classes
    beyond the shape's are left out; equal rows count once; without rows the weights stay random.
    """
    known = pairs.select("res_a", "res_b", F.col("cls").cast("int").alias("cls")).dropna().filter((F.col("cls") >= 0) & (F.col("cls") < shape.classes)).distinct()
    rows = hold(known.withColumn("held", F.pmod(F.xxhash64("res_a", "res_b", F.lit(seed)), F.lit(5)) == 0))
    like = first_weights(shape, seed)
    now = best = _flat(like)
    least, idle, history = np.inf, 0, []
    mean, square = np.zeros_like(now), np.zeros_like(now)
    for k in range(1, epochs + 1):
        total, (loss, n, held_loss, held, right) = epoch_sums(rows, _unflat(now, like), shape)
        if not n:
            break
        history.append((loss / n, held_loss / max(held, 1), right / max(held, 1)))
        judged = history[-1][1] if held else history[-1][0]
        if judged < least:
            best, least, idle = now, judged, 0
        elif (idle := idle + 1) > patience:
            break
        step = total / n
        mean, square = 0.9 * mean + 0.1 * step, 0.999 * square + 0.001 * step * step
        now = now - rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
    return Network(shape, _unflat(best, like), history)


def save(spark: SparkSession, network: Network, path: str) -> None:
    """The weights as a Parquet table: a row for each array."""
    rows = [(k, list(w.shape), w.ravel().tolist()) for k, w in sorted(network.weights.items())]
    s = network.shape
    rows.append(("shape", [s.length, s.embedding, s.hidden, s.attention, s.classes, len(s.filters), *s.filters, *s.dense], []))
    spark.createDataFrame(rows, "name string, sizes array<int>, v array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Network:
    rows = {r["name"]: r for r in spark.read.parquet(path).collect()}
    length, embedding, hidden, attention, classes, n, *more = rows.pop("shape")["sizes"]
    return Network(Shape(length, embedding, tuple(more[:n]), hidden, attention, tuple(more[n:]), classes), {k: np.array(r["v"]).reshape(r["sizes"]) for k, r in rows.items()})
