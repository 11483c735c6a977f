"""The nearest two vectors of each family, exact to the sixth decimal."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.pairs import nearest
from kinfold.sources.shared import stored

#: Leading values of a vector that count.
WIDTH = 64
#: Vectors of a tile, and those of it that are compared with another tile at once.
TILE, ROWS = 8192, 256
#: Pairs whose distance is summed at once.
CHUNK = 1 << 16
#: Kind of vectors that hold nulls, nothing, or numbers whose square isn't finite.
ODD = -1
_LARGE = 1e150
#: Bound on the errors of a product of matrices or a projection, relative to the norms.
_NOISE = 1e-12
#: Two directions at right angles: tiles are slabs along the first, rows of a tile are in order of the second.
_DIRECTIONS = np.linalg.qr(np.random.default_rng(7).normal(size=(WIDTH, 2)))[0]
_TILE = "tile long, family string, kind int, lo double, hi double, slack double, ids binary, vectors binary, known binary, d double, a long, b long"
_FOUND = "family string, d double, a long, b long"
_FOUND_ARROW = pa.schema([("family", pa.string()), ("d", pa.float64()), ("a", pa.int64()), ("b", pa.int64())])


class Tile(NamedTuple):
    """Different vectors in order of along, each with its two smallest ids a and b (b = a: it has but one)."""

    kind: int
    vectors: np.ndarray
    known: np.ndarray | None  # which values are not null, for odd vectors only
    a: np.ndarray
    b: np.ndarray
    along: np.ndarray

    def wide(self) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and known values of full width."""
        missing = ((0, 0), (0, WIDTH - self.vectors.shape[1]))
        known = np.ones(self.vectors.shape, bool) if self.known is None else self.known
        return np.pad(self.vectors, missing), np.pad(known, missing)


class Best:
    """The least of pairs by distance, a and b; NaN comes after all numbers and null after that, as in SQL."""

    def __init__(self) -> None:
        self.key: tuple | None = None

    def add(self, d: np.ndarray, null: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        if len(d):
            k = np.lexsort((b, a, d, null))[0]
            nan = bool(np.isnan(d[k]))
            key = (bool(null[k]), nan, 0.0 if nan else float(d[k]), int(a[k]), int(b[k]))
            self.key = key if self.key is None else min(self.key, key)

    def limit(self) -> float:
        return np.inf if self.key is None or self.key[0] or self.key[1] else self.key[2]

    def row(self) -> tuple:
        """d, a, b; all null if there is no pair."""
        if self.key is None:
            return None, None, None
        null, nan, d, a, b = self.key
        return None if null else float("nan") if nan else d, a, b


def rounded_root(s: np.ndarray) -> np.ndarray:
    """Root to six decimals, halves away from zero, as DuckDB rounds a double."""
    d = np.sqrt(s)
    v = d * 1e6
    f = np.floor(v)
    r = (f + (v - f >= 0.5)) / 1e6
    return np.where(np.isfinite(r), r, d)


def _summed(diff: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Squares of each row summed from left to right."""
    s = np.zeros(len(diff))
    for k in range(diff.shape[1]):
        square = diff[:, k] * diff[:, k]
        s += square if known is None else np.where(known[:, k], square, 0.0)
    return s


def _pair_ids(xa, xb, ya, yb) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least two different ids across two vectors, and whether there are two."""
    x2, y2 = xb > xa, yb > ya
    second = np.where(x2 & y2, np.minimum(xb, yb), np.where(x2, xb, yb))
    same = xa == ya
    return np.minimum(xa, ya), np.where(same, second, np.maximum(xa, ya)), ~same | x2 | y2


def _compare_plain(x: Tile, y: Tile, best: Best, limit: float) -> None:
    """By blocks of products of matrices; what these leave within their errors is summed exactly."""
    itself, width = x is y, min(x.kind, y.kind)
    centre = x.vectors[:, :width].mean(axis=0)
    u, v = x.vectors[:, :width] - centre, y.vectors[:, :width] - centre
    qu, qv = (u * u).sum(axis=1), (v * v).sum(axis=1)
    noise = _NOISE * (qu.max() + qv.max())
    in_order = x.kind == y.kind
    slack = _slack(x.vectors) + _slack(y.vectors)
    repeated = len(np.unique(x.a)) < len(x.a) if itself else np.isin(x.a, y.a).any()
    for at in range(0, len(u), ROWS):
        to, start, stop = min(at + ROWS, len(u)), 0, len(v)
        limit = min(limit, best.limit())
        if in_order and limit < np.inf:
            reach = limit * (1 + _NOISE) + 1e-5 + slack
            start, stop = np.searchsorted(y.along, x.along[at] - reach), np.searchsorted(y.along, x.along[to - 1] + reach, "right")
        if itself:
            start = max(start, at)
        if stop <= start:
            continue
        squares = qu[at:to, None] + qv[None, start:stop] - 2 * (u[at:to] @ v[start:stop].T)
        if itself:
            squares[np.arange(start, stop)[None] <= np.arange(at, to)[:, None]] = np.inf
        if repeated:
            one = (x.b[at:to] == x.a[at:to])[:, None] & (y.b[start:stop] == y.a[start:stop])[None]
            squares[one & (x.a[at:to, None] == y.a[None, start:stop])] = np.inf
        least = squares.min()
        reach = min(limit, np.sqrt(max(least, 0.0) + noise)) * (1 + _NOISE) + 1e-6
        if least == np.inf or least > reach * reach + noise:
            continue
        i, j = np.nonzero(squares <= reach * reach + noise)
        for k in range(0, len(i), CHUNK):
            p, q = i[k : k + CHUNK] + at, j[k : k + CHUNK] + start
            a, b, two = _pair_ids(x.a[p], x.b[p], y.a[q], y.b[q])
            d = rounded_root(_summed(x.vectors[p, :width] - y.vectors[q, :width]))
            best.add(d[two], np.zeros(two.sum(), bool), a[two], b[two])


def _compare_odd(x: Tile, y: Tile, best: Best) -> None:
    """Each odd vector of x with all of y; nulls don't count."""
    (u, known_u), (v, known_v) = x.wide(), y.wide()
    for i in range(len(u)):
        rest = slice(i + 1 if x is y else 0, None)
        known = known_v[rest] & known_u[i]
        a, b, two = _pair_ids(x.a[i], x.b[i], y.a[rest], y.b[rest])
        d = rounded_root(_summed(v[rest] - u[i], known))
        best.add(d[two], ~known.any(axis=1)[two], a[two], b[two])


def compare(x: Tile, y: Tile, limit: float = np.inf) -> Best:
    """The nearest pair of a vector of x and another of y; pairs beyond limit may be left out."""
    best = Best()
    with np.errstate(invalid="ignore", over="ignore"):
        if x is y:
            more = x.b > x.a
            v, known = x.wide()
            v, known = v[more], known[more]
            best.add(rounded_root(_summed(v - v, known)), ~known.any(axis=1), x.a[more], x.b[more])
        if x.kind != ODD and y.kind != ODD:
            _compare_plain(x, y, best, limit)
        else:
            _compare_odd(*((x, y) if x.kind == ODD else (y, x)), best)
    return best


def _slack(vectors: np.ndarray) -> float:
    return _NOISE * float(np.abs(vectors).sum(axis=1).max())


def _projected(vectors: np.ndarray, which: int) -> np.ndarray:
    return vectors @ _DIRECTIONS[: vectors.shape[1], which]


def _values(e: pa.Array, kind: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Vectors of one kind, and which values are known of odd ones."""
    if kind != ODD:
        return e.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(e), kind), None
    vectors, known = np.zeros((len(e), WIDTH)), np.zeros((len(e), WIDTH), bool)
    for k, values in enumerate(e.to_pylist()):
        for n, value in enumerate(values or ()):
            if value is not None:
                vectors[k, n], known[k, n] = value, True
    return vectors, known


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds at, the place along the first direction."""
    for batch in batches:
        kind, at = batch["kind"].to_numpy(), np.zeros(batch.num_rows)
        for k in np.unique(kind):
            if k != ODD:
                rows = np.flatnonzero(kind == k)
                at[rows] = _projected(_values(batch["e"].take(pa.array(rows)), k)[0], 0)
        columns = [batch["family"], batch["kind"], pa.array(at), batch["a"], batch["b"], batch["e"]]
        yield pa.RecordBatch.from_arrays(columns, ["family", "kind", "at", "a", "b", "e"])


def _tile_row(number: int, rows: pa.Table) -> pa.RecordBatch:
    """One tile with the nearest pair inside it."""
    rows = rows.combine_chunks()
    family, kind, at = rows["family"][0].as_py(), rows["kind"][0].as_py(), rows["at"].to_numpy()
    vectors, known = _values(rows["e"].combine_chunks(), kind)
    along = np.zeros(len(vectors)) if kind == ODD else _projected(vectors, 1)
    order = np.argsort(along, kind="stable")
    a, b = rows["a"].to_numpy()[order], rows["b"].to_numpy()[order]
    vectors, known = vectors[order], None if known is None else known[order]
    d, left, right = compare(tile := Tile(kind, vectors, known, a, b, along[order]), tile).row()
    with np.errstate(over="ignore"):
        short = vectors.astype(np.float32)
    small = short if kind != ODD and (short == vectors).all() else vectors
    plain = kind != ODD
    row = {
        "tile": number, "family": family, "kind": kind,
        "lo": float(at.min()) if plain else -np.inf, "hi": float(at.max()) if plain else np.inf, "slack": _slack(vectors) if plain else 0.0,
        "ids": np.concatenate([a, b]).tobytes(), "vectors": small.tobytes(), "known": None if plain else known.tobytes(),
        "d": d, "a": left, "b": right,
    }
    types = [pa.int64(), pa.string(), pa.int32(), *[pa.float64()] * 3, *[pa.binary()] * 3, pa.float64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row.values(), types, strict=True)], list(row))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts sorted rows into tiles of one family and kind."""
    number, held, size, last = TaskContext.get().partitionId() << 32, [], 0, None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        keys = list(zip(batch["family"].to_pylist(), batch["kind"].to_pylist(), strict=True))
        at = 0
        while at < len(keys):
            if held and (keys[at] != last or size == TILE):
                yield _tile_row(number, pa.concat_tables(held))
                number, held, size = number + 1, [], 0
            last, to = keys[at], at + 1
            while to < len(keys) and keys[to] == last and size + to - at < TILE:
                to += 1
            held.append(table.slice(at, to - at))
            size, at = size + to - at, to
    if held:
        yield _tile_row(number, pa.concat_tables(held))


def _opened(row: dict) -> Tile:
    ids = np.frombuffer(row["ids"], np.int64)
    n, kind = len(ids) // 2, row["kind"]
    width = WIDTH if kind == ODD else kind
    vectors = np.frombuffer(row["vectors"], np.float64 if len(row["vectors"]) == 8 * n * width else np.float32).reshape(n, width).astype(np.float64)
    known = np.frombuffer(row["known"], bool).reshape(n, width) if kind == ODD else None
    return Tile(kind, vectors, known, ids[:n], ids[n:], np.zeros(n) if kind == ODD else _projected(vectors, 1))


def _compare_tiles(two: pa.Table) -> pa.Table:
    x, y = two.to_pylist()
    d, a, b = compare(_opened(x), _opened(y), np.inf if x["most"] is None else x["most"]).row()
    found = [] if a is None else [{"family": x["family"], "d": d, "a": a, "b": b}]
    return pa.Table.from_pylist(found, schema=_FOUND_ARROW)


def nearest_vectors(rows: DataFrame) -> DataFrame:
    """family, a, b, d of the nearest two vectors with different ids in each family of rows (family, id, e array of float or double).

    The distance is Euclidean over the first WIDTH values, without those that are null in either, rounded to six
    decimals; of equal ones the pair of smallest a, then b. Equal vectors become one. Slabs of a family along a
    direction are tiles; two tiles are compared unless their gap exceeds the least distance inside any tile, and
    then only the rows near each other along a second direction. Where no two vectors are near, all pairs
    remain: products of matrices over independent groups, the square of a family's different vectors.
    """
    rows = rows.filter("family IS NOT NULL AND id IS NOT NULL").select("family", "id", F.slice("e", 1, WIDTH).alias("e"))
    least = Window.partitionBy("family", "e").orderBy("id")
    different = rows.withColumn("n", F.dense_rank().over(least)).filter("n <= 2").groupBy("family", "e").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    plain = (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & (F.abs(x) < _LARGE))
    placed = different.withColumn("kind", F.when(plain, F.size("e")).otherwise(ODD))
    values = different.schema["e"].dataType.simpleString()
    placed = placed.mapInArrow(_place, f"family string, kind int, at double, a long, b long, e {values}")
    key = ["family", "kind", "at", "a"]
    tiles = stored(placed.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_tiles, _TILE))

    most = tiles.filter("d IS NOT NULL AND NOT isnan(d)").groupBy("family").agg(F.min("d").alias("most"))
    side = lambda x: tiles.select("family", *[F.col(c).alias(f"{c}_{x}") for c in ("tile", "kind", "lo", "hi", "slack")])
    gap = F.greatest(F.col("lo_y") - F.col("hi_x"), F.col("lo_x") - F.col("hi_y"))
    apart = (F.col("kind_x") == F.col("kind_y")) & (gap > F.col("most") * (1 + _NOISE) + 1e-5 + F.col("slack_x") + F.col("slack_y"))
    both = side("x").join(side("y"), "family").filter("tile_x < tile_y").join(most, "family", "left").filter(~F.coalesce(apart, F.lit(False)))
    both = both.select("tile_x", "tile_y", "most", F.explode(F.array("tile_x", "tile_y")).alias("tile"))
    blobs = both.join(tiles.select("tile", "family", "kind", "ids", "vectors", "known"), "tile")
    across = blobs.groupBy("tile_x", "tile_y").applyInArrow(_compare_tiles, _FOUND)
    return nearest(tiles.filter("a IS NOT NULL").select("family", "d", "a", "b").unionByName(across))
