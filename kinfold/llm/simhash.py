"""Near-duplicate detection: SimHash fingerprints joined by the general pigeonhole principle.

The 64 bits are grouped into m partitions of correlated bits. If two fingerprints differ in at
most LINK_BITS bits and the thresholds t_i of the partitions, each at least -1, sum up to
LINK_BITS - m + 1, then some partition differs in at most t_i bits. So each fingerprint probes
partition i with its own bits and all changes of up to t_i of them; -1 leaves a partition out.
Dynamic programming picks the thresholds, and m, of least estimated cost in probes and
candidates. The choice affects the work alone: every link is found once, and verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import pieces, stored
from kinfold.llm.components import components

SHINGLE_WORDS = 3
LINK_BITS = 3
SEED = 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Fingerprints from which the shares of near pairs are estimated, at most; chosen by hash.
SAMPLE = 1000
#: Numbers of partitions that are considered.
PARTITIONS = (2, 3, 4)
#: Cost of shuffling one probe, in verifications of a candidate.
PROBE_COST = 30


def fingerprint(text: str | None) -> int:
    """As unsigned 64 bits. A-Z are lower-cased; words are split at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(SHINGLE_WORDS, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n, digest, counts = len(words) - size + 1, xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at:to].tolist(), (ends[at + size - 1 : to + size - 1] - 1).tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(((2 * counts > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the bits as a signed long) of every row of docs."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each two bits are set in the same fingerprint."""
    total = np.zeros((64, 64), np.int64)
    for batch in pieces(batches):
        bits = _bits(np.ascontiguousarray(batch.column(0).to_numpy())).astype(np.float32)
        total += (bits.T @ bits).astype(np.int64)
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel())], names=["pair", "n"])


def group_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m partitions of 64 // m bits or one more: each grows from the most correlated bits left."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    close = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(close, 0)
    left, groups = list(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        group = [left[int(close[np.ix_(left, left)].max(axis=1).argmax())]]
        left.remove(group[0])
        while len(group) < size:
            best = left[int(close[np.ix_(left, group)].sum(axis=1).argmax())]
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def near_shares(group: list[int], p: np.ndarray, sample: np.ndarray, most: int) -> list[float]:
    """Estimated share of pairs that differ in at most t bits of the group, for t = 0 .. most.

    The larger of the share among pairs of the sample and of that for independent bits.
    """
    differ = np.zeros(most + 1)
    differ[0] = 1.0
    for q in 2 * p[group] * (1 - p[group]):
        differ = differ * (1 - q) + np.concatenate([[0], differ[:-1]]) * q
    shares = np.cumsum(differ)
    if len(sample) > 1:
        bits = _bits(sample)[:, group].astype(np.float32)
        ones = bits.sum(axis=1)
        distance = ones[:, None] + ones[None, :] - 2 * bits @ bits.T
        pairs = distance[np.triu_indices(len(sample), 1)]
        shares = np.maximum(shares, [(pairs <= t + 0.5).mean() for t in range(most + 1)])
    return shares.tolist()


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of least summed cost that sum up to total; costs[i][t + 1] is that of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        found: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, taken) in best.items():
            for t, c in enumerate(row, -1):
                if spent + t not in found or cost + c < found[spent + t][0]:
                    found[spent + t] = cost + c, [*taken, t]
        best = found
    return best[total]


def plan(together: np.ndarray, n: int, sample: np.ndarray, link_bits: int = LINK_BITS) -> list[tuple[list[int], int]]:
    """The partitions to probe and their thresholds."""
    p, choices = np.diag(together) / max(n, 1), []
    for m in PARTITIONS:
        groups = group_bits(together, n, m)
        costs = []
        for g in groups:
            shares = near_shares(g, p, sample, link_bits)
            probes = np.cumsum([comb(len(g), t) for t in range(link_bits + 1)])
            costs.append([0.0, *(PROBE_COST * n * float(b) + float(n) * n * s for b, s in zip(probes, shares, strict=True))])
        cost, thresholds = allocate(costs, link_bits - m + 1)
        choices.append((cost, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(choices, key=lambda c: c[0])[1]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def near_pairs(fps: DataFrame, partitions: list[tuple[list[int], int]], link_bits: int = LINK_BITS) -> DataFrame:
    """a, b: each two values of fps (distinct longs, column fp) that differ in at most link_bits bits, once."""
    masks = [F.lit(_mask(bits)).cast("long") for bits, _ in partitions]
    here = lambda k, value: F.struct(F.lit(k).alias("part"), value.alias("value"))
    own = [here(k, F.col("fp").bitwiseAND(m)) for k, m in enumerate(masks)]
    flips = [[_mask(list(c)) for t in range(most + 1) for c in combinations(bits, t)] for bits, most in partitions]
    probes = []
    for k, changes in enumerate(flips):
        kept = F.col("fp").bitwiseAND(masks[k])
        probes.append(F.transform(F.array(*[F.lit(c).cast("long") for c in changes]), _probe(k, kept)))
    left = fps.select(F.col("fp").alias("a"), F.explode(F.concat(*probes)).alias("key")).select("a", "key.*")
    right = fps.select(F.col("fp").alias("b"), F.explode(F.array(*own)).alias("key")).select("b", "key.*")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= link_bits)
    for k, (_, most) in enumerate(partitions):  # a pair counts in the first partition that finds it
        close = close & ((F.col("l.part") <= k) | (F.bit_count(differ.bitwiseAND(masks[k])) > most))
    on = (F.col("l.part") == F.col("r.part")) & (F.col("l.value") == F.col("r.value")) & close
    return left.alias("l").join(right.alias("r"), on).select("a", "b")


def _probe(k: int, kept: Column):
    def make(change: Column) -> Column:
        return F.struct(F.lit(k).alias("part"), kept.bitwiseXOR(change).alias("value"))

    return make


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """near_pairs of fps with the partitions and thresholds that suit them."""
    n = fps.count()
    # 64 x 64 sums and a sample of fixed size are all that reaches the driver
    together = np.zeros(4096, np.int64)
    for r in fps.select("fp").mapInArrow(_together, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        together[r["pair"]] = r["n"]
    sample = fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).select("fp").collect()
    return near_pairs(fps, plan(together.reshape(64, 64), n, np.array([r["fp"] for r in sample], np.int64)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs (doc_id, text, any others).

    A null text counts as empty; a text without words has fingerprint zero and links like any
    other. Copies share a fingerprint, which is linked once. component_id is the smallest
    doc_id of a component, null only if all its doc_ids are. Repeated rows are each returned;
    an empty table gives an empty result.
    """
    marked = stored(fingerprints(docs))
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(link_fingerprints(fps)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
