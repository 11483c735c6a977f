"""Quality scores by a sparse rule ensemble.

Every text becomes a row of statistics. Shallow trees are grown on the labelled rows; each path
from a root to a node is a rule, a conjunction of comparisons. A logistic regression with an L1
penalty gives each rule a weight, most of them zero. What is left is compiled into one Spark
column expression over the statistics, so scoring runs no Python.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import pieces, release, stored

#: Labelled rows that the rules are fitted on, at most; chosen by a hash of doc_id.
SAMPLE_ROWS = 50_000
TREES, DEPTH = 20, 3
#: Weight of the L1 penalty.
LASSO = 0.002
#: A score from here on predicts label 1.
GOOD = 0.3
SEED = 17

#: The statistics of a text, in this order.
STATISTICS = (
    "size", "letters", "upper", "digits", "symbols", "exclaims", "blanks", "breaks", "stops", "word_size", "longest_word",
    "odd_words", "loud_words", "repeats", "distinct_words", "top_word", "distinct_runs", "distinct_lines", "squeezed",
)
#: Words of a run, for distinct_runs.
RUN_WORDS = 5

# classes of bytes: letters (other than ASCII included), capitals, digits, symbols, ! and ?, blanks, line ends, sentence punctuation, others
_LOWER, _UPPER, _DIGIT, _SYMBOL, _EXCLAIM, _BLANK, _BREAK, _STOP = range(8)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[128:] = _LOWER
for _letters, _kind in ((b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"0123456789", _DIGIT), (b"!?", _EXCLAIM), (b" \t", _BLANK), (b"\n\x0b\x0c\r", _BREAK), (b".,;:'\"()-", _STOP)):
    _CLASS[list(_letters)] = _kind
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes; its bytes are summed with odd factors by their place."""
    with np.errstate(over="ignore"):
        place = np.arange(len(raw), dtype=np.uint64)
        # factors of a place in the word: powers of one odd number, so that a word's hash doesn't depend on where it stands
        value = (raw.astype(np.uint64) + np.uint64(1)) * _power(place - np.repeat(starts, np.diff(np.append(starts, len(raw)))).astype(np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        return total[ends] - total[starts]


_POWERS = np.cumprod(np.full(4096, _FACTOR, np.uint64))


def _power(place: np.ndarray) -> np.ndarray:
    return _POWERS[(place & np.uint64(4095)).astype(np.int64)]


def _distinct(x: np.ndarray) -> float:
    return len(np.unique(x)) / len(x) if len(x) else 1.0


def statistics_of(text: str | None) -> list[float]:
    """The STATISTICS of a whole text; shares are of its bytes, words or lines. A null text counts as empty."""
    data = (text or "").encode()
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return [0.0] * len(STATISTICS)
    kind = _CLASS[raw]
    share = np.bincount(kind, minlength=8) / len(raw)
    inside = (kind != _BLANK) & (kind != _BREAK)
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    letters = share[_LOWER] + share[_UPPER]
    found = [math.log1p(len(raw)), letters, share[_UPPER] / letters if letters else 0.0, share[_DIGIT], share[_SYMBOL], share[_EXCLAIM], share[_BLANK], share[_BREAK], share[_STOP]]
    if len(starts):
        sizes = ends - starts
        part = raw[starts[0] :]
        words = _hashes(part, starts - starts[0], ends - starts[0])
        within = lambda k: np.add.reduceat(kind == k, starts)
        odd, loud = within(_SYMBOL) + within(_EXCLAIM) > 0, (within(_UPPER) > 1) & (within(_LOWER) == 0)
        _, counts = np.unique(words, return_counts=True)
        runs = np.zeros(0, np.uint64)
        if len(words) >= RUN_WORDS:
            n = len(words) - RUN_WORDS + 1
            with np.errstate(over="ignore"):
                runs = reduce(lambda x, k: x * _FACTOR + (words[k : k + n] ^ (words[k : k + n] >> np.uint64(29))), range(RUN_WORDS), np.zeros(n, np.uint64))
        found += [sizes.mean(), math.log1p(sizes.max()), odd.mean(), loud.mean(), (words[1:] == words[:-1]).mean() if len(words) > 1 else 0.0, len(counts) / len(words), counts.max() / len(words), _distinct(runs)]
    else:
        found += [0.0] * 8
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [float(x) for x in (*found, len(set(lines)) / len(lines) if lines else 1.0, len(zlib.compress(data, 1)) / len(data))]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the STATISTICS of every row of docs (doc_id, text, any others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = np.array([statistics_of(t) for t in batch.column(1).to_pylist()], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in rows.T)], names=["doc_id", *STATISTICS])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{x} double" for x in STATISTICS))


def held_out(doc_id: Column) -> Column:
    """crc32 of the decimal doc_id can be divided by 5. A null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Rule:
    """Statistics above a bound (above) and at most a bound (below), all of which must hold."""

    above: tuple[tuple[str, float], ...] = ()
    below: tuple[tuple[str, float], ...] = ()

    def column(self) -> Column:
        parts = [F.col(c) > F.lit(x) for c, x in self.above] + [F.col(c) <= F.lit(x) for c, x in self.below]
        return reduce(lambda x, y: x & y, parts, F.lit(True))

    def also(self, name: str, bound: float, above: bool) -> Rule:
        """With one more comparison; of two with the same side the narrower one stays."""
        old = dict(self.above if above else self.below)
        old[name] = (max if above else min)(old.get(name, bound), bound)
        new = tuple(sorted(old.items()))
        return Rule(new, self.below) if above else Rule(self.above, new)


@dataclass(frozen=True)
class Ensemble:
    """Rules with their weights."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def score(self) -> Column:
        """Probability of label 1, over the columns STATISTICS."""
        total = reduce(lambda x, y: x + y, [F.when(r.column(), F.lit(w)).otherwise(0.0) for r, w in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Ensemble:
        pairs = lambda x: tuple((c, float(v)) for c, v in x)
        found = json.loads(text)
        return cls(found["intercept"], tuple((Rule(pairs(r["above"]), pairs(r["below"])), float(w)) for r, w in found["rules"]))


def paths(node, names: list[str], so_far: Rule = Rule()) -> Iterator[Rule]:
    """The rules of a tree of the JVM: one for each node but the root."""
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        for child, above in ((node.leftChild(), False), (node.rightChild(), True)):
            rule = so_far.also(names[split.featureIndex()], split.threshold(), above)
            yield rule
            yield from paths(child, names, rule)


def training_rows(statistics: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """STATISTICS and label of the rows that have a label and aren't held out; about sample_rows by a hash of doc_id.

    labels: doc_id, quality, any others. Null labels don't count; a doc_id with several has the
    label 1 if at least half of them are 1.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    bound = min(1 << 30, int((1 << 30) * sample_rows / max(1, known.count())))
    return statistics.join(known.filter(place < bound), "doc_id").select("label", *STATISTICS)


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Ensemble:
    """Rules and weights from rows (label, STATISTICS). Where only one label occurs, or none, the score is constant."""
    n, good = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    prior = math.log((good + 1) / (n - good + 1))
    if good in (0, n):
        return Ensemble(prior)
    names = list(STATISTICS)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=SEED).fit(vectors)
    rules = sorted({r for t in forest._java_obj.trees() for r in paths(t.rootNode(), names)}, key=lambda r: (r.above, r.below))
    if not rules:
        return Ensemble(prior)
    fired = rows.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features"))
    lines = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(fired)
    weights = lines.coefficients.toArray()
    return Ensemble(float(lines.intercept), tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w))


def score(statistics: DataFrame, ensemble: Ensemble) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of statistics."""
    found = statistics.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), ensemble.score().alias("score"))
    return found.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text, any others), learned from labels (doc_id, quality, any others).

    Only text is looked at. Null and empty texts have statistics of zero and are scored by them;
    null and repeated doc_ids and repeated rows are scored row by row; without labels of both kinds
    all texts have the same score; an empty table gives an empty result.
    """
    made = stored(statistics(docs))
    return score(made, fit(training_rows(made, labels, sample_rows)))
