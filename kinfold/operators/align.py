"""Alignment of families as a chain of tables: pairs, posteriors, trees, consistency, alignment.

Pair kernels run per pair and are dealt by (family, a, b), so a large family spreads. The tree of
a family is built in one task, and so are the merges of each of its subtrees; the merges above
them and the refinement of large families are joins and one task for each merge (see levels).
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.model import CUTOFF, PairModel, ScoreMatrix
from kinfold.operators import levels, sparse
from kinfold.operators.hmm import viterbi
from kinfold.operators.lattice import Counts, Kernel
from kinfold.operators.pairs import all_pairs
from kinfold.operators.progressive import FEW_ROUNDS, LARGE
from kinfold.operators.trace import best_trace, distance
from kinfold.operators.tree import build_tree, merge_order, nodes_of, weights
from kinfold.sources.parameters import read_model, write_model
from kinfold.sources.shared import stored

CONSISTENCY_ROUNDS = 2
DEFAULT_STRATEGY = (3, 0, 0)

_SCORED = "family string, a int, b int, d double, i array<int>, j array<int>, p array<double>"
_TREE = "family string, node int, left int, right int, parent int, dist double, is_leaf boolean, n_leaves int"


def score_pairs(pairs: DataFrame, model: PairModel | None = None, matrix: ScoreMatrix | None = None, s1: int = DEFAULT_STRATEGY[0], timed: bool = False) -> DataFrame:
    """family, a, b, d (distance) and the cells of posterior that reach the cutoff as arrays i, j, p.

    s1: 0 pair-HMM, 1 partition function, 2 both, 3 both and the local model, by root mean square;
    pairs (family, a, b, res_a, res_b) may have a column s1 of its own. A task takes its pairs in
    batches of like length; a long pair goes alone, in memory for a byte and a number per cell. timed
    adds seconds, a pair's share by its cells of the time that its batch took on the clock.
    """
    model, matrix = model or PairModel(), matrix or ScoreMatrix.by_groups()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernel = Kernel(model, matrix)
        for frame in frames:
            for kind, part in frame.groupby("s1"):
                order: list[int] = []
                rows, keys, began = [], part[["family", "a", "b"]].to_numpy(object), time.perf_counter()
                for k, p in kernel(list(zip(part["res_a"], part["res_b"], strict=True)), int(kind)):
                    _, score = best_trace(p)
                    i, j = np.nonzero(p >= CUTOFF)
                    rows.append((*keys[k], distance(score, *p.shape), i + 1, j + 1, p[i, j]))
                    order.append(k)
                found = pd.DataFrame(rows, columns=["family", "a", "b", "d", "i", "j", "p"])
                if timed:
                    cells = np.array([len(part["res_a"].iloc[k]) * len(part["res_b"].iloc[k]) for k in order], float)
                    found["seconds"] = (time.perf_counter() - began) * cells / max(1.0, cells.sum())
                yield found

    given = pairs if "s1" in pairs.columns else pairs.withColumn("s1", F.lit(s1))
    dealt = given.select("family", "a", "b", "res_a", "res_b", "s1").repartition("family", "a", "b")
    return dealt.mapInPandas(run, f"{_SCORED}, seconds double" if timed else _SCORED)


def cells_of(scored: DataFrame) -> DataFrame:
    """family, a, b, i, j, p."""
    return scored.select("family", "a", "b", F.explode(F.arrays_zip("i", "j", "p")).alias("c")).select("family", "a", "b", "c.*")


def trees(distances: DataFrame, sequences: DataFrame, linkage: int = 0) -> DataFrame:
    """The guide tree of each family as rows of nodes; the leaves are the labels in order, -1 stands for none.

    sequences (family, label) may have a column s2, the linkage of its family.
    """

    def run(key, frame, pairs):
        labels = np.sort(frame["label"].to_numpy())
        d = np.zeros((len(labels), len(labels)))
        i, j = (np.searchsorted(labels, pairs[c].to_numpy()) for c in ("a", "b"))
        d[i, j] = d[j, i] = pairs["d"].to_numpy()
        nodes = build_tree(d, int(frame["s2"].iloc[0]) if len(frame) else 0)
        return pd.DataFrame([(key[0], k, n.left, n.right, n.parent, n.dist, n.left < 0, n.leaves) for k, n in enumerate(nodes)], columns=[c.split()[0] for c in _TREE.split(", ")])

    s2 = F.col("s2") if "s2" in sequences.columns else F.lit(linkage)
    return sequences.select("family", "label", s2.alias("s2")).groupBy("family").cogroup(distances.select("family", "a", "b", "d").groupBy("family")).applyInPandas(run, _TREE)


def sequence_weights(tree: DataFrame) -> DataFrame:
    """family, label, w."""

    def run(key, frame):
        w = weights(nodes_of(frame), int(frame["is_leaf"].sum()))
        return pd.DataFrame({"family": key[0], "label": range(len(w)), "w": w})

    return tree.groupBy("family").applyInPandas(run, "family string, label int, w int")


def merge_schedules(tree: DataFrame) -> DataFrame:
    """family, ord, depth, left_ord, right_ord, left_leaves, right_leaves."""
    schema = "family string, ord int, depth int, left_ord int, right_ord int, left_leaves array<int>, right_leaves array<int>"

    def run(key, frame):
        columns = [c.split()[0] for c in schema.split(", ")]
        return pd.DataFrame([{"family": key[0], **m} for m in merge_order(nodes_of(frame))], columns=columns)

    return tree.groupBy("family").applyInPandas(run, schema)


def merge_families(sequences: DataFrame, cells: DataFrame, tree: DataFrame, s1: int | DataFrame, keep_order: bool = True, rounds: bool = True, hold=stored, most: int = LARGE - 1) -> DataFrame:
    """family, label, row, header, residues of the final alignments.

    row is the place of a sequence in the output: its label if keep_order, else the order of the last merge.
    s1, a number or a table (family, s1), sets the rounds of refinement. Subtrees of at most most
    sequences are merged in a task each; what is above them, in larger families, goes level by level.
    """
    kinds = s1 if isinstance(s1, DataFrame) else None
    parts = hold(levels.subtrees(tree, sequences, most))
    given = sequences.select("family", "label", "residues").join(parts.select("family", "label", "root", "leaf", "w", "n"), ["family", "label"])
    given = given.join(kinds.select("family", "s1"), "family") if kinds is not None else given.withColumn("s1", F.lit(s1))
    done = hold(levels.merge_subtrees(given, cells, parts, keep_order, rounds))
    whole, state = done.filter("n <= size").select("family", "label", "place", "residues"), done.filter("n > size")
    # the loops are as long as the tallest tree above its subtrees, and run only if a family is that large
    schedule = levels.merges_above(tree, most)
    tallest = schedule.agg(F.max("level")).first()[0] or 0
    if tallest:
        schedule, state = hold(schedule), hold(state.select("family", F.col("root").alias("node"), "place", "label", "residues", "w"))
        for level in range(1, tallest + 1):
            state = hold(levels.merge_level(state, cells, schedule.filter(F.col("level") == level)))
        state = state.select("family", "place", "label", "residues")
        if keep_order:
            state = levels.in_order(state, "label")
        for k in range(FEW_ROUNDS if rounds else 0):
            state = hold(levels.refine_round(state, cells, k))
        whole = whole.unionByName(levels.in_order(state, "label" if keep_order else "place").select("family", "label", "place", "residues"))
    return whole.join(sequences.select("family", "label", "header"), ["family", "label"]).select("family", "label", F.col("place").alias("row"), "header", "residues")


def align(sequences: DataFrame, strategy: tuple[int, int, int] = DEFAULT_STRATEGY, model: PairModel | None = None, matrix: ScoreMatrix | None = None, keep_order: bool = True, hold=stored) -> DataFrame:
    """Align every family of sequences (family, label from 0, header, residues).

    strategy is s1 (posterior model), s2 (linkage) and s3 (weighted consistency). hold keeps a
    table that is used more than once: it is written to the shared folder, so that a lost executor
    costs no pair kernel again; sources.shared.forget_tables deletes such tables.
    """
    s1, s2, s3 = strategy
    scored = hold(score_pairs(all_pairs(sequences), model, matrix, s1))
    cells, tree = cells_of(scored), hold(trees(scored, sequences, s2))
    w = sequence_weights(tree) if s3 else None
    for _ in range(CONSISTENCY_ROUNDS):
        cells = hold(sparse.consistency(cells, sequences, w))
    return merge_families(sequences, cells, tree, s1, keep_order, hold=hold)


def align_by_strategy(sequences: DataFrame, strategies: DataFrame, model: PairModel | None = None, matrix: ScoreMatrix | None = None, keep_order: bool = True, hold=stored) -> DataFrame:
    """Align each family by its own strategy (family, s1, s2, s3), all families in one pass.

    Families that strategies lacks are left out. Consistency without weights is that with weights of one.
    """
    given = sequences.join(strategies.select("family", "s1", "s2", "s3"), "family")
    scored = hold(score_pairs(all_pairs(given).join(strategies.select("family", "s1"), "family"), model, matrix))
    cells, tree = cells_of(scored), hold(trees(scored, given))
    w = sequence_weights(tree).join(strategies.select("family", "s3"), "family")
    w = hold(w.select("family", "label", F.when(F.col("s3") == 1, F.col("w")).otherwise(1).alias("w")))
    for _ in range(CONSISTENCY_ROUNDS):
        cells = hold(sparse.consistency(cells, given, w))
    return merge_families(given, cells, tree, strategies, keep_order, hold=hold)


def pair_features(pairs: DataFrame, model: PairModel | None = None, matrix: ScoreMatrix | None = None) -> DataFrame:
    """family, a, b, path_len, path, pair, identity, emission, score of the Viterbi alignment of each pair.

    emission is the mean pair emission, score the mean of scores from -4 to 11, both per column;
    pairs with a letter outside the tables add nothing.
    """
    model, matrix = model or PairModel(), matrix or ScoreMatrix.by_groups()
    schema = "family string, a int, b int, path_len int, path string, pair string, identity double, emission double, score double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                path, _ = viterbi(r.res_a, r.res_b, model)
                a, b, found = iter(r.res_a), iter(r.res_b), []
                for step in path:
                    x, y = next(a) if step != "Y" else "", next(b) if step != "X" else ""
                    if step == "B":
                        found.append((x, y))
                n = max(1, len(path))
                scores = [s for xy in found if (s := matrix.scores.get(xy)) is not None and -4 <= s <= 11]
                rows.append((r.family, r.a, r.b, len(path), path, f"{r.res_a}-{r.res_b}", sum(x == y for x, y in found) / n, sum(model.pair.get(xy, 0.0) for xy in found) / n, sum(scores) / n))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return pairs.select("family", "a", "b", "res_a", "res_b").repartition("family", "a", "b").mapInPandas(run, schema)


def family_features(features: DataFrame) -> DataFrame:
    """Means and population deviations of the pair features of each family."""
    each = ("identity", "emission", "score")
    return features.groupBy("family").agg(*[F.avg(c).alias(f"mean_{c}") for c in each], *[F.stddev_pop(c).alias(f"sd_{c}") for c in each])


def expected_parameters(pairs: DataFrame, model: PairModel | None = None) -> DataFrame:
    """family, a, b, key, value: expected use of the model's parameters in each pair: init:s, move:s:t, pair:xy, single:x.

    Letters that the model lacks are one letter, ?. A pair with an empty sequence has no row.
    """
    model = model or PairModel()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernel = Kernel(model, ScoreMatrix.by_groups())
        names = np.array([*kernel.letters, "?"])
        linked = np.isfinite(model.transitions())
        for frame in frames:
            texts, keys = list(zip(frame["res_a"], frame["res_b"], strict=True)), frame[["family", "a", "b"]].to_numpy(object)
            for numbers, c in kernel.counts(texts):
                rows = []
                for q, k in enumerate(numbers):
                    x, y = (np.unique(kernel.code(t)) for t in texts[k])
                    pairs_of = np.unique(np.sort([(i, j) for i in x for j in y], axis=1), axis=0)
                    rows += [(*keys[k], f"init:{s}", v) for s, v in enumerate(c.init[q].tolist())]
                    rows += [(*keys[k], f"move:{s}:{t}", c.moves[q, s, t]) for s, t in np.argwhere(linked).tolist()]
                    rows += [(*keys[k], f"pair:{names[i]}{names[j]}", c.match[q, i, j] + (c.match[q, j, i] if i != j else 0.0)) for i, j in pairs_of.tolist()]
                    rows += [(*keys[k], f"single:{names[i]}", c.single[q, i]) for i in np.union1d(x, y).tolist()]
                yield pd.DataFrame(rows, columns=["family", "a", "b", "key", "value"])

    return pairs.select("family", "a", "b", "res_a", "res_b").repartition("family", "a", "b").mapInPandas(run, "family string, a int, b int, key string, value double")


def step_sums(pairs: DataFrame, model: PairModel) -> tuple[np.ndarray, float]:
    """Expected counts as one vector, and the log probability: means over the pairs of each family, then over families.

    A task adds up the vectors of each family's pairs; what is shuffled has as many rows as tasks,
    families and parameters, what the driver gets as many as there are parameters.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernel, sums = Kernel(model, ScoreMatrix.by_groups()), {}
        for frame in frames:
            families = frame["family"].to_numpy()
            for numbers, c in kernel.counts(list(zip(frame["res_a"], frame["res_b"], strict=True))):
                vectors = np.column_stack([c.vectors(), c.logs, np.ones(len(numbers))])
                for family in set(families[numbers]):
                    sums[family] = sums.get(family, 0.0) + vectors[families[numbers] == family].sum(axis=0)
        if sums:
            yield pd.DataFrame({"family": list(sums), "v": list(sums.values())})

    dealt = pairs.select("family", "a", "b", "res_a", "res_b").repartition("family", "a", "b")
    parts = dealt.mapInPandas(run, "family string, v array<double>").select("family", F.element_at("v", -1).alias("pairs"), F.posexplode("v").alias("at", "x"))
    means = parts.groupBy("family", "at").agg((F.sum("x") / F.sum("pairs")).alias("x")).groupBy("at").agg(F.avg("x").alias("x")).orderBy("at").collect()
    vector = np.array([r["x"] for r in means])
    return vector[:-2], float(vector[-2]) if len(vector) else 0.0


def reestimated(vector: np.ndarray, model: PairModel) -> PairModel:
    """Model parameters from counts; the gap parameters of both states of a pair are tied, emissions normalised.

    What was never used keeps its old value; letters that the model lacks don't count.
    """
    letters = Kernel(model, ScoreMatrix.by_groups()).letters
    init, moves, match, single = Counts.of_vector(vector, len(model.init), len(letters) + 1)
    starts = np.array([init[0], *[(init[2 * k + 1] + init[2 * k + 2]) / 2 for k in (0, 0, 1, 1)]])
    whole, leaving = starts.sum() or 1.0, moves[0].sum() or 1.0
    opened, longer = [], []
    for k in (0, 1):
        x, y = 2 * k + 1, 2 * k + 2
        opened += [float((moves[0, x] + moves[0, y]) / (2 * leaving))] * 2
        inside = moves[[x, y]].sum() or 1.0
        longer += [float((moves[x, x] + moves[y, y]) / inside)] * 2
    match, single = match[:-1, :-1], single[:-1]
    match = match + match.T - np.diag(np.diag(match))  # of two letters in either order
    once = np.triu(match).sum()
    pair = {(x, y): float(match[i, j] / once) for i, x in enumerate(letters) for j, y in enumerate(letters) if match[i, j] > 0} if once else model.pair
    alone = {x: float(v / single.sum()) for x, v in zip(letters, single, strict=True) if v > 0} if single.sum() else model.single
    return PairModel(tuple((starts / whole).tolist()), tuple(opened), tuple(longer), alone, pair)


@dataclass
class Trained:
    """The model that training began with and those after each step, and the log probability before each step: of a pair, in the mean of families."""

    models: list[PairModel]
    logs: list[float]

    @property
    def model(self) -> PairModel:
        return self.models[-1]


def _saved(spark: SparkSession, folder: str, step: int) -> PairModel | None:
    path = f"{folder}/step={step}"
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return read_model(spark, path) if found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found) else None


def train(sequences: DataFrame, model: PairModel | None = None, steps: int = 1, tolerance: float = 0.0, folder: str | None = None, hold=stored) -> Trained:
    """Expectation maximisation: counts are averaged over pairs, then over families, at most steps times.

    It ends early when a step raises the log probability by less than tolerance. With a folder every
    step's model is written there, and a later run with the same folder goes on behind the last one.
    Sequences of one row, or without letters, have no pair; where there is none the model stays.
    """
    model, spark = model or PairModel(), sequences.sparkSession
    pairs, logs, begun = hold(all_pairs(sequences).filter("len_a > 0 AND len_b > 0")), [], 0
    while folder and (found := _saved(spark, folder, begun + 1)) is not None:
        model, begun = found, begun + 1
    models = [model]
    for step in range(begun, steps):
        vector, log = step_sums(pairs, models[-1])
        if not len(vector):
            break
        logs.append(log)
        models.append(reestimated(vector, models[-1]))
        if folder:
            write_model(spark, models[-1], f"{folder}/step={step + 1}")
        if len(logs) > 1 and logs[-1] - logs[-2] < tolerance:
            break
    return Trained(models, logs)
