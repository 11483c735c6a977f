"""Tables, files and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions import residues as R
from kinfold.functions.logspace import LOG_ZERO, exp_clipped, log1p_exp, log_add
from kinfold.functions.model import PairModel, ScoreMatrix
from kinfold.operators import align, alignment, classify, evaluate, pairs, sparse
from kinfold.sources import fasta, parameters
from kinfold.streaming.families import align_stream

FAMILIES = [("f", 0, "x one", "ACDEFGHIK"), ("f", 1, "y two", "ACDFGHIK"), ("f", 2, "z", "ACDEFGIKW"), ("g", 0, "p", "MILV"), ("g", 1, "q", "MIV"), ("h", 0, "s", "WYWY")]


@pytest.fixture(scope="module")
def sequences(spark):
    return spark.createDataFrame(FAMILIES, fasta.SCHEMA)


def check(rows):
    found = {}
    for r in rows:
        found.setdefault(r["family"], {})[r["label"]] = r["residues"]
    for family, aligned in found.items():
        assert {k: v.replace("-", "") for k, v in aligned.items()} == {k: s for f, k, _, s in FAMILIES if f == family}
        assert len({len(v) for v in aligned.values()}) == 1
    assert found.keys() == {f for f, *_ in FAMILIES}
    return found


@pytest.mark.parametrize("strategy", [(0, 0, 0), (1, 1, 1), (2, 0, 0), (3, 0, 1)])
def test_alignment(sequences, strategy):
    found = check(align.align(sequences, strategy).collect())
    assert strategy[0] or found["g"] == {0: "MILV", 1: "MI-V"}
    check(align.align(sequences, strategy, keep_order=False).collect())


def test_alignment_by_votes(spark, sequences):
    chosen = classify.strategies(sequences, lambda frame: np.arange(len(frame)) % 2)
    assert {r["family"] for r in chosen.collect()} == {"f", "g"}
    every = chosen.select("family", "s1", "s2", "s3").unionByName(spark.createDataFrame([("h", 2, 0, 0)], "family string, s1 int, s2 int, s3 int"))
    check(align.align_by_strategy(sequences, every).collect())


def test_consistency_matches_dense(spark, sequences):
    scored = align.score_pairs(pairs.all_pairs(sequences), s1=0)
    cells = align.cells_of(scored).filter("family = 'f'").collect()
    size, w = [9, 8, 9], [100, 110, 120]
    p = {}
    for a in range(3):
        for b in range(3):
            p[a, b] = np.zeros((size[a], size[b]))
    for c in cells:
        p[c["a"], c["b"]][c["i"] - 1, c["j"] - 1] = c["p"]
        p[c["b"], c["a"]][c["j"] - 1, c["i"] - 1] = c["p"]
    weights = spark.createDataFrame([("f", k, x) for k, x in enumerate(w)], "family string, label int, w int")
    for weighted in (None, weights):
        found = sparse.consistency(align.cells_of(scored).filter("family = 'f'"), sequences.filter("family = 'f'"), weighted).collect()
        for a, b in ((0, 1), (0, 2), (1, 2)):
            z = 3 - a - b
            want = ((w[a] + w[b]) * p[a, b] + w[z] * p[a, z] @ p[z, b]) / sum(w) if weighted else (2 * p[a, b] + p[a, z] @ p[z, b]) / 3
            want = np.where((p[a, b] > 0) & (want >= 0.01), want, 0)
            got = np.zeros_like(want)
            for c in found:
                if (c["a"], c["b"]) == (a, b):
                    got[c["i"] - 1, c["j"] - 1] = c["p"]
            assert np.allclose(got, want)


def test_trees_by_table(sequences):
    tree = align.trees(align.score_pairs(pairs.all_pairs(sequences), s1=0), sequences)
    rows = tree.collect()
    assert {f: sum(r["family"] == f for r in rows) for f in "fgh"} == {"f": 5, "g": 3, "h": 1}
    assert align.sequence_weights(tree).count() == 6 and align.merge_schedules(tree).count() == 3


def test_features_and_training(sequences):
    features = align.pair_features(pairs.all_pairs(sequences)).collect()
    one = next(r for r in features if r["family"] == "g")
    assert one["path"] == "BBXB" and np.isclose(one["identity"], 0.75) and one["pair"] == "MILV-MIV"
    assert align.family_features(align.pair_features(pairs.all_pairs(sequences))).count() == 2
    model = align.train(sequences).model
    assert np.isclose(sum(model.init), 1) and np.isclose(sum(model.single.values()), 1)
    assert all(0 < x < 0.5 for x in model.gap_open) and all(0 < x < 1 for x in model.gap_extend)


def test_path_measures(spark):
    df = spark.createDataFrame([("BBXB", "MILV", "MIV"), ("", "", "")], "path string, a string, b string")
    found = df.select(*[c.alias(k) for k, c in pairs.path_measures(F.col("path"), F.col("a"), F.col("b")).items()]).collect()
    assert found[0]["identity"] == 0.75 and found[1]["identity"] is None


def test_expressions(spark):
    df = spark.createDataFrame([("ab.c d", -1.0, -2.0)], "s string, x double, y double")
    s, x, y = F.col("s"), F.col("x"), F.col("y")
    r = df.select(R.clean(s).alias("clean"), R.clean(s, False).alias("gaps"), log_add(x, y).alias("add"), log_add(x, F.lit(LOG_ZERO), compat=True).alias("zero"), exp_clipped(F.lit(-20.0)).alias("low"), log1p_exp(x).alias("l"), R.with_gaps(F.lit("ACD"), F.lit("BXYB"), "X").alias("path"), R.gap_columns(F.lit("A--C")).alias("cols"), R.valid(F.lit("A1")).alias("ok")).first()
    assert (r["clean"], r["gaps"], r["zero"], r["low"], r["path"], r["cols"], r["ok"]) == ("ABCD", "AB-CD", -1.0, 0.0, "AC-D", [1, 4], False)
    assert np.isclose(r["add"], np.logaddexp(-1, -2)) and np.isclose(r["l"], np.log1p(np.exp(-1)))


def test_clustal_and_annotation(spark):
    rows = spark.createDataFrame([("f", 0, "one x", "AS-W"), ("f", 1, "two", "AT-C"), ("f", 2, "three", "AA--")], fasta.SCHEMA)
    marks = {r["col"]: r["mark"] for r in alignment.annotation(rows).collect()}
    assert marks == {1: "*", 2: ":", 3: "*", 4: " "}
    text = alignment.clustal(rows).first()["text"]
    assert "one      AS-W\n" in text and text.endswith("         *:* \n")
    merged = alignment.append_files([rows.drop("header"), rows.drop("header")]).collect()
    assert sorted(r["label"] for r in merged) == list(range(6))


def test_fasta_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_text("\n>one x\nac.d\r\nef\n\n>empty\n>two\nGH I\n")
    (folder / "b").write_text(" PileUp\n Name: s1 Len: 8\n//\n\ns1  ACD.\ns2  AC~*\n\ns1  EF\ns2  GG\n")
    (folder / "c").write_text("CLUSTAL W\n\nq1  AC-D 3\nq2  ACED 4\n    ** *\nq1  EF 5\nq2  EF 6\n")
    (folder / ".hidden").write_text(">no\nA\n")
    rows = {(r["family"], r["label"]): (r["header"], r["residues"], r["valid"]) for r in fasta.read_families(spark, str(folder)).collect()}
    assert rows == {("a", 0): ("one x", "ACDEF", True), ("a", 1): ("empty", "", True), ("a", 2): ("two", "GHI", True), ("b", 0): ("s1", "ACDEF", True), ("b", 1): ("s2", "AC*GG", True), ("c", 0): ("q1", "ACDEF", True), ("c", 1): ("q2", "ACEDEF", True)}
    kept = fasta.read_families(spark, str(folder), strip_gaps=False).filter("family = 'a' AND label = 0").first()
    assert kept["residues"] == "AC-DEF"
    fasta.register(spark)
    source = spark.read.format("fasta").option("path", str(folder)).load().filter("family = 'a'").collect()
    assert [(r["label"], r["header"], r["residues"]) for r in sorted(source)] == [(0, "one x", "ACDEF"), (1, "empty", ""), (2, "two", "GHI")]
    raw = fasta.parse_raw_fasta(spark.createDataFrame([("r", "x>y\nac-\nd\n>z\nE")], "family string, content string")).collect()
    assert sorted((r["label"], r["residues"]) for r in raw) == [(0, "ac-d"), (1, "E")]


def test_fasta_round_trip(spark, tmp_path, sequences):
    long = sequences.withColumn("residues", F.repeat("residues", 20))
    fasta.write_fasta(long, str(tmp_path / "out"))
    text = next((tmp_path / "out" / "family=h").glob("part-*")).read_text()
    assert text.splitlines()[0] == ">s" and max(map(len, text.splitlines())) == 60
    back = fasta.parse_fasta(spark.read.text(str(tmp_path / "out"), wholetext=True).withColumnRenamed("value", "content"))
    assert {(r["family"], r["label"], r["residues"]) for r in back.collect()} == {(r["family"], r["label"], r["residues"]) for r in long.collect()}


def test_parameter_files(spark, tmp_path, sequences):
    parameters.write_model(spark, PairModel(), str(tmp_path / "model"))
    again = parameters.read_model(spark, str(tmp_path / "model"))
    assert np.allclose(again.init, PairModel().init) and np.isclose(again.pair["A", "W"], PairModel().pair["W", "A"], atol=1e-9)
    (tmp_path / "matrix").write_text("AB\n1,\n2 3\n")
    matrix = parameters.read_matrix(spark, str(tmp_path / "matrix"))
    assert matrix == ScoreMatrix.from_triangle("AB", [1, 2, 3]) and matrix.scores["B", "A"] == 2
    weights = parameters.boltzmann_weights(pairs.matrix_frame(spark, matrix)).collect()
    assert all(np.isclose(r["weight"], np.exp(r["s"] / 5)) for r in weights)
    (tmp_path / "pid.txt").write_text("a.b, 0.25\na.c, 0.7\n")
    (tmp_path / "sheet").write_text("a.b,0.5,0.6\na.b,0.9,0.9\n")
    bins = {r["bin"]: r for r in evaluate.bin_means(parameters.read_pids(spark, str(tmp_path / "pid.txt")), parameters.read_sheet(spark, str(tmp_path / "sheet"))).collect()}
    assert bins["0-30"]["mean_tc"] == 0.5 and bins["60-100"]["mean_tc"] == 0 and bins["0-30"]["mean_sp"] == 0.6
    rows = spark.createDataFrame([(0, 1, 2), (1, 3, 3)], "idx int, y_true int, y_pred int")
    parameters.write_predictions(rows, str(tmp_path / "pred"))
    assert sorted(parameters.read_predictions(spark, str(tmp_path / "pred")).collect()) == sorted(rows.collect())
    training = pairs.all_pairs(sequences).select("res_a", "res_b", F.lit(1).alias("cls"))
    parameters.write_training(training, str(tmp_path / "train"))
    assert sorted(parameters.read_training(spark, str(tmp_path / "train")).collect()) == sorted(training.collect())
    record = parameters.feature_text(align.pair_features(pairs.all_pairs(sequences))).filter("family = 'g'").first()["record"]
    assert record.startswith("4, BBXB, MILV-MIV, 0.750000, ") and record.endswith(";")


def test_votes_and_classes(spark):
    votes = spark.createDataFrame([("f", 3), ("f", 3), ("f", 0), ("g", 1), ("g", 2), ("t", 0), ("t", 0)], "family string, cls int")
    assert {r["family"]: r["cls"] for r in evaluate.strategy_vote(votes).collect()} == {"f": 3, "g": 1, "t": 0}
    rng = np.random.default_rng(0)
    rows = [("A" * int(n) + "C" * 5, "A" * 3 + "W" * 20, 0) if n % 2 else ("W" * int(n), "WY" * 9, 1) for n in rng.integers(5, 40, 120)]
    scores, model = classify.cross_validated(spark.createDataFrame(rows, "res_a string, res_b string, cls int"))
    assert len(scores) == 4 and min(scores) > 0.9
    x = classify.encoded(spark.createDataFrame([("ACB", "-D")], "res_a string, res_b string")).first()["x"]
    assert len(x) == 512 and x[-5:] == [1, 5, 21, 21, 4]


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "fam").write_text(">a\nACDEF\n>b\nACEF\n")
    query = align_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check"), lambda s: align.align(s, (0, 0, 0)))
    query.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["family"], r["label"], r["residues"]) for r in rows} == {("fam", 0, "ACDEF"), ("fam", 1, "AC-EF")}
