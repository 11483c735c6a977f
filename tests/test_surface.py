"""Matrices by name, registered functions, the command line, files of models, and the library without llm."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from kinfold import __main__ as command
from kinfold.functions import udfs
from kinfold.functions.model import PairModel, ScoreMatrix, gap_costs, matrix_name
from kinfold.operators import classify, sparse
from kinfold.operators.lattice import pair_posterior
from kinfold.operators.trace import best_trace
from kinfold.sources import fasta, parameters, shared

ROOT = Path(__file__).parents[1]


def test_matrices_by_name_and_code(spark, tmp_path):
    assert [gap_costs(x) for x in (160, 200, 4, "vtml_200")] == [(-22.0, -1.0), (-22.15, -1.5), (-4.0, -0.25), (-22.15, -1.5)]
    for wrong in (1000, 7):
        with pytest.raises(ValueError):
            matrix_name(wrong)
    with pytest.raises(ValueError):
        gap_costs("mine")
    plain = parameters.matrix(spark, 4)
    assert plain.gaps == (-4.0, -0.25)
    assert [plain.scores[x, x] for x in "ACGTUN"] == [1, 1, 1, 1, 1, 0] and plain.scores["T", "U"] == 0
    parameters.write_matrix(spark, ScoreMatrix.by_groups(), str(tmp_path / "gonnet_160"))
    read = parameters.matrix(spark, "gonnet_160", str(tmp_path))
    assert read.scores == ScoreMatrix.by_groups().scores and read.gaps == (-22.0, -1.0)
    assert parameters.matrix(spark, 160, str(tmp_path), (-1.0, -0.5)).gaps == (-1.0, -0.5)
    with pytest.raises(ValueError):
        parameters.matrix(spark, 200)


def test_gap_costs_of_the_matrix_are_used():
    a, b = "ACGTTGCA", "ACGTGCA"
    narrow, wide = ScoreMatrix.nucleotides(), ScoreMatrix(ScoreMatrix.nucleotides().letters, ScoreMatrix.nucleotides().scores, (-40.0, -9.0))
    assert not np.allclose(pair_posterior(a, b, 1, PairModel(), narrow), pair_posterior(a, b, 1, PairModel(), wide))


def test_registered_functions(spark):
    udfs.register(spark)
    rows = [("ACDEFG", "ACDFG", 1), ("AAA", None, 1), ("", "A", 0)]
    spark.createDataFrame(rows, "a string, b string, s1 int").createOrReplaceTempView("surface_pairs")
    found = spark.sql("SELECT pair_identity(a, b) AS i, mea_score(a, b, s1) AS m, log_add(1.0D, 2.0D) AS l FROM surface_pairs").collect()
    p = pair_posterior("ACDEFG", "ACDFG", 1, PairModel(), ScoreMatrix.by_groups())
    assert found[0]["i"] == 3 / 5 and abs(found[0]["m"] - best_trace(p)[1]) < 1e-12 and abs(found[0]["l"] - np.logaddexp(1, 2)) < 1e-12
    assert found[1]["i"] is None and found[1]["m"] is None and found[2]["i"] is None and found[2]["m"] == 0
    cells = spark.sql("SELECT i, j, p FROM surface_pairs, LATERAL posterior_cells(a, b, s1)").collect()
    want = {(i + 1, j + 1): p[i, j] for i, j in zip(*np.nonzero(p >= 0.01), strict=True)}
    assert {(r["i"], r["j"]): r["p"] for r in cells} == pytest.approx(want)


def test_command_line(spark, tmp_path):
    for name, text in (("one", ">a\nACDEFGH\n>b\nACDFGH\n"), ("two", ">x\nMKV\n")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    given = command.options([str(tmp_path / "in"), "-o", str(tmp_path / "out"), "-s1", "1", "-s2", "9", "-s3", "x"])
    assert (given.s1, given.s2, given.s3) == (1, 0, 0)
    command.run(spark, given)
    rows = fasta.read_families(spark, str(tmp_path / "out"), strip_gaps=False).collect()
    assert {(r["family"], r["header"], r["residues"].replace("-", "")) for r in rows} == {("one", "a", "ACDEFGH"), ("one", "b", "ACDFGH"), ("two", "x", "MKV")}
    command.run(spark, command.options([str(tmp_path / "in"), "-o", str(tmp_path / "features"), "-G"]))
    assert "ACDEFGH-ACDFGH" in "".join(p.read_text() for p in (tmp_path / "features").rglob("part-*"))


def test_classifier_files_and_folds(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [("".join(rng.choice(list("ACDE" if c else "KLMN"), 12)), "".join(rng.choice(list("ACDE" if c else "KLMN"), 12)), int(c)) for c in rng.random(120) < 0.3]
    scores, model = classify.cross_validated(spark.createDataFrame([*rows, *rows, (None, "A", 1)], "res_a string, res_b string, cls int"))
    assert len(scores) == classify.FOLDS and min(scores) > 0.9
    classify.save(spark, model, str(tmp_path / "model"))
    again = classify.load(spark, str(tmp_path / "model"))
    import pandas as pd

    frame = pd.DataFrame(rows, columns=["res_a", "res_b", "cls"])
    assert (again(frame) == model(frame)).all() and np.array_equal(again.weights, model.weights)


def test_consistency_against_matrix_products(spark):
    rng = np.random.default_rng(5)
    sizes = {0: 30, 1: 25, 2: 28, 3: 22}
    dense = {(a, b): rng.random((sizes[a], sizes[b])) * (rng.random((sizes[a], sizes[b])) < 0.2) for a in sizes for b in sizes if a < b}
    rows = [("f", a, b, int(i) + 1, int(j) + 1, float(p[i, j])) for (a, b), p in dense.items() for i, j in zip(*np.nonzero(p), strict=True)]
    cells = spark.createDataFrame(rows, "family string, a int, b int, i int, j int, p double")
    sequences = spark.createDataFrame([("f", k) for k in sizes], "family string, label int")
    weights = spark.createDataFrame([("f", k, 10 + 3 * k) for k in sizes], "family string, label int, w int")
    full = dense | {(b, a): p.T for (a, b), p in dense.items()}
    for w, given in (({k: 1.0 for k in sizes}, None), ({k: 10 + 3 * k for k in sizes}, weights)):
        want = {}
        for (a, b), p in dense.items():
            total = ((w[a] + w[b]) * p + sum(w[z] * full[a, z] @ full[z, b] for z in sizes if z not in (a, b))) / sum(w.values())
            total = np.where((p > 0) & (total >= 0.01), total, 0)
            want |= {(a, b, int(i) + 1, int(j) + 1): total[i, j] for i, j in zip(*np.nonzero(total), strict=True)}
        found = {(r["a"], r["b"], r["i"], r["j"]): r["p"] for r in sparse.consistency(cells, sequences, given).collect()}
        assert found == pytest.approx(want)


def test_tables_of_the_shared_folder_can_be_deleted(spark):
    kept = shared.stored(spark.range(3))
    folder = Path(shared.shared_dir(spark).removeprefix("file:"))
    assert kept.count() == 3 and any((folder / "tables").iterdir())
    shared.forget_tables(spark)
    assert not (folder / "tables").exists()


def test_everything_else_works_without_llm(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert not e.HAS_LLM and 'pipeline' not in q and 'align_family' in q and not [k for k in q if k.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, check=True)
    assert not [p for p in copy.rglob("*.py") if "kinfold.llm" in p.read_text() and p.name not in ("__spark_entry__.py", "test_entry.py", "test_surface.py")]


def test_command_trains_classifies_and_aligns(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for f, rows in {"x": ["ACDEFGHIK", "ACDFGHIK", "ACEFGHIKL"], "y": ["MILVWY", "MIVWY"], "alone": ["ACD"]}.items():
        (tmp_path / "in" / f).write_text("".join(f">{f}{k}\n{r}\n" for k, r in enumerate(rows)))
    at = lambda *x: str(tmp_path.joinpath(*x))
    assert command.run(spark, command.options([at("in"), "-o", at("model"), "-T", "2"])) > 0
    trained = parameters.read_model(spark, at("model"))
    assert trained.gap_open != PairModel().gap_open and parameters.read_model(spark, at("model-steps", "step=2")) == trained
    (tmp_path / "pairs.csv").write_text("Seqs,Class\n" + "".join(f"ACD{'W' * (k % 9)}-ACD,{k % 2}\n" for k in range(18)))
    command.run(spark, command.options(["-C", at("pairs.csv"), "-o", at("net"), "--epochs", "2"]))
    command.run(spark, command.options([at("in"), "-o", at("out"), "-c", at("net"), "-m", at("model")]))
    rows = fasta.read_families(spark, at("out"), strip_gaps=False).collect()
    assert {(r["family"], r["header"]) for r in rows} == {("x", "x0"), ("x", "x1"), ("x", "x2"), ("y", "y0"), ("y", "y1"), ("alone", "alone0")}
    for f in ("x", "y"):
        assert len({len(r["residues"]) for r in rows if r["family"] == f}) == 1
    with pytest.raises(SystemExit):
        command.options(["-o", "x"])
