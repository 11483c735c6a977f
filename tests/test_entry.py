"""Every query of the library against its SQL, and the driver's functions."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from kinfold.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, database, name):
    found = catalog.queries()[name](spark, SF).toPandas()
    assert plain(found) == plain(database.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_query_runs(spark, name):
    found = catalog.queries()[name](spark, SF)
    if not name.startswith("align"):
        assert found.count() > 0
        return
    rows = found.collect()
    assert rows and {len(r["residues"]) for r in rows if r["family"] == rows[0]["family"]} == {len(rows[0]["residues"])}


def test_entry_aligns(spark):
    rows = entry.entry(spark).collect()
    inputs = {(r["family"], r["label"]): r["residues"] for r in __import__("kinfold.sources.tables", fromlist=["x"]).benchmark_sequences(spark, SF).collect()}
    assert {(r["family"], r["label"]): r["residues"].replace("-", "") for r in rows} == inputs


def test_llm_is_optional():
    names = entry.queries()
    assert set(catalog.queries()) <= set(names) and set(entry.oracle_sql()) <= set(names)
    if entry.HAS_LLM:
        assert "pipeline" in names
    for p in Path(__file__).parents[1].glob("kinfold/**/*.py"):
        if "llm" not in p.parts:
            assert "kinfold.llm" not in p.read_text()
