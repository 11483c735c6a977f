"""Registered queries against their SQL on made tables with odd rows."""

from collections import Counter

import duckdb

import __spark_entry__ as entry


def both(spark, tmp_path, query, table, rows, schema):
    """Rows of the query and of its SQL over one made table."""
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = Counter(map(tuple, entry.queries()[query](spark, str(tmp_path)).collect()))
    return got, Counter(con.sql(entry.oracle_sql()[query]).fetchall())


def test_token_pad512_texts_without_residues(spark, tmp_path):
    texts = [None, "", " 12\n", "B-J", "A", "ac" * 256, "ac" * 256 + "D", "ſK", "ß\n\nQ"]
    got, want = both(spark, tmp_path, "token_pad512", "documents", [*enumerate(texts), (None, "ACD"), (1, "")], "doc_id long, text string")
    assert got == want and got[1, "0 " * 511 + "1"] == 2


def test_nearest_pair_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    families = {
        0: [(3, None), (1, None), (2, [1.0])],
        1: [(3, None), (1, [nan]), (2, [1.0])],
        2: [(3, None), (1, [inf]), (2, [1.0]), (4, [inf])],
        3: [(1, [1.0, None, 2.0]), (2, [1.0, 5.0]), (3, [4.0] * 70), (4, [4.0] * 64 + [9.0] * 6)],
        4: [(1, []), (2, [])],
        5: [(1, [1.0]), (1, [2.0]), (1, [2.0])],
        6: [(1, [1.0]), (1, [1.0]), (4, [2.0]), (6, [3.0]), (5, [3.0]), (None, [2.0])],
        7: [(9, [1.0, 2.0]), (7, [1.0, 2.5]), (8, [0.5, 2.0]), (2, [1.0, 2.0, 5.0])],
        8: [(5, [0.1] * 64), (3, [0.1] * 64), (4, [-0.0] * 64), (2, [0.0] * 64)],
        9: [(1, [1.0, None]), (1, [nan, 1.0]), (2, [1.0, nan]), (3, [7.0, 8.0]), (-4, [1e30] * 64)],
        10: [(1, [1.0])],
        None: [(1, [1.0]), (2, [1.0])],
    }
    rows = [(i, e, label) for label, vectors in families.items() for i, e in vectors]
    got, want = both(spark, tmp_path, "nearest_pair", "embeddings", rows, "vec_id long, embedding array<float>, label int")
    assert {tuple(map(str, r)) for r in got} == {tuple(map(str, r)) for r in want} and len(got) == 9
