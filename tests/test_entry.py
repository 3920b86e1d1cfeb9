"""The driver's contract."""

import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80


def test_queries_agree_with_sql(spark, data):
    """A few queries end to end; the driver runs all of them."""
    import os

    import duckdb

    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{data}/{name}'")
    for name in ("j1_pointer_join", "f4_bm25", "g3_match_kind", "p5_found", "p7_found", "q_gate"):
        rows = entry.queries()[name](spark, data)
        columns = sorted(rows.columns)
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
        assert sorted(map(repr, (tuple(r[c] for c in columns) for r in rows.collect()))) == sorted(map(repr, want)), name
