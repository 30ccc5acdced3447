"""First references where places are shared or missing."""

import duckdb

from vellum.plans import catalog


def test_shared_and_missing_places(spark, tmp_path):
    # part, order, line, supplier
    lines = [(1, 7, 1, 9), (1, 7, 1, 2), (1, 8, 1, 1), (2, 3, 1, None), (2, 3, 2, 4), (3, None, 1, 5), (3, 6, 1, 6), (4, 1, 1, None), (None, 1, 2, 9)]
    con = duckdb.connect()
    con.execute("set threads = 1")  # else the SQL leaves open which of the rows at one place it takes
    con.execute("create table lineitem (l_partkey bigint, l_orderkey bigint, l_linenumber int, l_suppkey bigint)")
    con.executemany("insert into lineitem values (?, ?, ?, ?)", lines)
    con.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    got = catalog.QUERIES["a28_first_references"](spark, str(tmp_path)).select("source", "n_urls", "n_references")
    want = con.execute(catalog.ORACLE_SQL["a28_first_references"]).fetchall()
    assert {tuple(r) for r in got.collect()} == set(want) == {(9, 2, 4), (4, 1, 2), (6, 1, 2), (None, 1, 1)}
