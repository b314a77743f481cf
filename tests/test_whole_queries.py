"""Queries over whole tables: every input row is in the result."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, share", [("union_all_whole", "SELECT 2 * count(*) FROM events"), ("order_range_place", "SELECT count(DISTINCT l_orderkey) FROM lineitem")])
def test_whole(spark, name, share):
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = sorted(map(tuple, entry.queries()[name](spark, FOLDER).collect()))
    assert got == sorted(con.execute(entry.oracle_sql()[name]).fetchall())
    assert len(got) == con.execute(share).fetchone()[0]
