"""Every registered query with SQL gives what DuckDB gives, on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from evtrail.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v) -> str:
    if isinstance(v, float):
        return f"{v:.6g}"
    return str([plain(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in ORACLES:
        out = duck.execute(ORACLES[name])
        names = [x[0] for x in out.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(range(len(names)), key=lambda i: names[i])
        assert got == sorted(tuple(plain(row[i]) for i in order) for row in out.fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_part_keys_of_five_digits(spark, duck, tmp_path):
    spark.createDataFrame([(7, "hot rod"), (9999, "cold rod"), (12345, "cold ring")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    rows = QUERIES["x22_link_tokens"](spark, str(tmp_path)).collect()
    want = duck.execute(ORACLES["x22_link_tokens"].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet'")).fetchall()
    assert sorted(tuple(r) for r in rows) == sorted(want)


def test_part_keys_over_a_million(spark, duck, tmp_path):
    rows = [(1, 1, 1100004, 1), (1, 2, 8, 1), (2, 1, 7, 1), (2, 2, 1100008, 1), (2, 3, 9, 1), (4, 1, 1100001, 1), (4, 2, 10, 1), (4, 2, 11, 1), (9, 3, 1000016, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = duck.execute(ORACLES["v10_audit_drafts"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")).fetchall()
    assert sorted(tuple(r) for r in QUERIES["v10_audit_drafts"](spark, str(tmp_path)).collect()) == sorted(want)
