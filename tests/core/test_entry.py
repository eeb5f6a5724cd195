"""The registered queries: names, plans and, for some, equality with their SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
COMPARED = ["q_bm25_batch", "q_hybrid", "q_interleave", "q_clean_text", "q_segments", "q_source_metrics", "q_quota_select", "q_page_verdicts", "q_collection_stats"]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", COMPARED)
def test_equal_to_sql(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    relation = sql.sql(entry.oracle_sql()[name])
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_read_few_columns(spark):
    plan = entry.queries()["q_collections"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<lang:string>" in plan
