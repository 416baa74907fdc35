"""Registered SQL of the corpus queries against DuckDB, on the smallest tables."""

import duckdb
import pytest

from lumenfold.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = registry.QUERIES[name](spark, DATA)
    want = con.sql(registry.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda names, found: sorted(repr([dict(zip(names, r))[c] for c in cols]) for r in found)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in registry.QUERIES] == list(range(1, 13))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_runs_on_whole_tables(spark, name):
    out = registry.QUERIES[name](spark, DATA)
    assert len(set(out.columns)) == len(out.columns)
    n = out.count()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert n == docs or name.startswith(("op1_", "op8_")) and n > 0
