"""Every registered query against its SQL in DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from lumenfold.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    def cell(x):
        if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return None
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        if isinstance(x, (int, np.integer)):
            return int(x)
        return float(x) + 0.0 if isinstance(x, (float, np.floating)) else str(x)

    return sorted((tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(got) > 0
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_contract(spark):
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(catalog.QUERIES) <= set(q)
    assert entry.entry(spark).columns == ["video", "i", "selected", "reason"]


def test_nothing_else_imports_the_corpus_operators():
    import pathlib
    import re

    root = pathlib.Path(catalog.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"(import|from)\s+[\w.]*\bllm\b", f.read_text()), f
