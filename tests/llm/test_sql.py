"""The registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from textloom.llm import queries as registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    found = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    near = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    pick = lambda row, names: tuple(near(row[names.index(c)]) for c in sorted(columns))
    assert sorted((pick(r, df.columns) for r in df.collect()), key=repr) == sorted((pick(r, columns) for r in found.fetchall()), key=repr)
