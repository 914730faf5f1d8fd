"""Queries against their SQL on the small tables."""

import os

import duckdb
import pytest

from segspark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLE_SQL[name])
    names = sorted(df.columns)
    assert sorted(c[0] for c in found.description) == names
    order = [[c[0] for c in found.description].index(n) for n in names]
    plain = lambda r: tuple(float(f"{v:.10g}") if isinstance(v, float) else v for v in r)
    assert sorted((plain(r) for r in df.select(*names).collect()), key=repr) == sorted((plain(r[i] for i in order) for r in found.fetchall()), key=repr)
