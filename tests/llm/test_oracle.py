"""The operators' SQL in DuckDB gives the rows of their queries."""

import duckdb
import pytest

from gridloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.execute(ORACLE[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, rel.fetchall())) == sorted(tuple(r) for r in df.select(*names).collect())
