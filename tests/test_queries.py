"""Every registered query with SQL against DuckDB on the smallest tables; the others must give rows."""

import datetime
import decimal
import math

import duckdb
import pytest

from gridloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


WITHOUT_SQL = {
    "a46_a47_oracles_per_season", "a46_boosted_trees",
    "a42_effective_rank", "a48_a49_shift_scores", "a49_shift_of_cells",
    "s11_fingerprints",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "None" if math.isnan(v) else f"{float(v) + 0.0:.7g}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()[:10]
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.oracle_sql():
        assert name in WITHOUT_SQL and got  # see test_brute.py
        return
    rel = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, rel.fetchall())
