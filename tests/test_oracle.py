"""Every query with SQL, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from mnemoscope.plans.queries import QUERIES, SQL
from mnemoscope.sources.catalog import TABLES


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        if hasattr(x, "isoformat"):
            return x.isoformat()
        return round(float(x), 6) if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else x

    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    got = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert got
        return
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, cursor.fetchall())


def test_registry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 10
