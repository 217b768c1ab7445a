"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from tarnwave import registry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return round(float(v), 9) if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)) else v


def table(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    rows = table(df.columns, df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = duck.execute(sql)
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows == table(columns, got.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
