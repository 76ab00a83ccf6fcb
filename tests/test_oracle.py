"""Every registered query of the library proper against its DuckDB SQL, on the smallest tables."""

import os

import duckdb
import pytest

from newsgrid.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or v != v:
            return None
        return str(v)[:10] if hasattr(v, "isoformat") else v.item() if hasattr(v, "item") else v

    return sorted(repr(tuple(plain(v) for v in r)) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    want = duck.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).columns
