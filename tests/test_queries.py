"""Every registered query with SQL against DuckDB on the small tables; the rest must give rows."""

import glob
import os

import duckdb
import pytest
from conftest import SMALL

from quillrisk.plans import episode_queries, feature_queries, more_queries, queries, risk_queries, scenario_queries, signal_queries, source_queries, stream_queries  # noqa: F401


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return (a is None) == (b is None) and (a is None or abs(float(a) - float(b)) <= 1e-7 * max(1.0, abs(float(a))))
    return a == b


def key(row):
    return [f"{v:.5g}" if isinstance(v, float) else str(v) for v in row]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tables, name):
    df = queries.QUERIES[name](spark, SMALL)
    rows = df.collect()
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    found = tables.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(df.columns)
    columns = sorted(df.columns)
    want = sorted(([r[found.columns.index(c)] for c in columns] for r in found.fetchall()), key=key)
    got = sorted(([r[c] for c in columns] for r in rows), key=key)
    assert len(got) == len(want) and all(all(map(close, g, w)) for g, w in zip(got, want))
