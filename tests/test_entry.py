from __future__ import annotations

import duckdb
import pytest

from orbitree.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = ("part", "orders", "customer", "events", "embeddings")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, con, name):
    df = catalog.queries()[name](spark, DATA)
    got = df.collect()
    cursor = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(got, df.columns) == _rows(cursor.fetchall(), names)
