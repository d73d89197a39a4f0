"""Every registered query against its SQL on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from cladewise.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, Decimal)):
        return None if math.isnan(v) else float(v)
    return str(v)


def sorted_rows(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(([plain(r[i]) for i in at] for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cur = duck.execute(registry.oracles()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = sorted_rows([tuple(r) for r in df.collect()], df.columns), sorted_rows(cur.fetchall(), columns)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-6 * max(1, abs(a))) for a, b in zip(g, w)), (g, w)
