"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    import numpy as np

    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    v = v.item() if isinstance(v, np.generic) else v
    return None if isinstance(v, float) and math.isnan(v) else v


def names():
    from curbstone.plans import registry

    return sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", names())
def test_matches_sql(spark, name):
    import duckdb

    from curbstone.plans import registry

    df = registry.queries()[name](spark, SF)
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = c.sql(registry.oracle_sql()[name])
    order = sorted(range(len(r.columns)), key=lambda k: r.columns[k])
    assert sorted(df.columns) == [r.columns[k] for k in order]
    want = sorted(repr(tuple(plain(x[k]) for k in order)) for x in r.fetchall())
    assert sorted(repr(tuple(map(plain, x))) for x in df.select(*sorted(df.columns)).collect()) == want


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
