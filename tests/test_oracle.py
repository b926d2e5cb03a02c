"""Every SQL-checked query equals its DuckDB statement on the smallest tables."""

from __future__ import annotations

import math

import pytest

from churnscope.plans.catalog import CATALOG
from tests.conftest import SF_SMALL

SQL_KEYS = [k for k, q in CATALOG.items() if q.sql is not None]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("key", SQL_KEYS)
def test_query_matches_duckdb(spark, duck, key):
    q = CATALOG[key]
    sdf = q.spark(spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(q.oracle())
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _rows(sdf.columns, srows) == _rows(dcols, drows)


def test_every_key_is_a_query_and_sql_keys_are_a_subset():
    import __spark_entry__ as entry

    assert set(CATALOG) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
