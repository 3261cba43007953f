"""Every registered query against its DuckDB oracle on the smallest tables."""
import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from scorewright.plans import catalog, oracle

QUERIES = {name: E.queries()[name] for name in catalog.QUERIES}
SQL = {name: sql for name, sql in oracle.SQL.items() if name in QUERIES}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    want = _rows(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(want)
    assert got == want


def test_every_query_has_oracle_or_is_listed():
    no_oracle = set(QUERIES) - set(SQL)
    assert not no_oracle


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "advantage" in df.columns
