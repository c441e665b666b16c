"""Every catalog query over the whole small tables, held against its SQL where there is one."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from lexarium.plans.catalog import QUERIES, SQL


def plain(value):
    if isinstance(value, (float, Decimal)):
        return round(float(value), 6) + 0.0
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="session")
def con(data_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(data_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data_dir, con, name):
    frame = QUERIES[name](spark, data_dir)
    columns = sorted(frame.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    result = con.execute(SQL[name])
    order = [c[0] for c in result.description]
    assert sorted(order) == columns
    assert got == Counter(tuple(plain(r[order.index(c)]) for c in columns) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data_dir, name):
    frame = QUERIES[name](spark, data_dir)
    rows = frame.collect()
    assert rows and all(len(r) == len(frame.columns) for r in rows)


def test_entry(spark, data_dir):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert QUERIES["rag_answers"](spark, data_dir).count() > 0
