"""The registered queries: they run over whole tables, and those with SQL give its rows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lexarium.llm.queries import queries
from lexarium.llm.sql import oracle_sql

COLUMNS = {
    "p1_found": {"doc_id", "line_no"},
    "p2_found": {"doc_id", "seg_no", "lang"},
    "p3_found": {"rec_table", "rec_id"},
    "p4_found": {"rec_table", "id_a", "id_b"},
    "p5_found": {"rec_table", "rec_id"},
    "p6_found": {"rec_table", "rec_id", "kind"},
    "p8_found": {"case_id", "doc_id"},
    "p9_found": {"doc_id"},
}


def rows(frame, columns):
    return Counter(tuple(r[c] for c in columns) for r in frame.collect())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_queries(spark, data_dir, name):
    frame = queries()[name](spark, data_dir)
    assert set(frame.columns) == COLUMNS[name]
    got = rows(frame, sorted(COLUMNS[name]))
    assert not got or max(got.values()) == 1
    if name in oracle_sql():
        con = duckdb.connect()
        for p in Path(data_dir).glob("*.parquet"):
            con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
        found = con.execute(oracle_sql()[name])
        order = [c[0] for c in found.description]
        assert got == Counter(tuple(r[order.index(c)] for c in sorted(order)) for r in found.fetchall())


def test_p7_query(spark, data_dir):
    packed = queries()["p7_containers"](spark, data_dir)
    assert packed.select("doc_id").distinct().count() == spark.read.parquet(f"{data_dir}/documents.parquet").count()
