"""Queries that give the whole job, on small tables with the rows that were once left out."""

from __future__ import annotations

import json

import pytest

from lexarium.plans.catalog import QUERIES


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_of_every_case(spark, tmp_path):
    rows = [(1, "grün Tür", "grun Tur"), (2, "été à Noël", "ete a Noel, señor"), (3, "plain", "plane"), (4, None, "x"), (5, "é", None), (6, "", "ß"), (7, "😀 naïve", "naive")]
    spark.createDataFrame(rows, "case_id long, query string, expected_answer string").write.parquet(f"{tmp_path}/eval_cases.parquet")
    got = {r.case_id: (r.edits, r.cer) for r in QUERIES["eval_edits"](spark, str(tmp_path)).collect()}
    want = {}
    for k, a, b in rows:
        edits = None if a is None or b is None else levenshtein(a, b)
        want[k] = (edits, 1.0 if not a or b is None else pytest.approx(min(1.0, edits / len(a)), abs=1e-6))
    assert got == want


def test_whole_text_after_the_marker(spark, tmp_path):
    long = "  first line\n\nsecond CORRECTED TEXT:\nthird\t" + "and so on " * 200
    rows = [(1, long), (2, None), (3, " \n "), (4, "CORRECTED TEXT: x"), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.cleaned for r in QUERIES["ocr_after_marker"](spark, str(tmp_path)).collect()}
    assert got == {1: long.strip(), 3: " \n ", 4: "CORRECTED TEXT: x", 5: ""}


def test_blocks_without_a_page_come_last(spark, tmp_path):
    rows = [(5, 1, None, "late"), (4, 1, None, "early"), (4, 1, None, "early"), (9, 1, 1, "one here."), (2, 1, 2, "two here."), (3, 2, None, "all there is."), (6, 1, None, None)]
    spark.createDataFrame(rows, "block_key long, doc_id long, page int, text string").write.parquet(f"{tmp_path}/text_blocks.parquet")

    def run(name):
        return {r.doc_id: r.content for r in QUERIES[name](spark, str(tmp_path)).collect()}

    assert run("src_combine_pages") == {1: "one here.\n\ntwo here.\n\nearly\n\nlate", 2: "all there is."}
    assert run("ocr_markdown") == {1: "one here.\n\n## Page 2\n\ntwo here.\n\n## Page unknown\n\nearly\n\nlate", 2: "## Page unknown\n\nall there is."}
    assert {k: list(json.loads(v)["pages"].items()) for k, v in run("ocr_json").items()} == {
        1: [("1", {"text": "one here."}), ("2", {"text": "two here."}), ("unknown", {"text": "early\n\nlate"})],
        2: [("unknown", {"text": "all there is."})],
    }
