"""Ingest, comparison, conversation, embedders and errors."""

from __future__ import annotations

import json
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarium import errors
from lexarium.functions import embed
from lexarium.operators import compare
from lexarium.plans import ingest as I
from lexarium.plans.pipeline import Pipeline
from lexarium.sources.store import VectorStore, shard_batches


def test_ingest_and_ask(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("The pump stands in hall four. It was checked in May.")
    (tmp_path / "in" / "b.md").write_text("Valves are tested every week. Two people sign.")
    box = VectorStore(spark, str(tmp_path / "store"))
    I.ingest(spark, str(tmp_path / "in"), box)
    assert box.count() == 4
    pipe = Pipeline(box.as_retriever(4))
    answers = {r.query_id: r for r in pipe.answer(spark.createDataFrame([(1, "where does the pump stand")], "query_id long, query string")).collect()}
    assert answers[1].answer == "The pump stands in hall four."
    turns = spark.createDataFrame([(1, 0, "human", "hi"), (1, 1, "ai", "hello")], "conv_id long, turn long, role string, text string")
    said, history = pipe.converse(spark.createDataFrame([(1, "are valves tested")], "conv_id long, query string"), turns, 1)
    assert "Human: hi\nAssistant: hello" in said.first()["prompt"]
    assert [(r.turn, r.role) for r in history.orderBy("turn").collect()] == [(2, "human"), (3, "ai")]


def test_compare_documents(spark):
    a = "# One\n\nalpha beta gamma delta epsilon\n\n# Two\n\nold words stay here now"
    b = "# One\n\nalpha beta gamma delta epsilon\n\n# Three\n\nbrand new text in this part"
    documents = spark.createDataFrame([(1, a), (2, b)], "doc_id long, content string")
    pairs = spark.createDataFrame([(7, 1, 2)], "pair_id long, source_doc long, target_doc long")
    got = I.compare_documents(documents, pairs).collect()
    kinds = sorted(r.result_type for r in got)
    assert kinds.count("DELETED") == 2 and kinds.count("NEW") == 2 and {r.source_text for r in got if r.result_type == "DELETED"} == {"Two", "old words stay here now"}
    frame = I.compare_documents(documents, pairs)
    assert compare.diff_summary(frame).first()["NEW"] == 2
    for style, mark in (("markdown", "**[NEW]**"), ("html", ": NEW</div>"), ("text", "[NEW]")):
        assert compare.diff_report(frame, style=style).first()["report"].count(mark) == 2
    for bad in ({"kind": "x"}, {"strategy": "x"}):
        with pytest.raises(ValueError):
            I.compare_documents(documents, pairs, **bad)


def test_shard_batches():
    assert shard_batches([4, 4, 4, 20, 1], 10) == [0, 0, 1, 2, 3]


def test_embedders(spark):
    v = embed.seeded_vector("a story of the moon")
    assert len(v) == 384 and np.linalg.norm(v) == pytest.approx(1, abs=1e-5) and min(v[:5]) > max(v[20:])
    rows = spark.createDataFrame([(1, "text one", "text"), (2, "t", "table"), (3, None, "text")], "id int, content string, kind string")
    model = embed.model_embedding(lambda: lambda texts: np.ones((len(texts), 3)))
    got = rows.select(F.size(embed.seeded_embedding(F.col("content"), 8)).alias("a"), model(F.col("content")).alias("b")).collect()
    assert [r.a for r in got][:2] == [8, 8] and [len(r.b) for r in got] == [3, 3, 3]


def test_errors(spark):
    @errors.guarded(default=3, reraise=False)
    def broken():
        raise FileNotFoundError("no file")

    assert broken() == 3

    @errors.guarded()
    def worse():
        raise ValueError("bad")

    with pytest.raises(errors.LexariumError) as caught:
        worse()
    assert caught.value.code == 401 and caught.value.as_dict()["cause"] == "ValueError: bad"
    row = spark.range(2).select(errors.error_column(F.col("id") == 0, errors.Category.PIPELINE, 2, "no hits").alias("e")).collect()
    assert row[0].e.code == 702 and row[1].e is None
    record = logging.LogRecord("x", logging.INFO, "f", 1, "said %s", ("it",), None)
    record.context = {"query": 1}
    assert json.loads(errors.JsonFormatter().format(record)) == {"level": "INFO", "logger": "x", "message": "said it", "query": 1}


def test_wrapped(spark):
    text = " ".join(["word"] * 60)
    lines = spark.createDataFrame([(text,)], "t string").select(compare.wrapped("t").alias("w")).first()["w"].split("\n")
    assert max(map(len, lines)) <= 100 and " ".join(lines) == text
