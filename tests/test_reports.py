"""Reports, analyses, recognised documents, retrieval and file queries against golden values and brute force."""

from __future__ import annotations

import random
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarium.functions import embed
from lexarium.operators import compare, context, evaluation, ocr_text, search
from lexarium.session import shared_folder
from lexarium.sources import readers

COMPARED = "pair_id long, source_idx int, target_idx int, source_text string, target_text string, similarity double, result_type string"


def compared(spark):
    rows = [(1, 0, 0, "# A", "# A", 1.0, "SIMILAR"), (1, 1, 1, "the old <text>", "the new <text>", 0.855, "MODIFIED"), (1, 2, None, "gone", None, None, "DELETED"), (1, None, 2, None, "come", None, "NEW"), (2, 0, 0, None, "", 0.0, "DIFFERENT")]
    return spark.createDataFrame(rows, COMPARED)


SUMMARY = "## Summary\n\n- Similar sections: 1\n- Modified sections: 1\n- Different sections: 0\n- New: 1\n- Deleted: 1\n\n## Details\n\n"


def test_markdown_report(spark):
    got = {r.pair_id: r.report for r in compare.diff_report(compared(spark), title="Two files").collect()}
    assert got[1] == (
        "# Two files\n\n" + SUMMARY + "### Section 1: SIMILAR\n\n*Similarity: 1.00*\n\n**[SIMILAR]**\n\n```\n# A\n```\n\n---\n\n"
        "### Section 2: MODIFIED\n\n*Similarity: 0.86*\n\n**[MODIFIED]**\n\nSource:\n```\nthe old <text>\n```\nTarget:\n```\nthe new <text>\n```\n\n---\n\n"
        "### Section 3: DELETED\n\n**[DELETED]**\n\n```\ngone\n```\n\n---\n\n### Section 4: NEW\n\n**[NEW]**\n\n```\ncome\n```\n\n---\n"
    )
    assert "Source:\n```\n\n```\nTarget:\n```\n\n```" in got[2]


def test_reports_of_other_styles(spark):
    text = {r.pair_id: r.report for r in compare.diff_report(compared(spark), show_similar=False, style="text", detailed=True).collect()}[1]
    assert text.startswith("SUMMARY\n=======\n\nSimilar sections: 1\n") and "Section 1" not in text
    assert "Section 2: MODIFIED\n-------------------\n\nSimilarity: 0.86\n\n[MODIFIED]\n\nSource:\nthe old <text>\n\nTarget:\nthe new <text>\n\nDiff:\n--- source\n+++ target\n" in text
    page = {r.pair_id: r.report for r in compare.diff_report(compared(spark), style="html", title="A & B").collect()}[1]
    assert "<h1>A &amp; B</h1>" in page and "<li>New: 1</li>" in page and "the old &lt;text&gt;" in page and page.count("<div class='section ") == 4 and page.endswith("</body>\n</html>")
    with pytest.raises(ValueError):
        compare.diff_report(compared(spark), style="pdf")
    assert compare.diff_report(compared(spark).limit(0)).count() == 0


def test_analysis(spark):
    rows = [(1, 0, 0, "a text long enough to ask", "another text that is long enough", 0.5, "DIFFERENT"), (1, 1, 1, "short", "short too", 0.5, "DIFFERENT"), (1, 2, 2, "a text long enough to ask", "a text long enough to ask", 1.0, "SIMILAR"), (1, 3, 3, "a text long enough, unanswered", "a text long enough to ask", 0.9, "MODIFIED")]
    asked = []

    def model(requests):
        asked.extend(r.prompt for r in requests.collect())
        return requests.filter(~F.col("prompt").contains("unanswered")).select("request_id", F.lit('{"comparison_category": "reduction", "explanation": "one\\ntwo", "confidence": 0.25}').alias("reply"))

    frame = compare.with_analysis(spark.createDataFrame(rows, COMPARED), model)
    got = {r.source_idx: r.analysis for r in frame.collect()}
    assert len(asked) == 2 and got[0].category == "REDUCTION" and got[0].confidence == 0.25 and got[1] is None and got[2] is None and got[3].category == "LLM_ERROR"
    report = compare.diff_report(frame).first().report
    assert "**LLM Analysis:** REDUCTION\n  _Confidence: 0.25_\n" in report or "**LLM Analysis:** REDUCTION\n  _Explanation: one_\n  _Explanation: two_\n  _Confidence: 0.25_\n" in report


def test_section_cosine(spark):
    rows = spark.createDataFrame([(1, "one two", "one two"), (2, "one", None), (3, "one", "")], "id long, source_text string, target_text string")
    got = {r.id: r.similarity for r in compare.with_cosine(rows).collect()}
    assert got == {1: pytest.approx(1.0), 2: 0.0, 3: 0.0}


def test_embed_by_type_calls_each_embedder_for_its_rows(spark):
    rows = spark.createDataFrame([(1, "text one", "text"), (2, "t", "table"), (3, None, None), (4, "x", "other")], "id int, content string, kind string")
    two = embed.embed_by_type(rows, {"table": lambda c: F.array(F.lit(1.0), F.length(c).cast("double"))}, "kind", dim=16)
    got = {r.id: r.vector for r in two.collect()}
    assert got[2][:3] == [1.0, 1.0, 0.0] and len(got[1]) == len(got[4]) == 16 and got[3] is None


def test_clean_pages_with_retries(spark):
    good = "The pages were read well and nothing is wrong with them"
    rows = [("a", good, 0.3), ("b", "l1 rn vv 0x bad te5t", 0.2), ("c", "l1 rn vv 0x bad te5t", 0.9), ("d", "rn rn never answered", 0.1), ("e", None, None), ("f", "rn rn slow", None)]
    calls = []

    def cleaner(requests):
        calls.append(requests.count())
        slow = F.col("prompt").contains("slow") & F.lit(len(calls) < 2)
        reply = F.when(~F.col("prompt").contains("never") & ~slow, F.lit("Sure.\nCORRECTED TEXT:\nclean text"))
        return requests.select("page_key", reply.alias("reply"))

    got = {r.page_key: r for r in ocr_text.clean_pages(spark.createDataFrame(rows, "page_key string, text string, confidence double"), cleaner).collect()}
    assert calls == [3, 2, 1]
    assert {k: r.status for k, r in got.items()} == {"a": "kept", "b": "cleaned", "c": "kept", "d": "failed", "e": "kept", "f": "cleaned"}
    assert got["b"].cleaned == "clean text" and got["d"].cleaned == "rn rn never answered" and got["d"].error.code == 301 and got["a"].error is None


def test_process_and_save_documents(spark, tmp_path):
    pages = spark.createDataFrame([(1, 1, "one"), (1, 2, "broken"), (2, 1, "broken")], "doc_id long, page int, image string")

    def recognise(frame):
        return frame.select("doc_id", "page", F.when(F.col("image") != "broken", F.col("image")).alias("text"), F.lit(0.99).alias("confidence"))

    got = ocr_text.process_documents(pages, recognise)
    assert {(r.doc_id, r.content, r.n_failed) for r in got.collect()} == {(1, "one", 1), (2, "", 1)}
    cleaned = ocr_text.process_documents(pages, recognise, lambda r: r.select("page_key", F.lit(None).cast("string").alias("reply")), style="json", retries=0)
    assert {r.doc_id: r.n_failed for r in cleaned.collect()} == {1: 1, 2: 1}
    ocr_text.save_documents(got, f"{tmp_path}/out")
    ocr_text.save_documents(got, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    ocr_text.save_documents(got, f"{tmp_path}/out", overwrite=True)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_page_means_and_reset(spark):
    pages = spark.createDataFrame([(1, 1, 0.5, 0.25), (1, 2, None, 0.75), (2, 1, 1.0, 1.0)], "doc_id long, page int, cer double, wer double")
    assert {tuple(r) for r in evaluation.page_means(pages, "cer", "wer").collect()} == {(1, 2, 0.5, 0.5), (2, 1, 1.0, 1.0)}
    turns = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "conv_id long, turn long")
    assert [r.conv_id for r in context.reset_history(turns, turns.filter("conv_id = 1")).collect()] == [2]


def cut_markdown(text, limit):
    if len(text) <= limit:
        return text
    head = text[:limit]
    header = max(head.rfind("\n## "), head.rfind("\n### "))
    if header > limit * 0.8:
        head = head[:header]
    elif head.rfind(".") > limit * 0.9:
        head = head[: head.rfind(".") + 1]
    return head + "\n\n*[Context truncated due to length]*"


def test_markdown_cut_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "bc ", ".", "\n## ", "\n### ", "é"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", context.truncate_markdown(F.col("t"), 40).alias("c")).collect()
    assert all(r.c == cut_markdown(texts[r.k], 40) for r in rows)


def test_term_searches_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "", "w1  W1\tw1"]
    documents = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, score string").repartition(5)
    queries = spark.createDataFrame([(1, "w1 w2 W2 w99"), (2, ""), (3, None), (4, "w3")], "query_id long, text string")
    toks = [(t or "").lower().split() for t in texts]
    n, mean = len(texts), sum(map(len, toks)) / len(texts)
    df = {w: sum(w in t for t in toks) for w in vocabulary}

    def bm25(w, t):
        tf = t.count(w)
        return log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))

    for found, score in ((search.keyword_hits, lambda w, t: float(w in t)), (search.bm25_hits, bm25)):
        got = {(r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in found(documents, queries, 7).collect()}
        want = set()
        for q, terms in ((1, {"w1", "w2"}), (4, {"w3"})):
            scored = sorted((-round(sum(score(w, t) for w in terms), 6), k) for k, t in enumerate(toks) if terms & set(t))
            want |= {(q, i, k, -s) for i, (s, k) in enumerate(scored[:7], 1)}
        assert got == want
        assert found(documents, queries.limit(0)).count() == 0 and found(documents.limit(0), queries).count() == 0


def test_nearest_with_ties_and_nulls(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in rng.integers(-1, 2, 3)] for _ in range(200)]
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)] + [(900, None), (901, [1.0])], "id long, vector array<double>").repartition(3)
    queries = spark.createDataFrame([(k, vectors[k]) for k in (0, 20, 40)], "query_id long, vector array<double>")

    def distance(a, b):
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return round(1 - float(np.dot(a, b)) / size, 6) if size else 1.0

    want = {(q, i, k) for q in (0, 20, 40) for i, (_, k) in enumerate(sorted((distance(vectors[q], v), k) for k, v in enumerate(vectors))[:6], 1)}
    for size in (64 << 20, 24 * 10):
        monkeypatch.setattr(search, "DISTANCE_BYTES", size)
        assert {(r.query_id, r.rank, r.id) for r in search.search_many(frame, queries, 6).collect()} == want


def test_shared_folder(spark):
    assert shared_folder(spark) == shared_folder(spark) and spark.sparkContext.getCheckpointDir()


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_path_patterns():
    import re

    def matches(pattern, path):
        return bool(re.search(readers._like(pattern), path))

    assert matches("*.md", "/a/b/x.md") and not matches("b/*.md", "/a/b/c/x.md") and matches("b/**/*.md", "/a/b/c/d/x.md") and matches("b/**/*.md", "/a/b/x.md") and not matches("a.b", "/x/aab")


def test_separators_and_keywords(spark):
    from lexarium.operators import chunking

    rows = spark.createDataFrame([(1, "aa|bb|cc|dd"), (2, None), (3, " "), (4, "short")], "id long, content string")
    got = {}
    for r in chunking.by_separators(rows, ["|", ""], 5, 0).collect():
        got.setdefault(r.id, []).append((r.chunk_index, r.chunk_count, r.content))
    assert got == {1: [(0, 2, "aa|bb"), (1, 2, "cc|dd")], 4: [(0, 1, "short")]}
    chunk = spark.createDataFrame([(1, "\n The Title \nvalve pump valve sensor pump valve with that gauge"), (2, None)], "id long, content string")
    keyed = {r.id: r for r in chunking.with_keywords(chunk, 3).collect()}
    assert keyed[1].title == "The Title" and keyed[1].keywords == ["valve", "pump", "gauge"] and keyed[2].title is None and keyed[2].keywords == []


def test_web_documents(spark):
    rows = [("https://a.example/x", "<title>T</title><p>Hello</p>", 200), ("https://a.example/y", None, 200), ("https://b.example:8080/z", "<p>Gone</p>", 404), (None, "<p>x</p>", None)]
    pages = spark.createDataFrame(rows, "url string, html string, status int")
    got = {r.metadata.get("source"): r for r in readers.web_documents(pages).collect()}
    assert got["https://a.example/x"].content == "Hello" and got["https://a.example/x"].metadata["domain"] == "a.example" and got["https://a.example/x"].metadata["status"] == "200"
    assert got["https://a.example/y"].metadata["error"] == "no content" and got["https://b.example:8080/z"].metadata["error"] == "status 404" and got[None].content == "x"
    assert readers.web_documents(pages, lenient=False).count() == 2 and readers.web_documents(pages.limit(0)).count() == 0


def test_xml_find(spark):
    raw = '<d:doc xmlns:d="urn:d"><d:part><d:name>A</d:name></d:part><part xmlns="urn:e"><name>B</name></part></d:doc>'
    rows = spark.createDataFrame([(1, raw), (2, "<broken"), (3, None)], "id long, raw string")

    def found(expression, namespaces=None):
        return {r.id: r.x for r in rows.select("id", readers.xml_find(expression, namespaces)(F.col("raw")).alias("x")).collect()}

    assert found("part/name") == {1: ["A", "B"], 2: None, 3: None}
    assert found("x:part/x:name", {"x": "urn:d"})[1] == ["A"] and found("{urn:e}part/{urn:e}name")[1] == ["B"] and found(".//name")[1] == ["A", "B"]


def test_json_where(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"kind": "x", "t": "1"}, {"kind": "y", "t": "2"}, 3]')
    assert [r.content for r in readers.read_json(spark, f"{tmp_path}/a.json", content_key="t", where={"kind": "x"}).collect()] == ["1"]


def test_settings(tmp_path):
    from lexarium.plans import pipeline as P

    (tmp_path / "a.yaml").write_text("search:\n  k: 7\n")
    defaults, kinds = {"search": {"k": 5, "exact": False}, "style": "text"}, {"search": {"k": int, "exact": bool}, "style": ("text", "html")}
    got = P.load_settings(defaults, f"{tmp_path}/a.yaml", environ={"LEXARIUM_SEARCH__EXACT": "true", "LEXARIUM_STYLE": "html"}, kinds=kinds)
    assert got == {"search": {"k": 7, "exact": True}, "style": "html"}
    with pytest.raises(P.PipelineError, match="search.k must be int; search.z is unknown; style must be one of text, html"):
        P.check_settings({"search": {"k": "many", "z": 1}, "style": "pdf"}, kinds)


def test_sql_functions(spark):
    from lexarium.plans.pipeline import register_functions

    assert "text_chunks" in register_functions(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM text_chunks('aa bb cc', 5, 0)").collect()] == [(0, 2, "aa bb"), (1, 2, "cc")]
    assert spark.sql("SELECT ratio_error('abc', 'abc') AS e").first().e == 0.0


def test_sliding_windows(spark, tmp_path):
    from lexarium.streaming import streams

    spark.sql("SELECT timestamp'2024-01-01 00:00:30' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:01:10', 'a' UNION ALL SELECT timestamp'2024-01-03 00:00:00', 'end'").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streams.read_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    done = streams.run_to_end(streams.sliding_counts(stream, "ts", "2 minutes", "1 minute", "1 minute", "k"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r.n for r in done.filter("k = 'a'").collect()) == [1, 1, 2]
