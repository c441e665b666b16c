"""Golden rows and properties of the core operators."""

from __future__ import annotations

import json
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexarium.functions import text as T
from lexarium.functions import vectors as V
from lexarium.operators import chunking, compare, context, evaluation, filters, grounding, ocr_text, search, sectioning
from lexarium.plans import pipeline as P
from lexarium.sources import readers, store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# chunking


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (-5, 0), (10, -1), (10, 10), (10, 20)])
def test_bad_windows(spark, size, overlap):
    with pytest.raises(ValueError):
        chunking.fixed_stride(spark.createDataFrame([("a",)], "content string"), size, overlap)


@given(st.text(alphabet="ab. \n", max_size=200), st.integers(1, 40), st.integers(0, 39))
@settings(max_examples=200, deadline=None)
def test_chunks_fit(text, size, overlap):
    if overlap < size:
        assert all(len(c) <= size for c in chunking.character_chunks(text, size, overlap))
        assert all(len(c) <= size for c in chunking.paragraph_chunks(text, size))
        assert all(len(c) <= size or " " not in c for c in chunking.recursive_chunks(text, size, overlap) if "." not in c)


def test_stride_reassembles(spark):
    text = "".join(chr(97 + k % 26) for k in range(2345))
    rows = chunking.fixed_stride(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "short")], "doc_id int, content string"), 1000, 200).orderBy("doc_id", "chunk_index").collect()
    own = [r.content for r in rows if r.doc_id == 1]
    assert own[0] + "".join(c[200:] for c in own[1:]) == text and [r.doc_id for r in rows if r.doc_id > 1] == [4]


def test_sentences(spark):
    assert one(spark, T.sentences(F.lit("First one. Second! Third? And a tail"))) == ["First one.", "Second!", "Third?", "And a tail"]


def test_semantic_breaks(spark):
    rows = [(1, k, v) for k, v in enumerate([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.1, 1.0]])]
    got = chunking.semantic_breaks(spark.createDataFrame(rows, "doc_id int, sentence_idx int, vector array<double>")).orderBy("sentence_idx").collect()
    assert [r.chunk_index for r in got] == [0, 0, 1, 1]


# sectioning

MARKDOWN = """# Title

Intro paragraph of some length.

## Part

- one item
- two items

```python
x = 1
```

### Deep
Setext part
-----------

Last paragraph in the end.

```
never closed
"""


def test_markdown_sections():
    rows = list(sectioning.markdown_rows(MARKDOWN))
    assert [(r[2], r[1]) for r in rows] == [("HEADING", 1), ("PARAGRAPH", 1), ("HEADING", 2), ("LIST", 2), ("CODE", 2), ("HEADING", 3), ("HEADING", 2), ("PARAGRAPH", 2)]
    assert rows[2][0] == 0 and rows[5][0] == 2 and rows[6][0] == 0 and rows[4][3] == "python"
    assert list(sectioning.markdown_rows(None)) == []


def test_json_sections():
    rows = list(sectioning.json_rows(json.dumps({"title": "A", "children": [{"heading": "B", "content": "text", "type": "list"}]})))
    assert rows == [(None, 0, "HEADING", "A", ""), (0, 1, "LIST", "B", "text")]
    assert list(sectioning.json_rows("[1, 2]"))[0][2] == "UNKNOWN" and list(sectioning.json_rows("{")) == []


def test_tables_need_two_lines(spark):
    lines = ["Name    | 1", "Other   | 2", "plain", "alone   | 3"]
    rows = spark.createDataFrame([(1, 1, k, t) for k, t in enumerate(lines, 1)], "doc_id int, page int, line int, text string")
    got = sectioning.find_tables(rows).collect()
    assert [(r.start_line, r.end_line, r.table_id) for r in got] == [(1, 2, "table_1_1")]


# search


def test_where(spark):
    rows = spark.createDataFrame([(k, "cat" if k % 2 else "dog", 2000 + k) for k in range(6)], "id int, animal string, year int")
    assert rows.filter(filters.where({"$and": [{"animal": {"$eq": "cat"}}, {"year": {"$gte": 2003}}]})).count() == 2
    assert rows.filter(filters.where({"$or": [{"id": 0}, {"id": {"$nin": [0, 1, 2, 3]}}]})).count() == 3
    assert rows.filter(filters.where(None)).count() == 6
    with pytest.raises(ValueError):
        filters.where({"a": {"$like": 1}})


def test_search_many_is_exact(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8))
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + [(900, None)], "id long, vector array<double>").repartition(5)
    queries = frame.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    got = {}
    for r in search.search_many(frame, queries, 4, block=4).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.id
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q, hits in got.items():
        order = np.lexsort((np.arange(300), np.round(1 - unit @ unit[q], 6)))[:4]
        assert [hits[k] for k in sorted(hits)] == order.tolist()
    assert len(got) == 15
    assert search.search_many(frame, queries.limit(0), 4).count() == 0


def test_merge_legs(spark):
    legs = [spark.createDataFrame([(1, k + 1, i) for k, i in enumerate(ids)], "query_id int, rank int, id int") for ids in ([1, 2, 3, 4, 5, 6, 7, 8], [3, 9, 10, 11])]
    got = [r.id for r in search.merge_legs(legs, [2, 1], 5).orderBy("rank").collect()]
    assert search.leg_quotas([2, 1], 5) == [6, 3] and got == [1, 2, 3, 4, 5]
    assert [r.id for r in search.merge_legs(legs, None, 12).orderBy("rank").collect()] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    with pytest.raises(ValueError):
        search.merge_legs(legs, [1])


def test_relevant_or_best(spark):
    hits = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.2), (2, "c", 0.3), (2, "d", 0.2), (2, "e", 0.1)], "query_id int, id string, score double")
    assert {r.id for r in filters.relevant_or_best(hits).collect()} == {"a", "c", "d"}


# contexts


def test_simple_context(spark):
    hits = spark.createDataFrame([(1, 1, "One. Two."), (1, 2, ""), (1, 3, "Three.")], "query_id int, rank int, content string")
    assert context.simple_context(hits).first()["context"] == "Document 1\nOne. Two.\n\nDocument 3\nThree."
    assert context.simple_context(hits, max_length=20).first()["context"].endswith("[Context truncated due to length]")


def test_extractive_answer(spark):
    rows = spark.createDataFrame([(1, "where is the cat", "The dog sleeps. The cat is here. Nothing."), (2, "x", "")], "query_id int, query string, context string")
    assert [r.answer for r in context.extractive_answer(rows).orderBy("query_id").collect()] == ["The cat is here.", ""]


# grounding


def test_grounding(spark):
    rows = spark.createDataFrame([(1, "Pressure valves follow DIN EN 1234", "pressure valves follow rules"), (2, "a b", "c"), (3, "completely unknown words appear", "nothing")], "id int, answer string, context string")
    got = {r.id: r for r in grounding.post_process(rows).collect()}
    assert "din1234" not in got[1].missing and got[2].entity_coverage == 1.0 and got[2].verified
    assert got[3].entity_coverage == 0 and got[3].needs_review and "SYSTEM WARNING" in got[3].final_answer
    strict = grounding.verify(rows, grounding.Grounding(entities=grounding.Bound(0.0, 0.3, 0.6))).collect()
    assert all(r.verified for r in strict)


@given(st.lists(st.sampled_from(["alpha", "beta1", "gamma", "delta"]), max_size=6), st.lists(st.sampled_from(["alpha", "beta1", "gamma", "delta"]), max_size=6))
@settings(max_examples=10, deadline=None)
def test_coverage_is_monotone(spark, answer, known):
    rows = spark.createDataFrame([(" ".join(answer), " ".join(known[:k])) for k in range(len(known) + 1)], "answer string, context string")
    shares = [r.entity_coverage for r in grounding.verify(rows).orderBy(F.length("context")).collect()]
    assert shares == sorted(shares)


# evaluation


@pytest.mark.parametrize(("query", "answer", "want"), [("a b", "", 0.0), ("", "a", 0.5), ("a b", "b c", 0.5), ("x", "y", 0.0), (None, "a", 0.5)])
def test_relevance(spark, query, answer, want):
    assert one(spark, evaluation.relevance(F.lit(query).cast("string"), F.lit(answer))) == want


@pytest.mark.parametrize(("answer", "reference", "ctx", "want"), [("", "a", "a", 0.0), ("  ", "a", "a", 0.5), ("a", "a b", None, 0.5), ("a c", None, "a", 0.5), ("a", None, None, 0.5)])
def test_factuality(spark, answer, reference, ctx, want):
    assert one(spark, evaluation.factuality(F.lit(answer), F.lit(reference).cast("string"), F.lit(ctx).cast("string"))) == want


def test_retrieval_scores(spark):
    got = spark.createDataFrame([(1, "a"), (1, "x"), (2, "a"), (2, "a")], "query_id int, item string")
    want = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "z")], "query_id int, item string")
    rows = {r.query_id: (r.precision, r.recall) for r in evaluation.retrieval_scores(got, want).collect()}
    assert rows == {1: (0.5, 0.5), 2: (0.5, 1.0), 3: (0.0, 0.0)}


# comparison


@pytest.mark.parametrize(("similarity", "want"), [(0.96, "SIMILAR"), (0.95, "SIMILAR"), (0.85, "MODIFIED"), (0.8, "MODIFIED"), (0.7, "DIFFERENT"), (0.35, "DIFFERENT")])
def test_classes(spark, similarity, want):
    assert one(spark, compare.classify(F.lit(similarity))) == want


def sides(spark):
    schema = "pair_id long, section_idx int, section_type string, title string, content string"
    a = [(1, 0, "HEADING", "Intro", ""), (1, 1, "PARAGRAPH", "", "alpha beta gamma delta"), (1, 2, "HEADING", "End", ""), (1, 3, "PARAGRAPH", "", "one two three")]
    b = [(1, 0, "HEADING", "Intro", None), (1, 1, "PARAGRAPH", "", "alpha beta gamma delta"), (1, 2, "PARAGRAPH", "", "inserted words here"), (1, 3, "HEADING", "End", ""), (1, 4, "PARAGRAPH", "", "one two four")]
    return spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)


@pytest.mark.parametrize("align", [compare.align_sequence, compare.align_best, compare.align_hybrid])
def test_alignment_conserves_sections(spark, align):
    s, t = sides(spark)
    rows = align(s, t).collect()
    assert sorted(r.source_idx for r in rows if r.source_idx is not None) == [0, 1, 2, 3]
    assert sorted(r.target_idx for r in rows if r.target_idx is not None) == [0, 1, 2, 3, 4]
    assert (1, 1) in {(r.source_idx, r.target_idx) for r in rows}


def test_headings_by_title(spark):
    assert {(r.source_idx, r.target_idx) for r in compare.match_headings(*sides(spark)).collect()} == {(0, 0), (2, 3)}


def test_parse_category(spark):
    reply = '```json\n{"comparison_category": "reduction", "explanation": "e", "confidence": 0.5}\n```'
    assert one(spark, compare.parse_category(F.lit(reply))).category == "REDUCTION"
    assert one(spark, compare.parse_category(F.lit('{"comparison_category": "reduction", "confidence": 7}'))).category == "LLM_ERROR"
    assert one(spark, compare.parse_category(F.lit(None).cast("string"))).category == "LLM_ERROR"


# recognised text


@pytest.mark.parametrize(("line", "heading", "item"), [("INTRODUCTION", True, False), ("1. Scope", True, True), ("This is a plain sentence.", False, False), ("- a point", False, True), ("Title Case Words", True, False), ("a) point one here", False, True)])
def test_line_kinds(spark, line, heading, item):
    assert one(spark, T.is_heading(F.lit(line))) == heading and one(spark, T.is_list_item(F.lit(line))) == item


def test_after_marker(spark):
    assert one(spark, ocr_text.after_marker(F.lit("x CORRECTED TEXT:\n good "), F.lit("orig"))) == "good"
    assert one(spark, ocr_text.after_marker(F.lit("CORRECTED TEXT: "), F.lit("orig"))) == "orig"


def test_markdown_document(spark):
    pages = spark.createDataFrame([(1, 2, "second page text here."), (1, 1, "FIRST\n\nbody text goes here.")], "doc_id int, page int, text string")
    assert ocr_text.markdown_document(pages).first()["content"] == "## FIRST\n\nbody text goes here.\n\n## Page 2\n\nsecond page text here."


# sources


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello\nworld")
    (tmp_path / "b.csv").write_text("name,age\nAnn,1\nBob,\n")
    (tmp_path / "c.json").write_text('{"data": {"items": [{"text": "x"}, {"other": 1}]}}')
    (tmp_path / "d.jsonl").write_text('{"text": "l1"}\n\nbroken\n{"text": "l4"}\n')
    (tmp_path / "e.html").write_text("<html><head><title>T</title><script>x</script></head><body><h1>H</h1><p>Text &amp; more</p><img src='i.png'></body></html>")
    (tmp_path / "f.xml").write_text('<lib><book id="1"><title lang="en">A</title></book><book><title>B</title></book></lib>')
    assert readers.read_text(spark, f"{tmp_path}/a.txt").first()["content"] == "hello\nworld"
    assert {(r.metadata["row_index"], r.content) for r in readers.read_csv(spark, f"{tmp_path}/b.csv").collect()} == {("0", "name: Ann age: 1"), ("1", "name: Bob age: ")}
    items = readers.read_json(spark, f"{tmp_path}/c.json", at="data.items", content_key="text").collect()
    assert [r.content for r in items] == ["x", '{"other": 1}']
    assert readers.read_json(spark, f"{tmp_path}/c.json", at="data.items", content_key="text", whole_if_missing=False).count() == 1
    assert {(r.content, r.metadata["line"]) for r in readers.read_jsonl(spark, f"{tmp_path}/d.jsonl", content_key="text").collect()} == {("l1", "1"), ("l4", "4")}
    page = readers.read_html(spark, f"{tmp_path}/e.html").first()
    assert page.content == "H Text & more" and page.metadata["title"] == "T" and json.loads(page.metadata["image_urls"]) == ["i.png"]
    books = readers.read_xml(spark, f"{tmp_path}/f.xml", split_by="book", metadata_tags=["title"]).collect()
    assert [(r.content, r.metadata["index"]) for r in books] == [("A", "0"), ("B", "1")] and books[0].metadata["title_lang"] == "en"
    assert readers.read_directory(spark, str(tmp_path), recursive=False).count() == 8
    assert readers.reader_for("X.NDJSON") is readers.READERS["jsonl"]
    with pytest.raises(ValueError):
        readers.reader_for("x.bin")


def test_namespaces(spark):
    raw = '<a xmlns="urn:d" xmlns:din="urn:din"><b/></a>'
    assert one(spark, readers.xml_namespaces(F.lit(raw))) == {"": "urn:d", "din": "urn:din"}


def test_store(spark, tmp_path):
    box = store.VectorStore(spark, str(tmp_path / "box"), capacity=3)
    assert box.count() == 0
    box.add(spark.createDataFrame([(f"text number {k}", f"s{k}", "table" if k == 3 else "pdf") for k in range(5)] + [("  ", "s9", "txt")], "content string, source string, filetype string"))
    assert box.count() == 5 and {r["shard"]: r["count"] for r in box.shard_sizes().collect()} == {0: 3, 1: 2}
    box.add(spark.createDataFrame([("again", "s1"), ("new", "s7"), ("new too", "s7")], "content string, source string"), skip_known_sources=True)
    assert box.count() == 7
    hits = box.search("text number 2", 3, {"content_type": "text"}).collect()
    assert hits[0].content == "text number 2" and len(hits) == 3
    assert box.search("text", 5, text={"$contains": "number 4"}).count() == 1
    assert {r.content_type for r in box.search_by_type("text number 3").collect()} == {"text", "table"}
    with pytest.raises(ValueError):
        box.search("  ")
    box.delete()
    assert not box.exists()


def test_number_rows(spark):
    rows = store.number_rows(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7), "k", name="n").orderBy("k").collect()
    assert [r.n for r in rows] == list(range(1, 1001))


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, V.norm(a)) == 5.0 and one(spark, V.cosine(a, a)) == pytest.approx(1.0)
    assert one(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert len(one(spark, V.fit_dimension(a, 4))) == 4
    assert np.linalg.norm(one(spark, V.feature_hash_embedding(F.lit("some text")))) == pytest.approx(1.0)


# pipelines


def test_pipeline_parts(spark):
    with pytest.raises(P.PipelineError):
        P.PipelineBuilder().build()
    with pytest.raises(ValueError):
        P.COMPONENTS.register("formatter", "simple", context.simple_context)
    with pytest.raises(ValueError):
        P.COMPONENTS.create("formatter", "none")
    hits = spark.createDataFrame([(1, 1, "The valve is open. The door is shut.")], "query_id int, rank int, content string")
    pipe = P.create_pipeline({"retriever": lambda q: hits, "formatter": "simple", "grounding": {"entities": {"accept": 0.1}}})
    asked = spark.createDataFrame([(1, "is the valve open"), (2, "   "), (3, None), (4, "unknown")], "query_id int, query string")
    got = {r.query_id: r for r in pipe.answer(asked).collect()}
    assert set(got) == {1, 4} and "valve is open" in got[1].answer and got[4].context == ""
    assert pipe.rejected(asked).count() == 2
    with pytest.raises(P.PipelineError):
        P.create_pipeline({"retriever": lambda q: hits, "colour": 1})


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text('{"a": {"b": 2}}')
    assert P.load_settings({"a": {"b": 1, "c": 1}}, str(tmp_path / "s.json"), environ={"LEXARIUM_A__C": "9"}) == {"a": {"b": 2, "c": "9"}}


def test_rows_of_split_files_keep_their_numbers(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"text": "{name}{k}"}}\n' for k in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = readers.read_jsonl(spark, str(tmp_path), content_key="text")
        assert rows.rdd.getNumPartitions() > 1
        assert {(r.content, r.metadata["line"]) for r in rows.collect()} == {(f"{name}{k}", str(k + 1)) for name in "ab" for k in range(500)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_directory_at_any_depth_with_patterns(spark, tmp_path):
    at = tmp_path
    for depth in range(6):
        at.mkdir(exist_ok=True)
        (at / f"deep{depth}.txt").write_text(f"text {depth}")
        at = at / f"d{depth}"
    (tmp_path / "Y.TXT").write_text("upper")
    (tmp_path / "d0" / "rows.csv").write_text("a\n1\n")
    (tmp_path / ".hidden.txt").write_text("no")

    def found(**options):
        return {r.content for r in readers.read_directory(spark, str(tmp_path), **options).collect()}

    assert found() == {f"text {k}" for k in range(6)} | {"upper", "a: 1"}
    assert found(recursive=False) == {"text 0", "upper"}
    assert found(extensions=["csv"]) == {"a: 1"} and found(extensions=["json"]) == set()
    assert found(glob="d0/*.txt") == {"text 1"} and found(glob="d0/**/*.txt") == {f"text {k}" for k in range(1, 6)}
    assert found(extensions=["txt"], exclude=["d0/**"]) == {"text 0", "upper"}


UNUSUAL = r"\b\w*[^a-zA-Z0-9\s.,;:!?-]\w*\b"


@pytest.mark.parametrize(
    ("text", "rate"),
    [("", 0.0), ("all is well here", 0.0), ("I5 wel1 here now", 1.0), ("Ix wel1 here now", 2 / 4), ("a === b /// c d e", 2 / 5), ("größe und maß", 2 / 3), ("can't stop now", 1 / 4), ('he said "yes" twice', 0.0), ("modern corn", 1.0), ("wait... what!!!", 1.0), ("eins zwei dreiVier", 1 / 3)],
)
def test_error_rate_by_hand(spark, text, rate):
    assert one(spark, T.error_rate(F.lit(text))) == pytest.approx(rate)


def test_error_rate_against_brute_force(spark, data_dir):
    patterns = [r"\bI[^a-zA-Z\s]", "[a-z][A-Z]", "[0-9][a-zA-Z]|[a-zA-Z][0-9]", "vv|rn", "l1|11", r"([^\w\s])\1{2,}", UNUSUAL]
    rows = spark.read.parquet(f"{data_dir}/text_blocks.parquet").filter("text is not null").select("text", T.error_rate(F.col("text")).alias("rate")).distinct().collect()
    for r in rows:
        n = len(re.findall(r"\b\w+\b", r.text.lower()))
        assert r.rate == pytest.approx(min(1.0, sum(len(re.findall(p, r.text)) for p in patterns) / n) if n else 0.0), r.text
