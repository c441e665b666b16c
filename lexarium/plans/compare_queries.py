"""Queries over pairs of documents: the revisions of a file, section by section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import jaccard, tokens
from ..operators import compare, filters
from .registry import query, table
from .text_queries import _strip, _tokens


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs = compare.consecutive_revisions(table(spark, sf_dir, "parsed_docs"))
    sections = table(spark, sf_dir, "sections")
    return compare.side(pairs, sections, "source_doc"), compare.side(pairs, sections, "target_doc")


_PAIRS = "p AS (SELECT doc_id AS pair_id, lag(doc_id) OVER (PARTITION BY doc_number ORDER BY revision, doc_id) AS source_doc, doc_id AS target_doc FROM parsed_docs WHERE doc_number IS NOT NULL)"
_SECTIONS = "x AS (SELECT DISTINCT ON (section_id) doc_id, section_idx, upper(section_type) AS section_type, title, content FROM sections)"
_SIDES = f"WITH {_PAIRS}, {_SECTIONS}, s AS (SELECT pair_id, x.* FROM p JOIN x ON x.doc_id = source_doc WHERE source_doc IS NOT NULL), t AS (SELECT pair_id, x.* FROM p JOIN x ON x.doc_id = target_doc WHERE source_doc IS NOT NULL)"
_KEY = f"coalesce(CASE WHEN {_strip('content')} <> '' THEN {_strip('content')} END, CASE WHEN {_strip('title')} <> '' THEN {_strip('title')} END)"


@query(f"WITH {_PAIRS} SELECT pair_id, source_doc, target_doc FROM p WHERE source_doc IS NOT NULL")
def compare_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each revision of a file with the one before."""
    return compare.consecutive_revisions(table(spark, sf_dir, "parsed_docs"))


@query(
    f"""{_SIDES}, h AS (SELECT pair_id, section_idx, {_KEY} AS key FROM s WHERE section_type = 'HEADING'), g AS (SELECT pair_id, {_KEY} AS key, min(section_idx) AS target_idx FROM t WHERE section_type = 'HEADING' GROUP BY ALL)
    SELECT pair_id, section_idx AS source_idx, target_idx FROM h LEFT JOIN g USING (pair_id, key)"""
)
def compare_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with the first of the same text in the next revision."""
    return compare.match_headings(*_sides(spark, sf_dir))


@query(f"{_SIDES} SELECT pair_id, section_idx, last_value(CASE WHEN section_type = 'HEADING' THEN section_idx END IGNORE NULLS) OVER (PARTITION BY pair_id ORDER BY section_idx) AS heading_idx FROM t")
def compare_heading_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading that each section stands under."""
    return compare.with_heading(_sides(spark, sf_dir)[1]).select("pair_id", "section_idx", "heading_idx")


_SEGMENT = "sum(CASE WHEN section_type = 'HEADING' THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY section_idx)"


@query(f"{_SIDES} SELECT pair_id, section_idx, CAST({_SEGMENT} AS BIGINT) AS segment FROM s")
def compare_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment of each section."""
    return compare.with_segments(_sides(spark, sf_dir)[0]).select("pair_id", "section_idx", "segment")


@query(
    f"""{_SIDES}, a AS (SELECT pair_id, segment, section_idx AS source_idx, row_number() OVER (PARTITION BY pair_id, segment ORDER BY section_idx) AS place FROM (SELECT *, CAST({_SEGMENT} AS BIGINT) AS segment FROM s)),
    b AS (SELECT pair_id, segment, section_idx AS target_idx, row_number() OVER (PARTITION BY pair_id, segment ORDER BY section_idx) AS place FROM (SELECT *, CAST({_SEGMENT} AS BIGINT) AS segment FROM t))
    SELECT pair_id, segment, place, source_idx, target_idx FROM a FULL JOIN b USING (pair_id, segment, place)"""
)
def compare_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of equal segments by position."""
    return compare.pair_by_position(*_sides(spark, sf_dir)).withColumn("place", F.col("place").cast("long"))


_SET_A, _SET_B = f"list_distinct({_tokens('s.content')})", f"list_distinct({_tokens('t.content')})"
_SIM = "CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_filter(a, lambda z: list_contains(b, z))) / len(list_distinct(list_concat(a, b)))::DOUBLE END"
_MATRIX = f"{_SIDES}, m AS (SELECT s.pair_id, s.section_idx AS source_idx, t.section_idx AS target_idx, {_SET_A} AS a, {_SET_B} AS b FROM s JOIN t ON s.pair_id = t.pair_id)"


@query(f"{_MATRIX} SELECT pair_id, source_idx, target_idx, round({_SIM}, 6) AS similarity FROM m")
def compare_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity of all sections within each pair of revisions."""
    return compare.similarity_matrix(*_sides(spark, sf_dir))


_SAME = f"{_SIDES}, m AS (SELECT pair_id, s.section_idx AS source_idx, t.section_idx AS target_idx, {_SET_A} AS a, {_SET_B} AS b FROM s FULL JOIN t USING (pair_id, section_idx))"
_CLASS = f"CASE WHEN target_idx IS NULL THEN 'DELETED' WHEN source_idx IS NULL THEN 'NEW' WHEN round({_SIM}, 6) >= 0.95 THEN 'SIMILAR' WHEN round({_SIM}, 6) >= 0.8 THEN 'MODIFIED' ELSE 'DIFFERENT' END"


def _by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = _sides(spark, sf_dir)
    s = s.select("pair_id", "section_idx", F.col("section_idx").alias("source_idx"), F.col("content").alias("a"))
    t = t.select("pair_id", "section_idx", F.col("section_idx").alias("target_idx"), F.col("content").alias("b"))
    both = s.join(t, ["pair_id", "section_idx"], "full")
    return compare.compare_pairs(both.withColumn("similarity", F.round(jaccard(tokens(F.col("a")), tokens(F.col("b"))), 6)))


@query(f"{_SAME} SELECT pair_id, source_idx, target_idx, {_CLASS} AS result_type FROM m")
def compare_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of each section against the one at its index in the next revision."""
    return _by_index(spark, sf_dir).select("pair_id", "source_idx", "target_idx", "result_type")


@query(
    f"""{_SAME}, r AS (SELECT pair_id, {_CLASS} AS k FROM m) SELECT pair_id, count(*) FILTER (k = 'SIMILAR') AS "SIMILAR", count(*) FILTER (k = 'MODIFIED') AS "MODIFIED", count(*) FILTER (k = 'DIFFERENT') AS "DIFFERENT",
    count(*) FILTER (k = 'NEW') AS "NEW", count(*) FILTER (k = 'DELETED') AS "DELETED" FROM r GROUP BY pair_id"""
)
def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many results of each type a pair has."""
    return compare.diff_summary(_by_index(spark, sf_dir))


@query()
def compare_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differences of each pair as Markdown."""
    return compare.diff_report(_by_index(spark, sf_dir).withColumnsRenamed({"a": "source_text", "b": "target_text"}))


@query()
def compare_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by the cosine of section embeddings, and the analysis of changed sections by a stand-in for a model."""
    rows = compare.with_cosine(_by_index(spark, sf_dir).select("pair_id", "source_idx", "target_idx", F.col("a").alias("source_text"), F.col("b").alias("target_text")))
    longer = F.lit('{"comparison_category": "EXPANSION", "explanation": "stand-in", "confidence": 0.5}')
    analysed = compare.with_analysis(compare.compare_pairs(rows), lambda requests: requests.select("request_id", longer.alias("reply")))
    return analysed.select("pair_id", "source_idx", "target_idx", F.round("similarity", 6).alias("similarity"), "result_type", F.col("analysis")["category"].alias("category"))


_TEXTS = _SAME.replace(f"{_SET_A} AS a, {_SET_B} AS b", "coalesce(s.content, '') AS a, coalesce(t.content, '') AS b")


@query(f"{_TEXTS} SELECT pair_id, source_idx, target_idx, least(length({_strip('a')}), length({_strip('b')})) < 15 AS skipped FROM m")
def compare_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with too little text on a side to be worth a model's comparison."""
    return _by_index(spark, sf_dir).select("pair_id", "source_idx", "target_idx", filters.too_short(F.col("a"), F.col("b")).alias("skipped"))


@query()
def align_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections aligned in sequence."""
    return compare.align_sequence(*_sides(spark, sf_dir))


@query()
def align_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections aligned by greedy best matches."""
    return compare.align_best(*_sides(spark, sf_dir))


@query()
def align_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections aligned in sequence under matching headings."""
    return compare.align_hybrid(*_sides(spark, sf_dir))


@query()
def diff_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified and inline differences of modified sections."""
    rows = _by_index(spark, sf_dir).filter("result_type = 'MODIFIED'")
    return rows.select("pair_id", "source_idx", compare.unified_diff("a", "b").alias("unified"), compare.inline_diff("a", "b").alias("inline"))
