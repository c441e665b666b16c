"""Queries of the training-data operators, pN_ for problem N."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding, language, leakage, neardup, packing, scans, site_lines, splitting, stuffing
from .base import records, spread

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose texts are worked off in Python."""
    return spread(_t(spark, sf_dir, name).select(*columns))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.repeated_lines(_t(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.remove_repeated_lines(_t(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "clean_text", "n_removed")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _texts(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language.assign_languages(documents, language.fit(documents), cases_only=True).select("doc_id", F.col("seg_no").cast("long").alias("seg_no"), "lang").distinct()


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _texts(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language.assign_languages(documents, language.fit(documents)).select("doc_id", "seg_no", "lang", "label", "mislabelled", F.round("confidence", 6).alias("confidence"))


def _documents_and_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(_texts(spark, sf_dir, "documents", "doc_id", "text"), "documents", "doc_id", "text").unionByName(records(_texts(spark, sf_dir, "text_blocks", "block_key", "text"), "text_blocks", "block_key", "text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.find_garbled(_documents_and_blocks(spark, sf_dir)).select("rec_table", "rec_id").distinct()


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.find_garbled(_documents_and_blocks(spark, sf_dir))


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = records(_texts(spark, sf_dir, "documents", "doc_id", "text"), "documents", "doc_id", "text").unionByName(records(_texts(spark, sf_dir, "sections", "section_id", "content"), "sections", "section_id", "content"))
    return neardup.near_duplicates(items, threshold=0.7, size=3, min_words=20)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.expand_pairs(*_near(spark, sf_dir))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir)[0]


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir)[1]


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.limited_records(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "sections"), _t(spark, sf_dir, "split_limits"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(_oversized(spark, sf_dir)).filter("piece_no = 1").select("rec_table", "rec_id").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(_oversized(spark, sf_dir), distinct_rows=True)


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and text_blocks; a file's title and site are those of any of its revisions that has them."""
    docs = _texts(spark, sf_dir, "documents", "doc_id", "text", "title", "source").select(F.lit("documents").alias("rec_table"), F.col("doc_id").alias("rec_id"), "text", "title", "source", F.lit(None).cast("string").alias("code"), F.lit(False).alias("block"))
    parsed = _t(spark, sf_dir, "parsed_docs").select("doc_id", "title", "source", F.col("doc_number").alias("code")).dropDuplicates(["doc_id"])
    known = parsed.filter(F.col("code").isNotNull()).groupBy("code").agg(F.min("title").alias("any_title"), F.min("source").alias("any_source"))
    about = parsed.join(known, "code", "left").select("doc_id", F.coalesce("title", "any_title").alias("title"), F.coalesce("source", "any_source").alias("source"), "code")
    blocks = _t(spark, sf_dir, "text_blocks").select("doc_id", F.col("block_key").alias("rec_id"), "text").join(about, "doc_id", "left")
    return docs.unionByName(blocks.select(F.lit("text_blocks").alias("rec_table"), "rec_id", "text", "title", "source", "code", F.lit(True).alias("block")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.find_noise(_scanned(spark, sf_dir)).select("rec_table", "rec_id", "kind").distinct()


def p6_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.find_noise(_scanned(spark, sf_dir))


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _scanned(spark, sf_dir)
    return scans.repair_scans(items, scans.find_noise(items))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "pack_pools"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_fill(p7_containers(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(_texts(spark, sf_dir, "documents", "doc_id", "text"), _t(spark, sf_dir, "eval_cases")).select("case_id", "doc_id").distinct()


def p8_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(_texts(spark, sf_dir, "documents", "doc_id", "text"), _t(spark, sf_dir, "eval_cases"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed_pages(_texts(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id").distinct()


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.score_pages(_texts(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict[str, Query]:
    """All queries of this subpackage by name."""
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1].isdigit()}
