"""From files to a searchable store, and from two documents to a report."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import feature_hash_embedding
from ..operators import chunking, compare, sectioning
from ..operators.filters import drop_empty
from ..sources.readers import read_directory
from ..sources.store import VectorStore


def ingest(spark: SparkSession, path: str, store: VectorStore, size: int = 1000, overlap: int = 200, extensions: Sequence[str] | None = None, overwrite: bool = False) -> None:
    """Read a directory, cut its documents recursively, drop what is empty and add the chunks with their source and place."""
    documents = read_directory(spark, path, extensions).select("content", F.col("metadata")["source"].alias("source"), F.col("metadata")["filetype"].alias("filetype"))
    store.add(drop_empty(chunking.recursive(drop_empty(documents), size, overlap)), overwrite=overwrite)


SECTIONERS = {"text": sectioning.text_sections, "markdown": sectioning.markdown_sections, "json": sectioning.json_sections}


def sections_of(documents: DataFrame, kind: str = "markdown") -> DataFrame:
    """Documents (doc_id, content) in sections by the named sectioner."""
    if kind not in SECTIONERS:
        raise ValueError(f"unknown format {kind}")
    rows = SECTIONERS[kind](documents)
    return rows if "title" in rows.columns else rows.withColumn("title", F.lit(None).cast("string"))


ALIGNERS = {"sequence": compare.align_sequence, "best": compare.align_best, "hybrid": compare.align_hybrid}


def compare_documents(documents: DataFrame, pairs: DataFrame, kind: str = "markdown", strategy: str = "hybrid", similar: float = 0.95, modified: float = 0.8, embed: Callable[[Column], Column] | None = feature_hash_embedding) -> DataFrame:
    """Pairs (pair_id, source_doc, target_doc) of documents (doc_id, content), aligned and classed, with both sections' contents.

    Classes go by the cosine of the sections' embeddings, or without embed by the share of common words that they were aligned by.
    """
    if strategy not in ALIGNERS:
        raise ValueError(f"unknown strategy {strategy}")
    rows = sections_of(documents, kind).select("doc_id", "section_idx", "section_type", "title", "content")
    sides = [pairs.select("pair_id", F.col(doc).alias("doc_id")).join(rows, "doc_id").drop("doc_id").toDF("pair_id", "section_idx", "section_type", "title", "content") for doc in ("source_doc", "target_doc")]
    result = ALIGNERS[strategy](*sides)
    for name, side in zip(("source", "target"), sides):
        text = side.select("pair_id", F.col("section_idx").alias(f"{name}_idx"), F.coalesce(F.when(F.col("content") != "", F.col("content")), "title").alias(f"{name}_text"))
        result = result.join(text, ["pair_id", f"{name}_idx"], "left")
    return compare.compare_pairs(compare.with_cosine(result, embed) if embed else result, similar, modified)
