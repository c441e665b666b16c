"""A vector store: rows of (id, content, metadata, vector, shard) as Parquet, partitioned by shard."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import feature_hash_embedding
from ..operators.filters import where, where_document
from ..operators.numbering import number_rows
from ..operators.search import nearest, nearest_per_group, search_many

CONTENT_TYPES = ("image", "technical_drawing", "table")


def content_type(filetype: Column) -> Column:
    """image, technical_drawing and table as they are, all else text."""
    kind = F.lower(F.trim(filetype))
    return F.when(kind.isin(*CONTENT_TYPES), kind).otherwise("text")


def stable_id(*parts: str) -> Column:
    """An id from what identifies a chunk, the same on every run."""
    return F.hex(F.xxhash64(*(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)))


def unseen_sources(batch: DataFrame, stored: DataFrame, source: str = "source") -> DataFrame:
    """The rows whose source isn't stored yet; rows without source stay."""
    known = stored.select(source).filter(F.col(source).isNotNull()).distinct()
    return batch.join(known, source, "left_anti")


def shard_of(row_no: Column, capacity: int) -> Column:
    """The shard that is filled when a row arrives."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    return F.floor((row_no - 1) / capacity).cast("int")


def shard_batches(sizes: Sequence[int], capacity: int, held: int = 0) -> list[int]:
    """The shard of each batch when batches are never split: a batch that doesn't fit beside what the last shard holds opens a new one."""
    shard, out = 0, []
    for size in sizes:
        if held and held + size > capacity:
            shard, held = shard + 1, 0
        held += size
        out.append(shard)
    return out


class VectorStore:
    """A collection in one directory. Writes append; searches are exact and prune what conditions rule out at the scan."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[Column], Column] = feature_hash_embedding, capacity: int = 10_000):
        self.spark, self.path, self.embed, self.capacity = spark, path, embed, capacity

    def exists(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def count(self) -> int:
        return self.rows().count() if self.exists() else 0

    def add(self, documents: DataFrame, overwrite: bool = False, skip_known_sources: bool = False) -> None:
        """Add documents (content, and any of id, source, filetype and other columns); blank contents aren't added."""
        rows = documents.filter(F.trim("content") != "")
        if skip_known_sources and not overwrite and self.exists():
            rows = unseen_sources(rows, self.rows())
        if "source" not in rows.columns:
            rows = rows.withColumn("source", F.lit(None).cast("string"))
        if "id" not in rows.columns:
            rows = rows.withColumn("id", stable_id("source", "content"))
        if "filetype" not in rows.columns:
            rows = rows.withColumn("filetype", F.lit("text"))
        before = 0 if overwrite else self.count()
        rows = number_rows(rows.withColumn("content_type", content_type(F.col("filetype"))), "id", name="_no").withColumn("shard", shard_of(F.col("_no") + before, self.capacity)).drop("_no")
        rows.withColumn("vector", self.embed(F.col("content"))).write.mode("overwrite" if overwrite else "append").partitionBy("shard").parquet(self.path)

    def get(self, ids: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
        rows = self.rows() if ids is None else self.rows().filter(F.col("id").isin(list(ids)))
        return rows if limit is None else rows.orderBy("id").limit(limit)

    def search(self, query: str, k: int = 5, condition: Mapping[str, Any] | None = None, text: Mapping[str, Any] | None = None) -> DataFrame:
        """The k nearest rows to a query text."""
        if not isinstance(query, str) or not query.strip():
            raise ValueError("the query must be a text that isn't blank")
        vector = self.spark.range(1).select(self.embed(F.lit(query)).alias("v")).first()["v"]
        return nearest(self.rows(), vector, k, where(condition) & where_document(text))

    def search_by_type(self, query: str, k: int = 3) -> DataFrame:
        """The k nearest rows of each content type."""
        vector = self.spark.range(1).select(self.embed(F.lit(query)).alias("v")).first()["v"]
        return nearest_per_group(self.rows(), vector, "content_type", k)

    def search_many(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """The k nearest rows of each query (query_id, text), by numeric row hashes as ids."""
        rows = self.rows().select(F.xxhash64("id").alias("id"), "vector")
        return search_many(rows, queries.select("query_id", self.embed(F.col("text")).alias("vector")), k)

    def as_retriever(self, k: int = 4) -> Callable[[DataFrame], DataFrame]:
        """A retriever of a pipeline: questions (query_id, query) to hits (query_id, rank, content, source, distance)."""

        def retrieve(questions: DataFrame) -> DataFrame:
            hits = self.search_many(questions.withColumnRenamed("query", "text"), k)
            return hits.join(self.rows().select(F.xxhash64("id").alias("id"), "content", "source"), "id").select("query_id", "rank", "content", "source", "distance")

        return retrieve

    def shard_sizes(self) -> DataFrame:
        return self.rows().groupBy("shard").count()

    def delete(self) -> None:
        """Remove the collection's directory."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)
