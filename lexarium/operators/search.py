"""Search: exact nearest vectors, keyword scores, and the merging of ranked legs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from heapq import heappush, heapreplace
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import cosine
from ..functions.words import EXPANSIONS


def distance(vector: Column, query: Sequence[float]) -> Column:
    """Cosine distance to one query vector, rounded so that ties are ties on every platform."""
    return F.round(1.0 - cosine(vector, F.array(*(F.lit(float(x)) for x in query))), 6)


def nearest(vectors: DataFrame, query: Sequence[float], k: int = 5, keep: Column | None = None) -> DataFrame:
    """The k rows (id, vector, ...) nearest to one query; total order by distance and id, so only k rows leave each task."""
    rows = vectors if keep is None else vectors.filter(keep)
    return rows.withColumn("distance", distance(F.col("vector"), query)).drop("vector").orderBy("distance", "id").limit(k)


def nearest_per_group(vectors: DataFrame, query: Sequence[float], group: str, k: int = 3) -> DataFrame:
    """The k nearest of each group."""
    scored = vectors.withColumn("distance", distance(F.col("vector"), query)).drop("vector")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("distance", "id"))).filter(F.col("rank") <= k)


HITS = "query_id bigint, id bigint, distance double"


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest rows (id, vector) of each query (query_id, vector).

    The stated queries go to the workers in blocks of at most `block` as one matrix; each task multiplies its vectors
    with it and keeps the k best for each query, so k rows per query and task are shuffled and never a cross join. Null vectors and those of another dimension than the queries have no distance and are left out.
    """
    found, chunk = None, []

    def flush(rows: list) -> DataFrame:
        return _search_block(vectors, np.array([r["query_id"] for r in rows], np.int64), np.array([r["vector"] for r in rows], np.float64), k)

    for row in queries.select("query_id", "vector").filter(F.col("vector").isNotNull()).toLocalIterator():
        chunk.append(row)
        if len(chunk) == block:
            found, chunk = flush(chunk) if found is None else found.unionByName(flush(chunk)), []
    if chunk or found is None:
        more = flush(chunk) if chunk else vectors.sparkSession.createDataFrame([], HITS)
        found = more if found is None else found.unionByName(more)
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


#: Bytes of the distances that a task holds at once.
DISTANCE_BYTES = 64 << 20


def _search_block(vectors: DataFrame, query_ids: np.ndarray, matrix: np.ndarray, k: int) -> DataFrame:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = vectors.sparkSession.sparkContext.broadcast((query_ids, matrix / np.where(length > 0, length, 1)))
    rows_at_once = max(1, DISTANCE_BYTES // (8 * len(query_ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, m = shared.value
        best_ids, best = np.zeros((len(qs), 0), np.int64), np.zeros((len(qs), 0), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(at, rows_at_once)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                own = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)[order]
                size = np.linalg.norm(own, axis=1, keepdims=True)
                millionths = np.rint((1.0 - m @ (own / np.where(size > 0, size, 1)).T) * 1e6).astype(np.int64)
                if len(ids) > k:  # ties go to the lesser id, which stands before
                    near = np.argpartition(millionths * len(ids) + np.arange(len(ids)), k - 1, axis=1)[:, :k]
                    millionths, found = np.take_along_axis(millionths, near, 1), ids[order][near]
                else:
                    found = np.broadcast_to(ids[order], millionths.shape)
                best_ids, best = np.concatenate([best_ids, found], 1), np.concatenate([best, millionths], 1)
                first = np.lexsort((best_ids, best), axis=1)[:, :k]
                best_ids, best = np.take_along_axis(best_ids, first, 1), np.take_along_axis(best, first, 1)
        if best.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qs, best.shape[1])), pa.array(best_ids.ravel()), pa.array(best.ravel() / 1e6)], names=["query_id", "id", "distance"])

    return vectors.filter(F.size("vector") == matrix.shape[1]).select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, HITS)


def sharded_search(vectors: DataFrame, query: Sequence[float], shard: str = "shard", k: int = 10) -> DataFrame:
    """The k nearest of each shard, merged and cut to k; the same as a search over all rows."""
    return nearest_per_group(vectors, query, shard, k).drop("rank").orderBy("distance", "id").limit(k)


_SPACES = re.compile("[ \t\n\r\f]+")


class _Asked:
    """A block of queries: their terms by number, and for each term the numbers of the queries that have it."""

    def __init__(self, rows: list):
        self.ids = [r["query_id"] for r in rows]
        self.terms: dict[str, int] = {}
        self.queries_of: list[list[int]] = []
        for q, r in enumerate(rows):
            for term in r["terms"]:
                if term not in self.terms:
                    self.terms[term] = len(self.queries_of)
                    self.queries_of.append([])
                self.queries_of[self.terms[term]].append(q)

    def counts(self, text: str | None) -> tuple[Counter, int]:
        """How often each asked term stands in a text, and the number of its tokens."""
        toks = [t for t in _SPACES.split((text or "").lower()) if t]
        return Counter(n for t in toks if (n := self.terms.get(t)) is not None), len(toks)


def _asked_blocks(queries: DataFrame, block: int) -> Iterator[_Asked]:
    rows: list = []
    for row in queries.select("query_id", tokens(F.col("text")).alias("terms")).toLocalIterator():  # the stated queries
        rows.append(row)
        if len(rows) == block:
            yield _Asked(rows)
            rows = []
    if rows:
        yield _Asked(rows)


def _best_by_terms(documents: DataFrame, queries: DataFrame, k: int, weights: Callable[[_Asked], Callable[[int, int, int], float]], block: int = 4096) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query by the summed weights of its terms, ties by id.

    A weight is a function of a term's number, its count in a document and the document's length. Each task scores its
    documents against a block of queries and keeps the k best of each, so that no pairs but these are shuffled.
    """

    def scored(asked: _Asked) -> DataFrame:
        shared, weight = documents.sparkSession.sparkContext.broadcast(asked), weights(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            best: list[list[tuple[float, int]]] = [[] for _ in own.ids]
            for batch in batches:
                for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                    found, length = own.counts(text)
                    scores: dict[int, float] = {}
                    for term, n in found.items():
                        w = weight(term, n, length)
                        for q in own.queries_of[term]:
                            scores[q] = scores.get(q, 0.0) + w
                    for q, score in scores.items():
                        entry = (floor(score * 1e6 + 0.5) / 1e6, -doc_id)
                        if len(best[q]) < k:
                            heappush(best[q], entry)
                        elif entry > best[q][0]:
                            heapreplace(best[q], entry)
            rows = [(own.ids[q], -d, s) for q, entries in enumerate(best) for s, d in entries]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "doc_id", "score"])

        return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null").mapInArrow(run, "query_id bigint, doc_id bigint, score double")

    parts = [scored(asked) for asked in _asked_blocks(queries, block)] or [documents.sparkSession.createDataFrame([], "query_id bigint, doc_id bigint, score double")]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def keyword_hits(documents: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, doc_id, score): documents by the number of distinct query tokens they hold."""
    return _best_by_terms(documents, queries, k, lambda asked: lambda term, n, length: 1.0).withColumn("score", F.col("score").cast("bigint"))


def bm25_hits(documents: DataFrame, queries: DataFrame, k: int = 5, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, rank, doc_id, score): documents by BM25; counts and lengths are over all documents."""

    def weights(asked: _Asked) -> Callable[[int, int, int], float]:
        shared = documents.sparkSession.sparkContext.broadcast(asked)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, df, docs, total = shared.value, Counter(), 0, 0
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    found, length = own.counts(text)
                    df.update(found.keys())
                    docs, total = docs + 1, total + length
            rows = [*df.items(), (-1, docs), (-2, total)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["term", "n"])

        counted = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
        n = {r["term"]: r["n"] for r in counted.collect()}  # one row for each asked term
        docs, mean = n.get(-1, 0), n.get(-2, 0) / max(1, n.get(-1, 0))
        idf = [log(1 + (docs - n.get(t, 0) + 0.5) / (n.get(t, 0) + 0.5)) for t in range(len(asked.terms))]
        return lambda term, tf, length: idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / (mean or 1)))

    return _best_by_terms(documents, queries, k, weights)


def leg_quotas(weights: Sequence[float], top_k: int) -> list[int]:
    """How many hits each leg may give: weights normalised to 1, twice its share of top_k, at least 1."""
    total = sum(weights)
    if not weights or total <= 0:
        raise ValueError("weights must add up to more than 0")
    return [max(1, int(top_k * w / total * 2)) for w in weights]


def merge_legs(legs: Sequence[DataFrame], weights: Sequence[float] | None = None, top_k: int = 5) -> DataFrame:
    """(query_id, rank, id, leg): ranked legs (query_id, rank, id) in the order given, each cut to its quota, later repeats dropped, cut to top_k."""
    weights = list(weights) if weights is not None else [1.0] * len(legs)
    if len(weights) != len(legs):
        raise ValueError("there must be one weight for each leg")
    merged = None
    for no, (leg, quota) in enumerate(zip(legs, leg_quotas(weights, top_k))):
        part = leg.filter(F.col("rank") <= quota).select("query_id", F.lit(no).alias("leg"), F.col("rank").alias("leg_rank"), "id")
        merged = part if merged is None else merged.unionByName(part)
    first = Window.partitionBy("query_id", "id").orderBy("leg", "leg_rank")
    kept = merged.withColumn("place", F.row_number().over(first)).filter("place = 1")
    order = Window.partitionBy("query_id").orderBy("leg", "leg_rank", "id")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).select("query_id", "rank", "id", "leg")


def first_by_content(hits: DataFrame, content: str = "content") -> DataFrame:
    """Hits (query_id, rank, content) without those whose content came before; null contents go."""
    first = Window.partitionBy("query_id", content).orderBy("rank")
    return hits.filter(F.col(content).isNotNull()).withColumn("_place", F.row_number().over(first)).filter("_place = 1").drop("_place")


def confidence(hits: DataFrame) -> DataFrame:
    """(query_id, confidence): the mean of 1 - distance over a query's hits; 0 if none has a distance."""
    return hits.groupBy("query_id").agg(F.round(F.coalesce(F.avg(1.0 - F.col("distance")), F.lit(0.0)), 6).alias("confidence"))


def expand_query(query: Column) -> Column:
    """The query with the German term put beside each English one of the list."""
    out = query
    for term, other in EXPANSIONS.items():
        out = F.when(F.lower(query).contains(term), F.replace(out, F.lit(term), F.lit(f"{term} {other}"))).otherwise(out)
    return out
