"""Predicates: metadata and text filters given as dictionaries, and the gates before costly work."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip

_COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
}


def where(condition: Mapping[str, Any] | None) -> Column:
    """A metadata condition as a Column on promoted columns, so that it reaches the scan: {"a": 1}, {"a": {"$gt": 1}}, {"$and": [...]}."""
    if not condition:
        return F.lit(True)
    parts = []
    for key, value in condition.items():
        if key in ("$and", "$or"):
            join = (lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b)
            parts.append(reduce(join, [where(x) for x in value]))
        elif isinstance(value, Mapping):
            for op, v in value.items():
                if op not in _COMPARE:
                    raise ValueError(f"unknown operator {op}")
                parts.append(_COMPARE[op](F.col(key), v))
        else:
            parts.append(F.col(key) == value)
    return reduce(lambda a, b: a & b, parts)


def where_document(condition: Mapping[str, Any] | None, content: str = "content") -> Column:
    """A text condition: {"$contains": x}, {"$not_contains": x}, {"$and": [...]}, {"$or": [...]}; case counts."""
    if not condition:
        return F.lit(True)
    parts = []
    for key, value in condition.items():
        if key == "$contains":
            parts.append(F.col(content).contains(value))
        elif key == "$not_contains":
            parts.append(~F.col(content).contains(value))
        elif key in ("$and", "$or"):
            join = (lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b)
            parts.append(reduce(join, [where_document(x, content) for x in value]))
        else:
            raise ValueError(f"unknown operator {key}")
    return reduce(lambda a, b: a & b, parts)


def drop_empty(documents: DataFrame, content: str = "content") -> DataFrame:
    """Documents whose content isn't null, empty or blank."""
    return documents.filter(~is_blank(F.col(content)))


def relevant_or_best(hits: DataFrame, threshold: float = 0.7, fallback: int = 2) -> DataFrame:
    """Hits (query_id, id, score) above the threshold; for a query without any, its best `fallback` hits."""
    by_query = Window.partitionBy("query_id")
    ranked = hits.withColumn("best", F.max("score").over(by_query)).withColumn("place", F.row_number().over(by_query.orderBy(F.desc("score"), "id")))
    return ranked.filter((F.col("score") > threshold) | ((F.col("best") <= threshold) & (F.col("place") <= fallback))).drop("best", "place")


def cleaning_gate(confidence: Column, errors: Column, trust: float = 0.8, few: float = 0.05) -> Column:
    """Why a text needs no cleaning: 'confident', 'clean', or null if it does."""
    return F.when(confidence > trust, "confident").when(errors < few, "clean")


def too_short(a: Column, b: Column, least: int = 15) -> Column:
    """Whether either side of a pair has too little text to compare."""
    return F.least(F.length(strip(F.coalesce(a, F.lit("")))), F.length(strip(F.coalesce(b, F.lit(""))))) < least


def useful_metadata(metadata: Column) -> Column:
    """The entries of a MAP<STRING,STRING> that are not blank and no internal keys."""
    return F.map_filter(metadata, lambda k, v: ~k.isin("chunk_id", "embedding", "id") & F.coalesce(strip(v) != "", F.lit(False)))
