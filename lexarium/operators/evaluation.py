"""Scores of retrieval, answers and recognised text."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import is_blank, jaccard, overlap_share, tokens


def relevance(query: Column, answer: Column) -> Column:
    """The share of the query's tokens that the answer has; 0 for an empty answer, else 0.5 for an empty query."""
    return F.when(is_blank(answer), 0.0).when(is_blank(query), 0.5).otherwise(overlap_share(tokens(query), tokens(answer)))


def factuality(answer: Column, reference: Column, context: Column) -> Column:
    """The share of the reference's tokens in the answer, or without one of the answer's in the context; 0 for an empty answer, 0.5 with nothing to go by."""
    a = tokens(answer)
    return F.when(F.coalesce(answer, F.lit("")) == "", 0.0).when(F.size(a) == 0, 0.5).when(~is_blank(reference), overlap_share(tokens(reference), a)).when(~is_blank(context), overlap_share(a, tokens(context))).otherwise(0.5)


def retrieval_scores(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, precision, recall, f1) of retrieved and relevant (query_id, item) rows.

    Hits count once each; precision is by the retrieved rows, repeats included. Queries with relevant items but nothing
    retrieved score 0; without relevant items they are left out.
    """
    got = retrieved.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_retrieved"))
    want = relevant.distinct()
    hit = retrieved.distinct().join(want, ["query_id", "item"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("tp"))
    rows = want.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant")).join(got, "query_id", "left").join(hit, "query_id", "left")
    tp = F.coalesce("tp", F.lit(0))
    precision = F.when(F.coalesce("n_retrieved", F.lit(0)) > 0, tp / F.col("n_retrieved")).otherwise(0.0)
    recall = tp / F.col("n_relevant")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return rows.select("query_id", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def answer_jaccard(a: Column, b: Column) -> Column:
    return jaccard(tokens(a), tokens(b))


def edit_rates(pairs: DataFrame) -> DataFrame:
    """pairs (truth, text) with cer: the edit distance over the length of the truth, 1 at most; 1 for an empty truth."""
    n = F.length("truth")
    return pairs.withColumn("edits", F.levenshtein("truth", "text")).withColumn("cer", F.when(F.coalesce(n, F.lit(0)) == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("edits") / n)))


@F.pandas_udf(DoubleType())
def ratio_error(truth: pd.Series, text: pd.Series) -> pd.Series:
    """1 - the matching ratio of the characters without white space in lower case; 1 for an empty truth."""

    def one(a: str | None, b: str | None) -> float:
        a, b = "".join((a or "").lower().split()), "".join((b or "").lower().split())
        return 1.0 - SequenceMatcher(None, a, b, autojunk=False).ratio() if a else 1.0

    return pd.Series([one(a, b) for a, b in zip(truth, text)])


@F.pandas_udf(DoubleType())
def ratio_word_error(truth: pd.Series, text: pd.Series) -> pd.Series:
    """1 - the matching ratio of the words without punctuation in lower case; 1 for an empty truth."""
    import re

    def of(t: str | None) -> list[str]:
        return re.sub(r"[^\w\s]", "", (t or "").lower()).split()

    def one(a: str | None, b: str | None) -> float:
        x, y = of(a), of(b)
        return 1.0 - SequenceMatcher(None, x, y, autojunk=False).ratio() if x else 1.0

    return pd.Series([one(a, b) for a, b in zip(truth, text)])


def page_means(pages: DataFrame, *measures: str) -> DataFrame:
    """(doc_id, n_pages, and each measure's mean): the pages (doc_id, page, measures) of a document taken together; pages without a value don't count for its mean."""
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), *(F.avg(m).alias(m) for m in measures))


def compare_methods(scores: DataFrame) -> DataFrame:
    """scores (method, error, accuracy) as means with the improvement on the baseline method in percent; -1 for a baseline error of 0, 0 for a baseline accuracy of 0."""
    means = scores.groupBy("method").agg(F.avg("error").alias("error"), F.avg("accuracy").alias("accuracy"))
    base = means.filter("method = 'baseline'").select(F.col("error").alias("base_error"), F.col("accuracy").alias("base_accuracy"))
    rows = means.withColumn("base_error", base.select("base_error").scalar()).withColumn("base_accuracy", base.select("base_accuracy").scalar())
    return rows.select(
        "method",
        F.round("error", 6).alias("error"),
        F.round("accuracy", 6).alias("accuracy"),
        F.round(F.when(F.col("base_error") == 0, -1.0).otherwise((F.col("base_error") - F.col("error")) / F.col("base_error") * 100), 4).alias("error_gain"),
        F.round(F.when(F.col("base_accuracy") == 0, 0.0).otherwise((F.col("accuracy") - F.col("base_accuracy")) / F.col("base_accuracy") * 100), 4).alias("accuracy_gain"),
    )
