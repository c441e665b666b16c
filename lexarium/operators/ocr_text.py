"""Recognised pages: gates, routing, prompts, formatting and the page cache."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Category, error_column
from ..functions.text import error_rate, heading_level, is_heading, is_list_item, language_vote, paragraphs, strip
from ..session import shared_folder


@dataclass(frozen=True)
class CleanerConfig:
    """How a model is asked to clean a page."""

    confidence_threshold: float = 0.8
    least_error_rate: float = 0.05
    preserve_layout: bool = True
    preserve_language: bool = True
    translate_to: str | None = None
    default_model: str = "default"


def route_models(pages: DataFrame, models: Mapping[str, str], default: str, text: str = "text") -> DataFrame:
    """pages with language and model: the model of the detected language, or the default one."""
    chosen = F.lit(default)
    language = F.col("language")
    for lang, model in models.items():
        chosen = F.when(language == lang, F.lit(model)).otherwise(chosen)
    return pages.withColumn("language", language_vote(F.col(text))).withColumn("model", chosen)


def cleaning_prompt(text: Column, language: Column, kind: Column, config: CleanerConfig = CleanerConfig()) -> Column:
    """The request to clean a text, with what is known of its language and kind."""
    # The wording is fixed: results depend on it.
    layout = "Preserve the original document layout including paragraphs, lists, and headings." if config.preserve_layout else ""
    about = F.concat(F.coalesce(F.concat(F.lit("This document is in "), language, F.lit(". ")), F.lit("")), F.coalesce(F.concat(F.lit("This is a "), kind, F.lit(". ")), F.lit("")))
    if config.translate_to:
        to = F.lit(f" to {config.translate_to} while fixing OCR errors. ")
        order = F.coalesce(F.concat(F.lit("Translate the text from "), language, to), F.concat(F.lit("Translate the text"), to))
    else:
        plain = F.lit("Preserve the original language of the document. DO NOT translate the content. ")
        kept = F.concat(F.lit("Keep the text in the original "), language, F.lit(" language - DO NOT translate to English. "))
        order = F.coalesce(kept, plain) if config.preserve_language else plain
    return F.concat(
        F.lit("Fix OCR errors in the following text. "), order,
        F.lit("Correct spelling, punctuation, and formatting issues while preserving the original meaning and technical terms. " + layout + " "),
        about, F.lit("\n\nOCR TEXT:\n"), text, F.lit("\n\nCORRECTED TEXT:\n"),
    )


def after_marker(reply: Column, original: Column, marker: str = "CORRECTED TEXT:") -> Column:
    """What a reply says after the marker, the whole reply without one, the original if that is blank."""
    said = F.when(F.contains(reply, F.lit(marker)), F.split(reply, marker, 2)[1]).otherwise(reply)
    return F.coalesce(F.when(strip(said) != "", strip(said)), original)


#: (page_key, prompt, model) -> (page_key, reply); a page that failed has a null reply.
Cleaner = Callable[[DataFrame], DataFrame]


def clean_pages(pages: DataFrame, cleaner: Cleaner, models: Mapping[str, str] | None = None, config: CleanerConfig = CleanerConfig(), retries: int = 2) -> DataFrame:
    """pages (page_key, text, confidence) with cleaned, status and error.

    Pages read with enough confidence, or with few likely errors, keep their text (status "kept"). The others are sent
    to the cleaner, those without a reply again up to `retries` times, each round written before the next; a page
    without any reply keeps its text, with status "failed" and an error. Nulls are kept.
    """
    shared_folder(pages.sparkSession)
    rate = error_rate(F.col("text"))
    sure = (F.coalesce(F.col("confidence"), F.lit(0.0)) >= config.confidence_threshold) | (rate < config.least_error_rate) | (strip(F.coalesce("text", F.lit(""))) == "")
    routed = route_models(pages.select("page_key", "text", sure.alias("sure")), models or {}, config.default_model)
    waiting = routed.filter(~F.col("sure")).select("page_key", "text", "model", cleaning_prompt(F.col("text"), F.col("language"), F.lit(None).cast("string"), config).alias("prompt"))
    rounds = []
    for _ in range(retries + 1):
        replies = cleaner(waiting.select("page_key", "prompt", "model")).filter(F.col("reply").isNotNull()).dropDuplicates(["page_key"]).checkpoint()
        rounds.append(replies.select("page_key", "reply"))
        waiting = waiting.join(replies.select("page_key"), "page_key", "left_anti")
        if waiting.isEmpty():
            break
    replies = rounds[0]
    for more in rounds[1:]:
        replies = replies.unionByName(more)
    done = pages.join(routed.select("page_key", "sure").dropDuplicates(["page_key"]), "page_key").join(replies, "page_key", "left")
    failed = ~F.col("sure") & F.col("reply").isNull()
    cleaned = F.when(F.col("reply").isNotNull(), after_marker(F.col("reply"), F.col("text"))).otherwise(F.col("text"))
    status = F.when(F.col("sure"), "kept").when(failed, "failed").otherwise("cleaned")
    return done.withColumn("cleaned", cleaned).withColumn("status", status).withColumn("error", error_column(failed, Category.EXTERNAL_SERVICE, 1, "no reply")).drop("sure", "reply")


def process_documents(pages: DataFrame, recognise: Callable[[DataFrame], DataFrame], cleaner: Cleaner | None = None, style: str = "markdown", **options: object) -> DataFrame:
    """(doc_id, content, n_failed): pages (doc_id, page, image) recognised, cleaned and joined into one document each.

    recognise gives (doc_id, page, text, confidence); pages it can't read have a null text and count as failed, the
    others of their document go on.
    """
    if style not in ("markdown", "json"):
        raise ValueError(f"unknown format {style}")
    read = recognise(pages).withColumn("page_key", page_key("doc_id", "page"))
    failed = F.col("text").isNull()
    if cleaner:
        read = clean_pages(read, cleaner, **options).drop("text").withColumnRenamed("cleaned", "text")
        failed = failed | (F.col("status") == "failed")
    joined = (markdown_document if style == "markdown" else json_document)(read.filter(F.col("text").isNotNull()).select("doc_id", "page", "text"))
    counts = read.groupBy("doc_id").agg(F.count_if(failed).alias("n_failed"))
    return counts.join(joined, "doc_id", "left").select("doc_id", F.coalesce("content", F.lit("")).alias("content"), "n_failed")


def save_documents(documents: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write documents (doc_id, content) as Parquet; without overwrite they are added to what is there."""
    documents.select("doc_id", "content").write.mode("overwrite" if overwrite else "append").parquet(path)


def markdown_paragraph(text: Column) -> Column:
    """A paragraph as Markdown: list items as they are, headings with their level, runs of spaces as one."""
    flat = F.regexp_replace(text, "[ \t]+", " ")
    return F.when(is_list_item(flat) & ~is_heading(flat), flat).when(is_heading(flat), F.concat(F.repeat(F.lit("#"), heading_level(flat)), F.lit(" "), flat)).otherwise(flat)


def _page_name(page: Column) -> Column:
    return F.coalesce(page.cast("string"), F.lit("unknown"))


def markdown_document(pages: DataFrame) -> DataFrame:
    """(doc_id, content): the pages (doc_id, page, text) of each document in order, with a header from page 2 on; text without a page comes last, as page "unknown"."""
    body = F.array_join(F.transform(paragraphs(F.coalesce("text", F.lit(""))), markdown_paragraph), "\n\n")
    page = F.when((F.col("page") > 1) | F.col("page").isNull(), F.concat(F.lit("## Page "), _page_name(F.col("page")), F.lit("\n\n"), body)).otherwise(body)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("page").isNull().alias("no_page"), "page", page.alias("text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("content"))


def json_document(pages: DataFrame) -> DataFrame:
    """(doc_id, content): {"pages": {"1": {"text": ...}}}, pages in order; text without a page comes last, as page "unknown"."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("page").isNull().alias("no_page"), "page", "text")))
    entries = F.map_from_entries(F.transform(ordered, lambda x: F.struct(_page_name(x["page"]).alias("key"), F.struct(x["text"].alias("text")).alias("value"))))
    return pages.groupBy("doc_id").agg(F.to_json(F.struct(entries.alias("pages"))).alias("content"))


def page_key(*parts: str) -> Column:
    """The cache key of a page: the hash of what determines its text."""
    return F.md5(F.concat_ws("|", *(F.col(p).cast("string") for p in parts)))


def stale_pages(pages: DataFrame, cache: DataFrame, now: Column, days: int = 7, force: bool = False) -> DataFrame:
    """The pages (key, ...) that must be read again: those without a cache row (key, cached_at) younger than `days`."""
    return pages if force else pages.join(cache.filter(F.col("cached_at") > now - F.expr(f"interval {days} days")).select("key"), "key", "left_anti")
