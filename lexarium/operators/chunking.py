"""Chunkers: one document to many chunks, with chunk_index and chunk_count within the document."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import check_window, sentences, stride_chunks, strip, token_windows, words
from ..functions.words import STOPWORDS

SEPARATORS = ("\n\n", "\n", ". ", ".", " ", "")
_SENTENCE = re.compile(r"[^.!?]*[.!?]|[^.!?]+$")


def exploded(documents: DataFrame, chunks: Column, content: str = "content") -> DataFrame:
    """documents with one row for each chunk: content, chunk_index, chunk_count; documents without chunks go."""
    with_chunks = documents.withColumn("_chunks", chunks).withColumn("chunk_count", F.size("_chunks"))
    return with_chunks.select(*[c for c in documents.columns if c != content], "chunk_count", F.posexplode("_chunks").alias("chunk_index", content))


def fixed_stride(documents: DataFrame, size: int = 1000, overlap: int = 200, content: str = "content") -> DataFrame:
    """Windows of size characters with an overlap."""
    return exploded(documents, stride_chunks(F.col(content), size, overlap), content)


def by_sentence(documents: DataFrame, content: str = "content") -> DataFrame:
    """One chunk for each sentence."""
    return exploded(documents, sentences(F.col(content)), content)


def by_tokens(documents: DataFrame, size: int = 1024, overlap: int = 200, content: str = "content") -> DataFrame:
    """Windows of white-space tokens."""
    return exploded(documents, token_windows(F.col(content), size, overlap), content)


def _join(parts: list[str], separator: str, size: int, overlap: int) -> list[str]:
    """Pack parts into chunks of at most size characters; each new chunk takes over the last parts that fit the overlap."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    gap = len(separator)
    for part in parts:
        extra = len(part) + (gap if held else 0)
        if held and total + extra > size:
            out.append(separator.join(held).strip())
            while held and (total > overlap or total + len(part) + gap > size):
                total -= len(held.pop(0)) + (gap if held else 0)
            extra = len(part) + (gap if held else 0)
        held.append(part)
        total += extra
    if held:
        out.append(separator.join(held).strip())
    return [x for x in out if x]


def split_recursive(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Cut at the coarsest separator that occurs, pack the parts, and cut parts that are still too long at finer ones."""
    chosen = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(chosen) + 1 :] if chosen in separators else ()
    parts = [p for p in (text.split(chosen) if chosen else list(text)) if p]
    out: list[str] = []
    fitting: list[str] = []
    for part in parts:
        if len(part) <= size:
            fitting.append(part)
            continue
        out += _join(fitting, chosen, size, overlap)
        fitting = []
        out += split_recursive(part, size, overlap, finer) if finer else [part]
    return out + _join(fitting, chosen, size, overlap)


def split_text(text: str | None, size: int = 1000, overlap: int = 200, separators: Sequence[str] = ("\n\n", "\n", " ", "")) -> list[str]:
    """The chunks of split_recursive with separators of one's own; a text that fits is one chunk, null and blank ones give none."""
    check_window(size, overlap)
    if not text or not text.strip():
        return []
    return [text] if len(text) <= size else split_recursive(text, size, overlap, tuple(separators))


def recursive_chunks(text: str | None, size: int = 1000, overlap: int = 200) -> list[str]:
    """Recursive chunks; a text that fits is cut into sentences, as are chunks that are still too long."""
    if not text:
        return []
    if len(text) <= size:
        return _sentences(text)
    out: list[str] = []
    for chunk in split_recursive(text, size, overlap):
        out += _sentences(chunk) if len(chunk) > size else [chunk]
    return out


def _sentences(text: str) -> list[str]:
    return [s for s in (m.strip() for m in _SENTENCE.findall(text)) if s]


def character_chunks(text: str | None, size: int = 1000, overlap: int = 200, separator: str = "\n") -> list[str]:
    """Parts between separators packed to the size; a text that fits is one chunk, longer parts are cut in windows."""
    if not text:
        return []
    if len(text) <= size:
        return [text]
    out: list[str] = []
    for chunk in _join([p for p in text.split(separator) if p], separator, size, overlap):
        out += [chunk] if len(chunk) <= size else [chunk[i : i + size] for i in range(0, len(chunk), size - overlap)]
    return out


def paragraph_chunks(text: str | None, size: int = 1000) -> list[str]:
    """Paragraphs packed greedily while they fit with a line feed between; longer ones are cut at the size."""
    out: list[str] = []
    held = ""
    for paragraph in (p.strip() for p in (text or "").split("\n\n")):
        if not paragraph:
            continue
        if held and len(held) + len(paragraph) + 1 <= size:
            held += "\n" + paragraph
            continue
        if held:
            out.append(held)
        while len(paragraph) > size:
            out.append(paragraph[:size].strip())
            paragraph = paragraph[size:].strip()
        held = paragraph
    return out + ([held] if held else [])


def batch_for_model(text: str | None, size: int = 2000) -> list[str]:
    """Paragraphs packed into batches while their own lengths add up to at most size; separators don't count."""
    out: list[list[str]] = []
    total = 0
    for paragraph in re.split(r"\n\s*\n", text or ""):
        if not paragraph.strip():
            continue
        if out and total + len(paragraph) <= size:
            out[-1].append(paragraph)
            total += len(paragraph)
        else:
            out.append([paragraph])
            total = len(paragraph)
    return ["\n\n".join(x) for x in out]


def _udf(cut: Callable[[str | None], list[str]]) -> Callable[[Column], Column]:
    @F.pandas_udf("array<string>")
    def chunks(text: pd.Series) -> pd.Series:
        return text.map(cut)

    return chunks


def recursive(documents: DataFrame, size: int = 1000, overlap: int = 200, content: str = "content") -> DataFrame:
    check_window(size, overlap)
    return exploded(documents, _udf(lambda t: recursive_chunks(t, size, overlap))(F.col(content)), content)


def by_separators(documents: DataFrame, separators: Sequence[str] = ("\n\n", "\n", " ", ""), size: int = 1000, overlap: int = 200, content: str = "content") -> DataFrame:
    """Chunks of split_text, cut at the coarsest of the given separators that occurs."""
    check_window(size, overlap)
    return exploded(documents, _udf(lambda t: split_text(t, size, overlap, separators))(F.col(content)), content)


def with_keywords(chunks: DataFrame, n: int = 6, language: str = "en", content: str = "content") -> DataFrame:
    """chunks with title, the first line that isn't blank, and keywords, the n commonest words of four letters and more that aren't stop words, ties in order of the alphabet."""
    stop = F.array(*(F.lit(w) for w in STOPWORDS[language]))
    own = F.filter(words(F.col(content)), lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w) & ~w.rlike("[0-9_]"))
    counted = F.transform(F.array_distinct(F.col("_words")), lambda w: F.struct((-F.size(F.filter(F.col("_words"), lambda x: x == w))).alias("n"), w.alias("word")))
    first = F.filter(F.transform(F.split(F.coalesce(F.col(content), F.lit("")), "\n"), strip), lambda x: x != "")
    keywords = F.transform(F.slice(F.array_sort(counted), 1, n), lambda x: x["word"])
    return chunks.withColumn("_words", own).withColumn("title", F.try_element_at(first, F.lit(1))).withColumn("keywords", keywords).drop("_words")


def by_character(documents: DataFrame, size: int = 1000, overlap: int = 200, separator: str = "\n", content: str = "content") -> DataFrame:
    check_window(size, overlap)
    return exploded(documents, _udf(lambda t: character_chunks(t, size, overlap, separator))(F.col(content)), content)


def by_paragraph(documents: DataFrame, size: int = 1000, content: str = "content") -> DataFrame:
    check_window(size, 0)
    return exploded(documents, _udf(lambda t: paragraph_chunks(t, size))(F.col(content)), content)


def model_batches(documents: DataFrame, size: int = 2000, content: str = "content") -> DataFrame:
    return exploded(documents, _udf(lambda t: batch_for_model(t, size))(F.col(content)), content)


def semantic_breaks(sentence_vectors: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Group the sentences (doc_id, sentence_idx, vector) of each document: a new chunk begins where the cosine to the one before falls below the threshold."""
    from pyspark.sql import Window

    from ..functions.vectors import cosine

    order = Window.partitionBy("doc_id").orderBy("sentence_idx")
    near = sentence_vectors.withColumn("near", cosine(F.col("vector"), F.lag("vector").over(order)))
    starts = F.when(F.coalesce(F.col("near"), F.lit(-1.0)) < threshold, 1).otherwise(0)
    return near.withColumn("chunk_index", F.sum(starts).over(order) - 1).drop("near")
