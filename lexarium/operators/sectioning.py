"""Sectioners: text, Markdown, JSON and page layout to flat section rows (section_idx, parent_idx, level, section_type, title, content)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, lines, pages, paragraphs, strip

SECTIONS = "doc_id bigint, section_idx int, parent_idx int, level int, section_type string, title string, content string"


def text_sections(documents: DataFrame, least: int = 10) -> DataFrame:
    """Paragraphs of at least `least` characters; section_idx counts all paragraphs."""
    found = documents.select("doc_id", F.posexplode(paragraphs(F.col("content"))).alias("section_idx", "content"))
    return found.filter(F.length("content") >= least).select("doc_id", "section_idx", F.lit(0).alias("level"), F.lit("PARAGRAPH").alias("section_type"), "content")


_FENCE, _ATX, _ITEM = re.compile(r"^\s*```(.*)$"), re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$"), re.compile(r"^\s*(?:[*+-]|\d+\.)\s*")
_SETEXT = re.compile(r"^\s*(=+|-+)\s*$")


def markdown_rows(text: str | None, least: int = 10) -> Iterator[tuple[int | None, int, str, str, str]]:
    """(parent_idx, level, section_type, title, content) in reading order; shorter paragraphs than `least` go, as does an open fence."""
    stack: list[tuple[int, int]] = []  # (level, index) of the open headings
    kind, held, n = "", [], 0
    language = ""
    rows: list[tuple[int | None, int, str, str, str]] = []

    def close() -> None:
        nonlocal kind, held
        content = "\n".join(held).strip()
        if kind and (kind == "LIST" and content or len(content) >= least):
            rows.append((stack[-1][1] if stack else None, stack[-1][0] if stack else 0, kind, "", content))
        kind, held = "", []

    source = (text or "").splitlines()
    k = 0
    while k < len(source):
        line = source[k]
        if kind == "CODE":
            if _FENCE.match(line):
                rows.append((stack[-1][1] if stack else None, stack[-1][0] if stack else 0, "CODE", language, "\n".join(held)))
                kind, held = "", []
            else:
                held.append(line)
        elif m := _FENCE.match(line):
            close()
            kind, language = "CODE", m.group(1).strip()
        elif (m := _ATX.match(line)) or (line.strip() and not kind and not _ITEM.match(line) and k + 1 < len(source) and _SETEXT.match(source[k + 1])):
            close()
            level = len(m.group(1)) if m else 1 if "=" in source[k + 1] else 2
            title = m.group(2) if m else line.strip()
            k += not m
            while stack and stack[-1][0] >= level:
                stack.pop()
            rows.append((stack[-1][1] if stack else None, level, "HEADING", title, ""))
            stack.append((level, len(rows) - 1))
        elif not line.strip():
            close()
        else:
            now = "LIST" if _ITEM.match(line) else "PARAGRAPH"
            if kind != now and not (kind == "LIST" and line.startswith((" ", "\t"))):
                close()
                kind = now
            held.append(line)
        k += 1
        n += 1
    if kind != "CODE":
        close()
    yield from rows


def markdown_sections(documents: DataFrame, least: int = 10) -> DataFrame:
    """Markdown (doc_id, content) to section rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, *row) for d, t in zip(batch["doc_id"], batch["content"]) for k, row in enumerate(markdown_rows(t, least))]
            frame = pd.DataFrame(rows, columns=["doc_id", "section_idx", "parent_idx", "level", "section_type", "title", "content"])
            frame["parent_idx"] = frame["parent_idx"].astype("Int32")
            yield frame

    return documents.select("doc_id", "content").mapInPandas(run, SECTIONS)


def json_rows(text: str | None) -> Iterator[tuple[int | None, int, str, str, str]]:
    """Sections of a JSON document: title or heading, content or text, children or sections; other JSON is one UNKNOWN section, what isn't JSON none."""
    try:
        root = json.loads(text or "")
    except ValueError:
        return
    rows: list[tuple[int | None, int, str, str, str]] = []

    def walk(node: object, parent: int | None, level: int) -> None:
        for item in node if isinstance(node, list) else [node]:
            if not isinstance(item, dict):
                continue
            title, content = str(item.get("title") or item.get("heading") or ""), item.get("content") or item.get("text") or ""
            kind = str(item.get("type") or ("HEADING" if title and level == 0 else "PARAGRAPH")).upper()
            own = parent
            if title or content:
                rows.append((parent, level, kind, title, content if isinstance(content, str) else json.dumps(content)))
                own = len(rows) - 1
            walk(item.get("children") or item.get("sections") or [], own, level + 1)

    walk(root, None, 0)
    if rows:
        yield from rows
    else:
        yield None, 0, "UNKNOWN", "", text or ""


def json_sections(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, *row) for d, t in zip(batch["doc_id"], batch["content"]) for k, row in enumerate(json_rows(t))]
            frame = pd.DataFrame(rows, columns=["doc_id", "section_idx", "parent_idx", "level", "section_type", "title", "content"])
            frame["parent_idx"] = frame["parent_idx"].astype("Int32")
            yield frame

    return documents.select("doc_id", "content").mapInPandas(run, SECTIONS)


KINDS = ("HEADING", "PARAGRAPH", "LIST", "TABLE", "CODE", "IMAGE", "UNKNOWN")


def prechunked_sections(chunks: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk_index, title, level, section_type, content) as sections: `Segment N` for want of a title, level 1, PARAGRAPH."""
    kind = F.upper(strip(F.col("section_type")))
    return chunks.select(
        "doc_id",
        F.col("chunk_index").alias("section_idx"),
        F.coalesce(F.when(strip(F.col("title")) != "", F.col("title")), F.concat(F.lit("Segment "), (F.col("chunk_index") + 1).cast("string"))).alias("title"),
        F.coalesce(F.col("level").try_cast("int"), F.lit(1)).alias("level"),
        F.when(kind.isin(*KINDS), kind).otherwise("PARAGRAPH").alias("section_type"),
        "content",
    )


def split_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, page, content): the pages between form feeds that aren't blank, counted from 1."""
    return documents.select("doc_id", F.posexplode(pages(F.col("content"))).alias("page", "content")).withColumn("page", F.col("page") + 1)


def page_lines(page_rows: DataFrame) -> DataFrame:
    """(doc_id, page, line, text), lines counted from 1."""
    return page_rows.select("doc_id", "page", F.posexplode(lines(F.col("content"))).alias("line", "text")).withColumn("line", F.col("line") + 1)


#: Fixed patterns of lines that belong to tables, beside three spaces in a row, and of table headers.
TABLE_MARKS = r"[.]{3,}|[|]|[0-9]+[ \t\n\r\f]{2,}[A-Za-z]|[A-Za-z]+[ \t\n\r\f]{2,}[0-9]+|^[ \t\n\r\f]*[0-9]+\.[0-9]+[ \t\n\r\f]+|^[ \t\n\r\f]*[A-Za-z]\)[ \t\n\r\f]+|^[ \t\n\r\f]*[0-9]+\)[ \t\n\r\f]+|^[ \t\n\r\f]*[•-][ \t\n\r\f]+"
TABLE_HEADS = r"(?i:Table|Tabelle|Tableau)|^[ \t\n\r\f]*Nr\.|^Key|^Légende|^Legende"
IMAGE_MARKS = r"(?i:Figure|Bild|Abbildung|Fig\.|image|picture)"
BLOCK_BREAKS = r"[.]{3,}|^[ \t\n\r\f]*[0-9]+\.[0-9]+[ \t\n\r\f]+|^[ \t\n\r\f]*[A-Za-z]\)[ \t\n\r\f]+"


def find_tables(line_rows: DataFrame, least_lines: int = 2, shown: int = 5) -> DataFrame:
    """Maximal runs of at least least_lines table lines, by gaps and islands; the text keeps `shown` lines and then '...'."""
    is_table = (F.col("text").rlike(SPACE + "{3,}") & F.col("text").rlike(TABLE_MARKS)) | F.col("text").rlike(TABLE_HEADS)
    flagged = line_rows.filter(is_table)
    order = Window.partitionBy("doc_id", "page").orderBy("line")
    runs = flagged.withColumn("run", F.col("line") - F.row_number().over(order)).withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "page", "run").orderBy("line")))
    text = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= shown, F.struct("place", "text")))), lambda x: x["text"])
    found = runs.groupBy("doc_id", "page", "run").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.count(F.lit(1)).alias("line_count"), F.array_join(text, "\n").alias("text"))
    return found.filter(F.col("line_count") >= least_lines).select(
        "doc_id", "page", "start_line", "end_line", "line_count", F.when(F.col("line_count") > shown, F.concat("text", F.lit("\n..."))).otherwise(F.col("text")).alias("text"), F.concat_ws("_", F.lit("table"), "page", "start_line").alias("table_id")
    )


def find_images(line_rows: DataFrame) -> DataFrame:
    """Lines that refer to an image."""
    return line_rows.filter(F.col("text").rlike(IMAGE_MARKS)).select("doc_id", "page", "line", "text", F.concat_ws("_", F.lit("image"), "page", "line").alias("image_id"))


def find_blocks(line_rows: DataFrame) -> DataFrame:
    """Runs of lines that are neither blank nor like tables, joined by spaces."""
    kept = line_rows.filter((strip(F.col("text")) != "") & ~F.col("text").rlike(BLOCK_BREAKS))
    order = Window.partitionBy("doc_id", "page").orderBy("line")
    runs = kept.withColumn("run", F.col("line") - F.row_number().over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    found = runs.groupBy("doc_id", "page", "run").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), text.alias("text"))
    return found.select("doc_id", "page", F.concat_ws("_", F.lit("block"), "page", "start_line").alias("block_id"), "start_line", "end_line", "text")


def layout_documents(line_rows: DataFrame) -> DataFrame:
    """Blocks, tables and image references as documents (doc_id, page, part_id, content_type, content)."""
    blocks = find_blocks(line_rows).select("doc_id", "page", F.col("block_id").alias("part_id"), F.lit("text").alias("content_type"), F.col("text").alias("content"))
    tables = find_tables(line_rows).select("doc_id", "page", F.col("table_id").alias("part_id"), F.lit("table").alias("content_type"), F.col("text").alias("content"))
    images = find_images(line_rows).select("doc_id", "page", F.col("image_id").alias("part_id"), F.lit("image").alias("content_type"), F.col("text").alias("content"))
    return blocks.unionByName(tables).unionByName(images)
