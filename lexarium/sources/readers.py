"""Readers: files to documents (content STRING, metadata MAP<STRING,STRING>).

Each is a function (spark, path, files=None, **options) -> DataFrame; files are options of the scan, such as a recursive
look-up or a pattern of names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT = "content string, metadata map<string,string>"
Reader = Callable[..., DataFrame]


def _about(kind: str, **more: Column) -> Column:
    path = F.col("_metadata.file_path")
    entries = {"source": path, "filename": F.element_at(F.split(path, "/"), -1), "filetype": F.lit(kind)} | more
    return F.create_map(*(x for k, v in entries.items() for x in (F.lit(k), v.cast("string"))))


def read_text(spark: SparkSession, path: str, files: Mapping[str, str] | None = None) -> DataFrame:
    """One document for each file."""
    return spark.read.options(**(files or {})).text(path, wholetext=True).select(F.col("value").alias("content"), _about("text").alias("metadata"))


def csv_content(columns: Sequence[str], named: bool) -> Column:
    """The columns' values joined by spaces, or `column: value` for each of them; nulls are empty."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.concat_ws(" ", *(F.concat(F.lit(f"{c}: "), v) for c, v in zip(columns, values))) if named else F.concat_ws(" ", *values)


def _numbered(rows: DataFrame) -> DataFrame:
    """rows of a scan with _path and _row, their number within their file from 0.

    A file may be cut into blocks read by several tasks: each counts its own rows, and the counts of the blocks before
    are added, so no file is brought into one task.
    """
    rows = rows.withColumns({"_path": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
    blocks = rows.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(blocks.select("_path", "_block", "_first", before.alias("_before")), ["_path", "_block"]).withColumn("_row", F.col("_before") + F.col("_at") - F.col("_first"))


def read_csv(spark: SparkSession, path: str, content_columns: Sequence[str] | None = None, metadata_columns: Sequence[str] = (), delimiter: str = ",", files: Mapping[str, str] | None = None) -> DataFrame:
    """One document for each row; row_index counts from 0 within a file. Columns that a file lacks are left out, no files give no rows."""
    if files and spark.read.format("binaryFile").options(**files).load(path).select("path").isEmpty():
        return spark.createDataFrame([], DOCUMENT)
    rows = spark.read.options(**(files or {})).csv(path, header=True, sep=delimiter, multiLine=True)
    columns = [c for c in (content_columns or rows.columns) if c in rows.columns]
    entries = {"source": F.col("_path"), "filetype": F.lit("csv"), "row_index": F.col("_row")} | {c: F.col(c) for c in metadata_columns if c in rows.columns}
    return _numbered(rows).select(csv_content(columns, content_columns is None).alias("content"), F.create_map(*(x for k, v in entries.items() for x in (F.lit(k), v.cast("string")))).alias("metadata"))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def xml_text(node: ElementTree.Element, text_tag: str | None = None, content_tags: Sequence[str] = (), keep_tags: bool = False) -> str:
    """The text of an element: that of text_tag, of content_tags as `tag: text`, its markup, or all of its text by lines."""
    if text_tag:
        return "\n\n".join((x.text or "").strip() for x in node.iter() if _local(x.tag) == text_tag)
    if content_tags:
        return "\n\n".join(f"{tag}: {(x.text or '').strip()}" for tag in content_tags for x in node.iter() if _local(x.tag) == tag)
    if keep_tags:
        return ElementTree.tostring(node, encoding="unicode")
    return "\n".join(t.strip() for t in node.itertext() if t.strip())


def xml_documents(raw: str, split_by: str | None = None, metadata_tags: Sequence[str] = (), **content: object) -> Iterator[tuple[str, dict[str, str]]]:
    """Documents of an XML text; what isn't XML gives one with metadata.error."""
    try:
        root = ElementTree.fromstring(raw)
    except ElementTree.ParseError as e:
        yield "", {"filetype": "xml", "error": str(e)}
        return
    for k, node in enumerate([x for x in root.iter() if _local(x.tag) == split_by and x is not root] if split_by else [root]):
        about = {"filetype": "xml"} | ({"index": str(k)} if split_by else {})
        for tag in metadata_tags:
            found = next((x for x in node.iter() if _local(x.tag) == tag), None)
            if found is not None:
                about[tag] = (found.text or "").strip()
                about |= {f"{tag}_{_local(a)}": v for a, v in found.attrib.items()}
        yield xml_text(node, **content), about


def _by_file(files: DataFrame, parse: Callable[[str], Iterator[tuple[str, dict[str, str]]]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(content, about | {"source": path}) for raw, path in zip(batch["value"], batch["path"]) for content, about in parse(raw)]
            yield pd.DataFrame(rows, columns=["content", "metadata"])

    return files.mapInPandas(run, DOCUMENT)


def _whole(spark: SparkSession, path: str, files: Mapping[str, str] | None) -> DataFrame:
    return spark.read.options(**(files or {})).text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))


def read_xml(spark: SparkSession, path: str, files: Mapping[str, str] | None = None, **options: object) -> DataFrame:
    """One document for each file, or each element split_by; see xml_documents."""
    return _by_file(_whole(spark, path, files), lambda raw: xml_documents(raw, **options))


def xml_find(expression: str, namespaces: Mapping[str, str] | None = None) -> Callable[[Column], Column]:
    """The texts of the elements that an expression finds in an XML text, as ARRAY<STRING>.

    Steps are `prefix:tag` with the given namespaces, `{uri}tag`, or a bare tag, which stands for that tag in any
    namespace. Null and broken texts give null.
    """
    steps = [p if not p or p in (".", "..", "*") or ":" in p or p.startswith(("{", "@", "[")) else "{*}" + p for p in re.split(r"/(?![^{]*\})", expression)]
    path = "/".join(steps)

    @F.pandas_udf("array<string>")
    def find(raw: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str] | None:
            try:
                root = ElementTree.fromstring(text) if text else None
            except ElementTree.ParseError:
                return None
            return None if root is None else ["".join(x.itertext()).strip() for x in root.findall(path, dict(namespaces or {}))]

        return raw.map(one)

    return find


def xml_namespaces(raw: Column) -> Column:
    """MAP of the prefixes that an XML text declares; the default one is ''."""
    pattern = F.lit(r'xmlns(?::([\w.-]+))?="([^"]+)"')
    pairs = F.arrays_zip(F.regexp_extract_all(raw, pattern, F.lit(1)).alias("key"), F.regexp_extract_all(raw, pattern, F.lit(2)).alias("value"))
    firsts = F.transform(F.array_distinct(F.transform(pairs, lambda x: x["key"])), lambda k: F.struct(k.alias("key"), F.filter(pairs, lambda x: x["key"] == k)[0]["value"].alias("value")))
    return F.map_from_entries(firsts)


def _walk(node: object, path: str) -> object:
    for key in [k for k in path.strip(".").split(".") if k]:
        if isinstance(node, dict) and key in node:
            node = node[key]
        elif isinstance(node, list) and key.isdigit() and int(key) < len(node):
            node = node[int(key)]
        else:
            raise ValueError(f"no {key} on the path {path}")
    return node


def json_documents(raw: str, at: str = "", content_key: str | None = None, whole_if_missing: bool = True, where: Mapping[str, object] | None = None) -> Iterator[tuple[str, dict[str, str]]]:
    """Documents of a JSON text: each item of the list at the dotted path `at`, or the one value there.

    A missing content_key gives the whole item, or no document if whole_if_missing is off. where keeps the items that
    have the given values under its keys.
    """
    try:
        node = _walk(json.loads(raw), at)
    except ValueError as e:
        yield "", {"filetype": "json", "error": str(e)}
        return
    for k, item in enumerate(node if isinstance(node, list) else [node]):
        if where and not (isinstance(item, dict) and all(item.get(key) == wanted for key, wanted in where.items())):
            continue
        value = item.get(content_key) if content_key and isinstance(item, dict) else item
        if value is None and content_key:
            if not whole_if_missing:
                continue
            value = item
        yield value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), {"filetype": "json", "index": str(k)}


def read_json(spark: SparkSession, path: str, files: Mapping[str, str] | None = None, **options: object) -> DataFrame:
    """The documents of each file, a file being one JSON value; see json_documents."""
    return _by_file(_whole(spark, path, files), lambda raw: json_documents(raw, **options))


def jsonl_content(line: str | None, content_key: str | None = None) -> str | None:
    """The document of a line of JSON: the value at content_key, else the whole item; None for blank and broken lines."""
    try:
        item = json.loads(line) if line and line.strip() else None
    except ValueError:
        return None
    if item is None:
        return None
    value = item.get(content_key, item) if content_key and isinstance(item, dict) else item
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def read_jsonl(spark: SparkSession, path: str, content_key: str | None = None, files: Mapping[str, str] | None = None) -> DataFrame:
    """One document for each line that is JSON; line counts from 1, blank and broken lines go. Large files are read by many tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(c, {"source": p, "filetype": "jsonl", "line": str(n + 1)}) for v, p, n in zip(batch["value"], batch["_path"], batch["_row"]) if (c := jsonl_content(v, content_key)) is not None]
            yield pd.DataFrame(rows, columns=["content", "metadata"])

    return _numbered(spark.read.options(**(files or {})).text(path)).select("value", "_path", "_row").mapInPandas(run, DOCUMENT)


class _Page(HTMLParser):
    """Collects the title, meta tags, image links and the text outside of scripts and styles."""

    def __init__(self, markdown: bool):
        super().__init__(convert_charrefs=True)
        self.markdown, self.skip, self.in_title = markdown, 0, False
        self.title, self.meta, self.images, self.parts = "", {}, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "meta" and values.get("name"):
            self.meta[values["name"].lower()] = values.get("content") or ""
        elif tag == "img" and values.get("src"):
            self.images.append(values["src"])
        elif self.markdown and re.fullmatch("h[1-6]", tag):
            self.parts.append("\n\n" + "#" * int(tag[1]) + " ")
        elif self.markdown and tag in ("p", "li", "br", "div"):
            self.parts.append("\n\n" if tag in ("p", "div") else "\n- " if tag == "li" else "\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.parts.append(data)


def html_documents(raw: str, mode: str = "text") -> Iterator[tuple[str, dict[str, str]]]:
    """An HTML page as text, Markdown or itself, with its title, description, author and image links."""
    if mode not in ("text", "html", "markdown"):
        raise ValueError(f"unknown mode {mode}")
    page = _Page(mode == "markdown")
    page.feed(raw)
    text = raw if mode == "html" else re.sub(r"\s+", " ", " ".join(page.parts)).strip() if mode == "text" else re.sub(r"\n{3,}", "\n\n", "".join(page.parts)).strip()
    about = {"filetype": "html", "title": page.title.strip(), "image_urls": json.dumps(page.images)} | {k: page.meta[k] for k in ("description", "author") if k in page.meta}
    yield text, about


def read_html(spark: SparkSession, path: str, mode: str = "text", files: Mapping[str, str] | None = None) -> DataFrame:
    """One document for each page; see html_documents."""
    return _by_file(_whole(spark, path, files), lambda raw: html_documents(raw, mode))


def web_documents(pages: DataFrame, mode: str = "text", lenient: bool = True) -> DataFrame:
    """Pages (url, html, and optionally status, content_type) of a crawl as documents.

    metadata has source, domain, and status and content_type where they are there. Pages without HTML or with a status
    of 400 and more give an empty document with metadata.error, or none without lenient.
    """
    known = [c for c in ("status", "content_type") if c in pages.columns]
    rows = pages.select("url", "html", *(F.col(c).cast("string").alias(c) for c in known), url_domain(F.col("url")).alias("domain"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[str, dict]] = []
            for row in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                about = {"source": row["url"], "filetype": "html"} | {c: row[c] for c in ("domain", *known) if row[c] is not None}
                bad = "no content" if row["html"] is None else f"status {row['status']}" if (row.get("status") or "").isdigit() and int(row["status"]) >= 400 else None
                if bad is None:
                    out += [(content, more | about) for content, more in html_documents(row["html"], mode)]
                elif lenient:
                    out.append(("", about | {"error": bad}))
            yield pd.DataFrame(out, columns=["content", "metadata"])

    return rows.mapInPandas(run, DOCUMENT)


def url_domain(url: Column) -> Column:
    """The host and port of a URL; null if there is none."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)
    return F.when(found != "", found)


def read_pdf(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, combine: bool = False, files: Mapping[str, str] | None = None) -> DataFrame:
    """One document for each page, from 1, or each file with combine. Needs pypdf on the workers; a file it can't read gives metadata.error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF files needs pypdf") from e
        for batch in batches:
            rows = []
            for raw, source in zip(batch["content"], batch["path"]):
                try:
                    reader = PdfReader(io.BytesIO(raw))
                    texts = [p.extract_text() or "" for p in reader.pages]
                    info = {f"pdf_{k.lstrip('/').lower()}": str(v) for k, v in (reader.metadata or {}).items()}
                except Exception as e:  # noqa: BLE001 - a broken file must not end the job
                    rows.append(("", {"source": source, "filetype": "pdf", "error": str(e)}))
                    continue
                rows += [(t.strip() or f"[No extractable text on page {n}]", {"source": source, "filetype": "pdf", "page_number": str(n), "total_pages": str(len(texts))} | info) for n, t in enumerate(texts, 1) if (first or 1) <= n <= (last or len(texts))]
            yield pd.DataFrame(rows, columns=["content", "metadata"])

    pages = spark.read.format("binaryFile").options(**(files or {})).load(path).select("content", "path").mapInPandas(run, DOCUMENT)
    return combine_pages(pages) if combine else pages


def combine_parts(parts: DataFrame, owner: str, page: str, order: str, text: str = "text") -> DataFrame:
    """(owner, content, n_parts): the parts of each owner as one text, by page and order, with a blank line between; those without a page come last."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page).isNull().alias("no_page"), F.col(page).alias("page"), F.col(order).alias("order"), F.col(text).alias("text"))))
    return parts.groupBy(owner).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("content"), F.count(F.lit(1)).alias("n_parts"))


def combine_pages(pages: DataFrame) -> DataFrame:
    """One document for each source, its pages in order with a blank line between."""
    rows = pages.select(F.col("metadata")["source"].alias("source"), F.col("metadata")["page_number"].cast("int").alias("page"), "content")
    joined = combine_parts(rows, "source", "page", "content", "content")
    return joined.select("content", F.create_map(F.lit("source"), F.col("source"), F.lit("filetype"), F.lit("pdf")).alias("metadata"))


READERS: dict[str, Reader] = {}
EXTENSIONS: dict[str, str] = {}


def register(name: str, reader: Reader, *extensions: str) -> None:
    """Name a reader and its file extensions, whatever their case; the last registration counts."""
    READERS[name.lower()] = reader
    EXTENSIONS.update({e.lower().lstrip("."): name.lower() for e in extensions})


register("text", read_text, "txt", "text", "md", "rst", "log")
register("csv", read_csv, "csv")
register("tsv", lambda spark, path, **o: read_csv(spark, path, delimiter="\t", **o), "tsv")
register("xml", read_xml, "xml")
register("json", read_json, "json")
register("jsonl", read_jsonl, "jsonl", "ndjson")
register("html", read_html, "html", "htm")
register("pdf", read_pdf, "pdf")


def reader_for(path: str, default: str | None = None) -> Reader:
    """The reader of a path's extension, else the default one."""
    name = EXTENSIONS.get(path.rsplit(".", 1)[-1].lower(), default)
    if name is None:
        raise ValueError(f"no reader for {path}")
    return READERS[name]


def _any_case(extension: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def _like(pattern: str) -> str:
    """A path pattern as a regular expression on the end of a path: * stays within a folder, ** doesn't."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "(?:^|/)" + "".join(parts.get(x, re.escape(x)) for x in re.split(r"(\*\*/|\*\*|\*|\?)", pattern)) + "$"


def read_directory(
    spark: SparkSession, path: str, extensions: Sequence[str] | None = None, recursive: bool = True, options: dict[str, dict] | None = None, glob: str | None = None, exclude: Sequence[str] = ()
) -> DataFrame:
    """The documents of all files of a directory by their extensions, whatever their case and depth; one scan for each reader.

    glob and exclude are patterns on the end of a path, such as "notes/**/*.md"; hidden files and folders are left out.
    """
    wanted: dict[str, list[str]] = {}
    for e in extensions or EXTENSIONS:
        if e.lower().lstrip(".") in EXTENSIONS:
            wanted.setdefault(EXTENSIONS[e.lower().lstrip(".")], []).append(e.lower().lstrip("."))
    found = spark.createDataFrame([], DOCUMENT)
    for name, ends in wanted.items():
        files = {"pathGlobFilter": f"*.{{{','.join(map(_any_case, ends))}}}", "recursiveFileLookup": str(recursive).lower()}
        found = found.unionByName(READERS[name](spark, path, files=files, **(options or {}).get(name, {})))
    source = F.col("metadata")["source"]
    if glob:
        found = found.filter(source.rlike(_like(glob)))
    for pattern in exclude:
        found = found.filter(~source.rlike(_like(pattern)))
    return found
