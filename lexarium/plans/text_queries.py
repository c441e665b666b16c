"""Queries over single texts: sources, filters, chunking, sectioning, features, recognised pages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.embed import seeded_embedding
from ..functions.vectors import feature_hash_vector, fit_dimension
from ..functions.words import STOPWORDS
from ..operators import chunking, evaluation, filters, grounding, ocr_text, sectioning
from ..operators.compare import parse_category
from ..session import shared_folder
from ..sources import readers, store
from .registry import query, table

S = r"[ \t\n\r\f]"
W = r"[\p{L}\p{N}_]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '{S}+'), lambda x: x <> '')"


def _words(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '({W}+)', 1)"


def _entities(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS["en"])
    long = f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_-]+'), lambda w: regexp_full_match(w, '[a-zäöüß0-9_-]{{4,}}') and not list_contains([{stop}], w))"
    refs = f"list_transform(regexp_extract_all(coalesce({x}, ''), '(?:^|[^\\p{{L}}\\p{{N}}_])((?:DIN|EN|ISO|IEC|CEN|TR){S}*[-_]?{S}*[0-9]+(?:[-_][0-9]+)*)', 1), lambda r: lower(replace(r, ' ', '')))"
    return f"list_sort(list_distinct(list_concat({long}, {refs})))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))


# sources and sinks


@query("SELECT n_nationkey, 'n_nationkey: ' || n_nationkey || ' n_name: ' || n_name || ' n_regionkey: ' || n_regionkey AS content FROM nation")
def src_row_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as documents, every column named."""
    rows = table(spark, sf_dir, "nation")
    return rows.select("n_nationkey", readers.csv_content(["n_nationkey", "n_name", "n_regionkey"], True).alias("content"))


@query("SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type AS content, row_number() OVER (ORDER BY p_partkey) - 1 AS row_index FROM part")
def src_row_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen columns of rows as documents, numbered over the whole file."""
    rows = table(spark, sf_dir, "part").select("p_partkey", readers.csv_content(["p_name", "p_brand", "p_type"], False).alias("content"))
    return store.number_rows(rows, "p_partkey", name="n").select("p_partkey", "content", (F.col("n") - 1).alias("row_index"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS content FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def src_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at a JSON path as content; rows without it are dropped."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("content")).filter(F.col("content").isNotNull())


@query("SELECT event_id, coalesce(json_extract_string(props, '$.text'), props) AS content FROM events")
def src_json_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at a JSON path, or the whole JSON where it is missing."""
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.text"), "props").alias("content"))


@query("SELECT doc_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)', 1) AS domain FROM documents WHERE regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)')")
def src_url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain of each document's URL."""
    return table(spark, sf_dir, "documents").select("doc_id", readers.url_domain(F.col("url")).alias("domain")).filter(F.col("domain").isNotNull())


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (100000, 100009, 100020, 100027)")
def store_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by id; the ids reach the scan."""
    return table(spark, sf_dir, "documents").filter(F.col("doc_id").isin(100000, 100009, 100020, 100027)).select("doc_id", "lang", "source")


@query("SELECT coalesce(filetype, '') AS filetype, count(*) AS n, count(text) AS n_text, sum(length(text)) AS chars FROM documents GROUP BY 1")
def store_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a collection holds, by file type."""
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("filetype", F.lit("")).alias("filetype")).agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("n_text"), F.sum(F.length("text")).alias("chars"))


@query(
    """SELECT doc_id, title FROM documents d WHERE ingested_at - fetched_at > INTERVAL 3 DAY
    AND (title IS NULL OR title NOT IN (SELECT title FROM documents WHERE ingested_at - fetched_at <= INTERVAL 3 DAY AND title IS NOT NULL))"""
)
def sink_unseen_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late documents whose title isn't among those stored in time."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "title", "fetched_at", "ingested_at")
    late = F.col("ingested_at") - F.col("fetched_at") > F.expr("interval 3 days")
    return store.unseen_sources(docs.filter(late), docs.filter(~late), "title").select("doc_id", "title")


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 300 AS INTEGER) AS shard FROM documents")
def sink_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the shard they fill."""
    numbered = store.number_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return numbered.select("doc_id", store.shard_of(F.col("row_no"), 300).alias("shard"))


@query(
    """SELECT CASE WHEN lower(trim(section_type)) = 'table' THEN 'table' WHEN lower(trim(section_type)) IN ('image', 'technical_drawing') THEN lower(trim(section_type)) ELSE 'text' END AS content_type,
    count(*) AS n FROM sections GROUP BY 1"""
)
def sink_content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by content type, as a store files them."""
    return table(spark, sf_dir, "sections").groupBy(store.content_type(F.col("section_type")).alias("content_type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT section_id, regexp_replace(content, '{S}{{2,}}', ',', 'g') AS csv FROM sections WHERE upper(section_type) = 'TABLE' AND content IS NOT NULL")
def sink_table_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as comma-separated text."""
    rows = table(spark, sf_dir, "sections").filter((F.upper("section_type") == "TABLE") & F.col("content").isNotNull())
    return rows.select("section_id", F.regexp_replace("content", S + "{2,}", ",").alias("csv")).distinct()


def _written(spark: SparkSession, rows: DataFrame, kind: str, **options: str) -> str:
    """A new folder in the shared folder with the rows as files."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    rows.write.options(**options).format(kind).save(path)
    return path


@query("SELECT 'n_nationkey: ' || n_nationkey || ' n_name: ' || n_name || ' n_regionkey: ' || n_regionkey AS content, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS VARCHAR) AS row_index FROM nation")
def src_read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written to a CSV file and read as documents, numbered within the file."""
    path = _written(spark, table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey"), "csv", header="true")
    return readers.read_csv(spark, path).select("content", F.col("metadata")["row_index"].alias("row_index"))


@query("SELECT n_name AS content FROM nation")
def src_read_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written to files of JSON lines and read by the key of their content."""
    return readers.read_jsonl(spark, _written(spark, table(spark, sf_dir, "nation"), "json"), content_key="n_name").select("content")


_REGION = "SELECT n_regionkey, string_agg(n_name, chr(10) ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"


def _by_region(spark: SparkSession, sf_dir: str, value: Column) -> DataFrame:
    """One file for each region: value over the sorted names of its nations."""
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    return names.select(F.col("n_regionkey").alias("region"), value.alias("value"))


@query(f"SELECT names || chr(10) AS content FROM ({_REGION})")
def src_read_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files in a folder for each region, found by their extension at any depth."""
    rows = _by_region(spark, sf_dir, F.array_join("names", "\n"))
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    rows.repartition("region").write.partitionBy("region").text(path)
    return readers.read_directory(spark, path, extensions=["TXT"], glob="region=*/*.txt").select("content")


@query("SELECT n_name AS content FROM nation")
def src_read_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files with a list of nations each, read by a path into them."""
    rows = _by_region(spark, sf_dir, F.to_json(F.struct(F.struct(F.transform("names", lambda x: F.struct(x.alias("name"))).alias("items")).alias("data"))))
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    rows.repartition("region").write.partitionBy("region").text(path)
    return readers.read_json(spark, path, at="data.items", content_key="name").select("content")


@query(f"SELECT 'name: ' || replace(names, chr(10), chr(10) || chr(10) || 'name: ') AS content FROM ({_REGION})")
def src_read_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML files of nations, their names taken out by tag."""
    rows = _by_region(spark, sf_dir, F.concat(F.lit("<nations>"), F.array_join(F.transform("names", lambda x: F.concat(F.lit("<name>"), x, F.lit("</name>"))), ""), F.lit("</nations>")))
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    rows.repartition("region").write.partitionBy("region").text(path)
    return readers.read_xml(spark, path, content_tags=["name"]).select("content")


@query("SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page NULLS LAST, block_key) AS content, count(*) AS n_parts FROM (SELECT DISTINCT * FROM text_blocks WHERE text IS NOT NULL) GROUP BY doc_id")
def src_combine_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text of each parsed document as one text, blocks without a page last."""
    return readers.combine_parts(table(spark, sf_dir, "text_blocks").filter(F.col("text").isNotNull()).distinct(), "doc_id", "page", "block_key")


# filters and projections


@query(f"SELECT doc_id, length(text) AS n FROM documents WHERE {_strip('text')} <> ''")
def filter_drop_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that aren't blank."""
    return filters.drop_empty(_docs(spark, sf_dir)).select("doc_id", F.length("content").alias("n"))


@query("SELECT doc_id FROM documents WHERE (lang = 'de' OR lang IN ('fr', 'es')) AND n_chars > 1000 AND filetype <> 'pdf'")
def filter_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata condition, pushed to the scan."""
    condition = {"$and": [{"$or": [{"lang": "de"}, {"lang": {"$in": ["fr", "es"]}}]}, {"n_chars": {"$gt": 1000}}, {"filetype": {"$ne": "pdf"}}]}
    return table(spark, sf_dir, "documents").filter(filters.where(condition)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(text, 'NRV') AND NOT contains(text, 'Page')")
def filter_where_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text condition."""
    return _docs(spark, sf_dir).filter(filters.where_document({"$and": [{"$contains": "NRV"}, {"$not_contains": "Page"}]})).select("doc_id")


@query(f"SELECT doc_id, concat_ws(', ', CASE WHEN {_strip('filetype')} <> '' THEN 'filetype: ' || filetype END, CASE WHEN {_strip('source')} <> '' THEN 'source: ' || source END, CASE WHEN {_strip('title')} <> '' THEN 'title: ' || title END) AS shown FROM documents")
def filter_useful_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata that is shown, without blanks and internal keys."""
    docs = table(spark, sf_dir, "documents")
    keys = ("filetype", "id", "source", "title")
    meta = F.create_map(*(x for k in keys for x in (F.lit(k), F.col("url" if k == "id" else k))))
    entries = F.transform(F.map_entries(filters.useful_metadata(meta)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return docs.select("doc_id", F.array_join(entries, ", ").alias("shown"))


@query(f"SELECT doc_id, coalesce(CASE WHEN {_strip('text')} <> '' THEN text END, CASE WHEN {_strip('title')} <> '' THEN title END, '') AS content FROM documents")
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One content column from several that may hold it."""
    docs = table(spark, sf_dir, "documents")
    kept = [F.when(T.strip(F.col(c)) != "", F.col(c)) for c in ("text", "title")]
    return docs.select("doc_id", F.coalesce(*kept, F.lit("")).alias("content"))


@query(
    """WITH h AS (SELECT DISTINCT query_id, hit_id, 1 - distance AS score FROM search_hits WHERE query_id IS NOT NULL AND distance IS NOT NULL),
    r AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS place FROM h)
    SELECT query_id, hit_id FROM r WHERE score > 0.9 OR (best <= 0.9 AND place <= 2)"""
)
def filter_relevant_or_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits above a threshold, or the best two of a query without any."""
    hits = table(spark, sf_dir, "search_hits").filter(F.col("query_id").isNotNull() & F.col("distance").isNotNull())
    hits = hits.select("query_id", F.col("hit_id").alias("id"), (1 - F.col("distance")).alias("score")).distinct()
    return filters.relevant_or_best(hits, 0.9).select("query_id", F.col("id").alias("hit_id"))


# chunking


@query(
    """SELECT doc_id, g AS chunk_index, CASE WHEN length(text) <= 1000 THEN text ELSE substring(text, g * 800 + 1, 1000) END AS content
    FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 1000 THEN 1 ELSE (length(text) + 799) // 800 END)) AS g FROM documents WHERE length(text) > 0)"""
)
def chunk_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 1,000 characters with an overlap of 200."""
    return chunking.fixed_stride(_docs(spark, sf_dir)).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content")


_SENTENCES = f"list_filter(list_transform(regexp_extract_all(text, '([^.!?]*[.!?]|[^.!?]+$)', 1), lambda x: {_strip('x')}), lambda x: x <> '')"


@query(f"SELECT doc_id, len(s) AS chunk_count, unnest(s) AS content, unnest(range(0, len(s))) AS chunk_index FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents WHERE text IS NOT NULL)")
def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each sentence."""
    return chunking.by_sentence(_docs(spark, sf_dir)).select("doc_id", F.col("chunk_count").cast("long").alias("chunk_count"), "content", F.col("chunk_index").cast("long").alias("chunk_index"))


@query(
    f"""SELECT doc_id, i // 160 AS chunk_index, array_to_string(t[i + 1 : i + 200], ' ') AS content FROM (
    SELECT doc_id, t, unnest(range(0, len(t), 160)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{S}+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL))"""
)
def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 200 tokens with an overlap of 40."""
    return chunking.by_tokens(_docs(spark, sf_dir), 200, 40).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content")


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive chunks."""
    return chunking.recursive(_docs(spark, sf_dir)).select("doc_id", "chunk_index", "chunk_count", "content")


@query()
def chunk_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed to the size."""
    return chunking.by_character(_docs(spark, sf_dir)).select("doc_id", "chunk_index", "chunk_count", "content")


@query()
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs packed to the size."""
    return chunking.by_paragraph(_docs(spark, sf_dir)).select("doc_id", "chunk_index", "chunk_count", "content")


@query()
def chunk_model_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs in batches for a model."""
    return chunking.model_batches(_docs(spark, sf_dir)).select("doc_id", "chunk_index", "chunk_count", "content")


@query()
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences grouped where neighbouring feature vectors are near."""
    sents = chunking.by_sentence(_docs(spark, sf_dir)).select("doc_id", F.col("chunk_index").alias("sentence_idx"), "content")
    return chunking.semantic_breaks(sents.withColumn("vector", feature_hash_vector(F.col("content"))), 0.8).select("doc_id", "sentence_idx", "chunk_index")


# sectioning

_PARAGRAPHS = f"list_filter(list_transform(regexp_split_to_array(text, '\\n{S}*\\n'), lambda x: {_strip('x')}), lambda x: x <> '')"


@query(f"SELECT doc_id, i AS section_idx, content FROM (SELECT doc_id, unnest(p) AS content, unnest(range(0, len(p))) AS i FROM (SELECT doc_id, {_PARAGRAPHS} AS p FROM documents WHERE text IS NOT NULL)) WHERE length(content) >= 10")
def section_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs as sections."""
    return sectioning.text_sections(_docs(spark, sf_dir)).select("doc_id", F.col("section_idx").cast("long").alias("section_idx"), "content")


@query()
def section_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown sections of all documents."""
    return sectioning.markdown_sections(_docs(spark, sf_dir))


@query()
def section_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON sections of the events' properties."""
    return sectioning.json_sections(table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("content")))


@query(
    f"""SELECT DISTINCT section_id, CASE WHEN {_strip('title')} <> '' THEN title ELSE 'Segment ' || (section_idx + 1) END AS title, coalesce(level, 1) AS level,
    CASE WHEN upper({_strip('section_type')}) IN ('HEADING', 'PARAGRAPH', 'LIST', 'TABLE', 'CODE', 'IMAGE', 'UNKNOWN') THEN upper({_strip('section_type')}) ELSE 'PARAGRAPH' END AS section_type FROM sections"""
)
def section_prechunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with metadata as sections."""
    chunks = table(spark, sf_dir, "sections").withColumnRenamed("section_idx", "chunk_index").withColumn("level", F.col("level").cast("string"))
    both = sectioning.prechunked_sections(chunks.withColumn("doc_id", F.col("section_id")))
    return both.select(F.col("doc_id").alias("section_id"), "title", "level", "section_type").distinct()


_PAGES = f"SELECT doc_id, unnest(p) AS content, unnest(range(1, len(p) + 1)) AS page FROM (SELECT doc_id, list_filter(string_split(text, chr(12)), lambda x: {_strip('x')} <> '') AS p FROM documents WHERE text IS NOT NULL)"
_LINES = f"SELECT doc_id, page, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS line FROM (SELECT doc_id, page, string_split(content, chr(10)) AS l FROM ({_PAGES}))"


@query(_PAGES)
def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages between form feeds."""
    return sectioning.split_pages(_docs(spark, sf_dir)).select("doc_id", "content", F.col("page").cast("long").alias("page"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sectioning.page_lines(sectioning.split_pages(_docs(spark, sf_dir)))


@query(
    f"""WITH l AS ({_LINES}), f AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id, page ORDER BY line) AS run FROM l
    WHERE (regexp_matches(text, '{S}{{3,}}') AND regexp_matches(text, '{sectioning.TABLE_MARKS}')) OR regexp_matches(text, '{sectioning.TABLE_HEADS}')),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, run ORDER BY line) AS place FROM f)
    SELECT doc_id, page, min(line) AS start_line, max(line) AS end_line, count(*) AS line_count,
    string_agg(text, chr(10) ORDER BY line) FILTER (place <= 5) || CASE WHEN count(*) > 5 THEN chr(10) || '...' ELSE '' END AS text FROM n GROUP BY doc_id, page, run HAVING count(*) >= 2"""
)
def section_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables by gaps and islands of table lines."""
    return sectioning.find_tables(_lines(spark, sf_dir)).select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("page", "start_line", "end_line", "line_count")), "text")


@query(f"SELECT doc_id, page, line, text FROM ({_LINES}) WHERE regexp_matches(text, '{sectioning.IMAGE_MARKS}')")
def section_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that refer to images."""
    return sectioning.find_images(_lines(spark, sf_dir)).select("doc_id", F.col("page").cast("long").alias("page"), F.col("line").cast("long").alias("line"), "text")


_BLOCKS = f"""WITH l AS ({_LINES}), f AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id, page ORDER BY line) AS run FROM l WHERE {_strip('text')} <> '' AND NOT regexp_matches(text, '{sectioning.BLOCK_BREAKS}'))
    SELECT doc_id, page, min(line) AS start_line, max(line) AS end_line, string_agg(text, ' ' ORDER BY line) AS text FROM f GROUP BY doc_id, page, run"""


@query(_BLOCKS)
def section_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of pages."""
    return sectioning.find_blocks(_lines(spark, sf_dir)).select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("page", "start_line", "end_line")), "text")


@query(
    f"""SELECT 'text' AS content_type, count(*) AS n FROM ({_BLOCKS}) UNION ALL
    SELECT 'image', count(*) FROM ({_LINES}) WHERE regexp_matches(text, '{sectioning.IMAGE_MARKS}') HAVING count(*) > 0 UNION ALL
    SELECT 'table', count(*) FROM (WITH l AS ({_LINES}), f AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id, page ORDER BY line) AS run FROM l
    WHERE (regexp_matches(text, '{S}{{3,}}') AND regexp_matches(text, '{sectioning.TABLE_MARKS}')) OR regexp_matches(text, '{sectioning.TABLE_HEADS}'))
    SELECT 1 FROM f GROUP BY doc_id, page, run HAVING count(*) >= 2) HAVING count(*) > 0"""
)
def section_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, tables and images of all pages as documents, counted by type."""
    return sectioning.layout_documents(_lines(spark, sf_dir)).groupBy("content_type").agg(F.count(F.lit(1)).alias("n"))


# features

_HASH = ", ".join(f"('0x' || substring(md5(text), {31 - 2 * k}, 2))::INTEGER / 255.0::DOUBLE" for k in range(7))


@query(f"SELECT doc_id, round(length(text) / 1000.0::DOUBLE, 6) AS f_length, round(len(list_distinct(t)) / (len(t) + 1e-6::DOUBLE), 6) AS f_distinct, round(list_sum([{_HASH}])::DOUBLE, 6) AS f_hash FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{S}+'), lambda x: x <> '') AS t FROM documents WHERE length(text) > 0)")
def embed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature vector of each text, its hash part summed."""
    v = _docs(spark, sf_dir).filter(F.length("content") > 0).select("doc_id", feature_hash_vector(F.col("content")).alias("v"))
    return v.select("doc_id", F.round(F.col("v")[0], 6).alias("f_length"), F.round(F.col("v")[1], 6).alias("f_distinct"), F.round(F.aggregate(F.slice("v", 4, 7), F.lit(0.0), lambda s, x: s + x), 6).alias("f_hash"))


@query("SELECT vec_id, len(embedding) AS had, 96 AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def embed_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors brought to 96 dimensions."""
    rows = table(spark, sf_dir, "embeddings").withColumn("v", fit_dimension(F.col("embedding"), 96))
    return rows.select("vec_id", F.size("embedding").cast("long").alias("had"), F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


@query()
def embed_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded stand-in embedding of each passage."""
    rows = table(spark, sf_dir, "eval_cases").select("case_id", seeded_embedding(F.col("passage")).alias("v"))
    return rows.select("case_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


# grounding and evaluation of answers


@query(f"SELECT case_id, unnest({_entities('passage')}) AS entity FROM eval_cases")
def ground_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key terms of each passage."""
    return table(spark, sf_dir, "eval_cases").select("case_id", F.explode(T.entities(F.col("passage"))).alias("entity"))


_GROUND = f"""SELECT case_id, cov, CASE WHEN case_id % 3 = 0 THEN NULL ELSE (case_id % 100) / 100.0::DOUBLE END AS sim, missing, n FROM (
    SELECT case_id, len(a) AS n, list_sort(list_filter(a, lambda x: NOT list_contains(c, x))) AS missing, CASE WHEN len(a) = 0 THEN 1.0 ELSE 1.0 - len(list_filter(a, lambda x: NOT list_contains(c, x))) / len(a)::DOUBLE END AS cov
    FROM (SELECT case_id, {_entities('expected_answer')} AS a, {_entities('query')} AS c FROM eval_cases))"""
_SCORED = f"SELECT *, CASE WHEN sim IS NULL THEN cov ELSE cov * 0.6 + sim * 0.4 END AS score FROM ({_GROUND})"
_REVIEW = "(score < 0.5 OR cov < 0.3 OR coalesce(sim < 0.4, false))"


def _grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "eval_cases").select("case_id", F.col("expected_answer").alias("answer"), F.col("query").alias("context"))
    sim = F.when(F.col("case_id") % 3 == 0, None).otherwise((F.col("case_id") % 100) / 100.0)
    return grounding.verify(rows, similarity=sim)


@query(f"SELECT case_id, round(cov, 6) AS entity_coverage, round(score, 6) AS score, cov >= 0.7 AND coalesce(sim, 1.0) >= 0.75 AS verified, {_REVIEW} AS needs_review, len(missing) AS n_missing FROM ({_SCORED})")
def ground_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers held against their queries: coverage, score, verification and review."""
    rows = _grounded(spark, sf_dir)
    return rows.select("case_id", F.round("entity_coverage", 6).alias("entity_coverage"), F.round("score", 6).alias("score"), "verified", "needs_review", F.size("missing").cast("long").alias("n_missing"))


@query(
    f"""SELECT case_id, CASE WHEN len(missing) = 0 THEN '' ELSE chr(10) || chr(10) || '[SYSTEM WARNING: This response may contain hallucinated information. Confidence level: ' || CASE WHEN cov < 0.5 THEN 'low' ELSE 'moderate' END
    || '. The following terms were not found in the retrieved documents: ' || array_to_string(missing[1:5], ', ') || CASE WHEN len(missing) > 5 THEN ' and ' || (len(missing) - 5) || ' more' ELSE '' END
    || CASE WHEN sim IS NOT NULL THEN '. Semantic similarity score: ' || printf('%.2f', sim) ELSE '' END || CASE WHEN {_REVIEW} THEN '. This response has been flagged for expert review' ELSE '' END
    || '. Please verify this information from other sources.]' END AS note FROM ({_SCORED})"""
)
def ground_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warnings of these answers."""
    rows = _grounded(spark, sf_dir)
    return rows.select("case_id", grounding.warning(F.col("missing"), F.col("entity_coverage"), F.col("similarity"), F.col("needs_review")).alias("note"))


def _share(of: str, within: str) -> str:
    return f"len(list_filter(list_distinct({_tokens(of)}), lambda z: list_contains({_tokens(within)}, z))) / len(list_distinct({_tokens(of)}))::DOUBLE"


@query(
    f"""SELECT case_id, round(CASE WHEN {_strip("coalesce(expected_answer, '')")} = '' THEN 0.0 WHEN {_strip("coalesce(query, '')")} = '' THEN 0.5 ELSE {_share('query', 'expected_answer')} END, 6) AS relevance,
    round(CASE WHEN coalesce(expected_answer, '') = '' THEN 0.0 WHEN len({_tokens('expected_answer')}) = 0 THEN 0.5 WHEN {_strip("coalesce(passage, '')")} <> '' THEN {_share('passage', 'expected_answer')} ELSE 0.5 END, 6) AS factuality,
    round(CASE WHEN coalesce(expected_answer, '') = '' THEN 0.0 WHEN len({_tokens('expected_answer')}) = 0 THEN 0.5 WHEN {_strip("coalesce(passage, '')")} <> '' THEN {_share('expected_answer', 'passage')} ELSE 0.5 END, 6) AS support FROM eval_cases"""
)
def eval_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance, factuality against a reference, and support by a context."""
    q, a, p, none = F.col("query"), F.col("expected_answer"), F.col("passage"), F.lit(None).cast("string")
    return table(spark, sf_dir, "eval_cases").select("case_id", F.round(evaluation.relevance(q, a), 6).alias("relevance"), F.round(evaluation.factuality(a, p, none), 6).alias("factuality"), F.round(evaluation.factuality(a, none, p), 6).alias("support"))


# recognised text

@query()
def ocr_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likely errors per word of each block, and whether it needs cleaning."""
    rows = table(spark, sf_dir, "text_blocks").withColumn("rate", T.error_rate(F.col("text")))
    return rows.select("block_key", F.round("rate", 6).alias("error_rate"), filters.cleaning_gate(F.lit(0.5), F.col("rate")).alias("gate")).distinct()


def _votes(lang: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS[lang])
    return f"len(list_filter({_tokens('text')}, lambda w: list_contains([{stop}], w)))"


@query(f"SELECT doc_id, language, CASE language WHEN 'de' THEN 'model-de' WHEN 'en' THEN 'model-en' ELSE 'model-any' END AS model FROM (SELECT doc_id, CASE WHEN {_votes('de')} > {_votes('en')} THEN 'de' WHEN {_votes('en')} > 0 THEN 'en' END AS language FROM documents)")
def ocr_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language voted by stop words, and the model it is sent to."""
    routed = ocr_text.route_models(table(spark, sf_dir, "documents"), {"de": "model-de", "en": "model-en"}, "model-any")
    return routed.select("doc_id", "language", "model")


@query(
    """SELECT doc_id, 'Fix OCR errors in the following text. ' || CASE WHEN lang IS NULL THEN 'Preserve the original language of the document. DO NOT translate the content. ' ELSE 'Keep the text in the original ' || lang || ' language - DO NOT translate to English. ' END
    || 'Correct spelling, punctuation, and formatting issues while preserving the original meaning and technical terms. Preserve the original document layout including paragraphs, lists, and headings. '
    || CASE WHEN lang IS NULL THEN '' ELSE 'This document is in ' || lang || '. ' END || CASE WHEN filetype IS NULL THEN '' ELSE 'This is a ' || filetype || '. ' END
    || chr(10) || chr(10) || 'OCR TEXT:' || chr(10) || text || chr(10) || chr(10) || 'CORRECTED TEXT:' || chr(10) AS prompt FROM documents WHERE text IS NOT NULL"""
)
def ocr_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request to clean each document."""
    docs = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return docs.select("doc_id", ocr_text.cleaning_prompt(F.col("text"), F.col("lang"), F.col("filetype")).alias("prompt"))


_T = _strip("line")
_HEAD = (
    f"length({_T}) <= 100 AND NOT regexp_matches({_T}, '[.,;:!]$') AND ((regexp_matches({_T}, '\\p{{Lu}}') AND NOT regexp_matches({_T}, '\\p{{Ll}}')) OR regexp_matches({_T}, '^[0-9]+[.]') OR "
    f"(len(list_filter(regexp_split_to_array({_T}, '{S}+'), lambda x: x <> '')) > 0 AND len(list_filter(regexp_split_to_array({_T}, '{S}+'), lambda x: regexp_matches(x, '^\\p{{Lu}}'))) > 0.7 * len(list_filter(regexp_split_to_array({_T}, '{S}+'), lambda x: x <> ''))))"
)


@query(f"SELECT doc_id, count(*) FILTER ({_HEAD}) AS headings, count(*) FILTER (regexp_matches({_T}, '^([*•◦▪▫○●-]|[0-9]+[.)]|[a-z][.)])')) AS items, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY doc_id")
def ocr_line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each document are headings and list items."""
    rows = _docs(spark, sf_dir).filter(F.col("content").isNotNull()).select("doc_id", F.explode(T.lines(F.col("content"))).alias("line"))
    return rows.groupBy("doc_id").agg(F.count_if(T.is_heading(F.col("line"))).alias("headings"), F.count_if(T.is_list_item(F.col("line"))).alias("items"), F.count(F.lit(1)).alias("n"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "text_blocks").filter(F.length("text") > 0).select("doc_id", "page", "block_key", "text").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("block_key", "text")))
    return rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


@query()
def ocr_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as one Markdown document each, blocks without a page last."""
    return ocr_text.markdown_document(_pages(spark, sf_dir))


@query()
def ocr_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as one JSON document each, blocks without a page last."""
    return ocr_text.json_document(_pages(spark, sf_dir))


@query("SELECT doc_id FROM parsed_docs WHERE arrived_at - parsed_at > INTERVAL 1 DAY")
def ocr_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to be read again: those without a cache row from within a day of their parsing."""
    files = table(spark, sf_dir, "parsed_docs").withColumn("key", ocr_text.page_key("doc_id", "doc_number", "revision"))
    cache = files.filter(F.col("arrived_at") - F.col("parsed_at") <= F.expr("interval 1 day")).select("key", F.current_timestamp().alias("cached_at"))
    return ocr_text.stale_pages(files, cache, F.current_timestamp()).select("doc_id")


@query(f"SELECT doc_id, CASE WHEN {_strip('text')} = '' THEN text ELSE {_strip('text')} END AS cleaned FROM documents WHERE text IS NOT NULL")
def ocr_after_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model's reply says after its marker, for replies with the whole of each text, line feeds and later markers kept."""
    docs = _docs(spark, sf_dir).filter(F.col("content").isNotNull())
    reply = F.concat(F.lit("Here it is. CORRECTED TEXT:\n"), "content", F.lit("\n"))
    return docs.select("doc_id", ocr_text.after_marker(reply, F.col("content")).alias("cleaned"))


@query("SELECT event_id, 'REDUCTION' AS category, round(value / 1000, 6) AS confidence FROM events WHERE value BETWEEN 0 AND 1000 UNION ALL SELECT event_id, 'LLM_ERROR', 0.0 FROM events WHERE value IS NULL OR NOT value BETWEEN 0 AND 1000")
def parse_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies to their category, broken ones to an error."""
    reply = F.concat(F.lit('```json\n{"comparison_category": "reduction", "explanation": "x", "confidence": '), (F.col("value") / 1000).cast("string"), F.lit("}\n```"))
    rows = table(spark, sf_dir, "events").select("event_id", parse_category(reply).alias("r"))
    return rows.select("event_id", "r.category", F.round("r.confidence", 6).alias("confidence"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM documents WHERE text IS NOT NULL")
def escape_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts escaped for HTML."""
    return _docs(spark, sf_dir).filter(F.col("content").isNotNull()).select("doc_id", T.escape_html(F.col("content")).alias("escaped"))
