"""Queries over vectors, hits and questions: search, ranking, contexts, history, scores, pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import feature_hash_embedding
from ..operators import context, evaluation, search
from .pipeline import Pipeline
from .registry import query, table
from .text_queries import S, _strip, _tokens

#: Vectors are searched for the stated queries, the rows whose id is divisible by 20.
_DIST = "round(1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _first(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"])


_ONE = f"SELECT v.vec_id AS id, v.label, {_DIST} AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query(f"SELECT id, label, distance FROM ({_ONE}) ORDER BY distance, id LIMIT 5")
def search_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors to one."""
    return search.nearest(_vectors(spark, sf_dir), _first(spark, sf_dir))


@query(f"SELECT id, label, distance FROM ({_ONE}) WHERE label IN (1, 3) AND id > 20 ORDER BY distance, id LIMIT 5")
def search_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors under a metadata condition."""
    from ..operators.filters import where

    return search.nearest(_vectors(spark, sf_dir), _first(spark, sf_dir), keep=where({"$and": [{"label": {"$in": [1, 3]}}, {"id": {"$gt": 20}}]}))


@query(
    f"""SELECT query_id, rank, id, distance FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, {_DIST} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, v.vec_id) AS rank
    FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 10"""
)
def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each stated query, against all rows."""
    vectors = _vectors(spark, sf_dir)
    hits = search.search_many(vectors, vectors.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), 10)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "distance")


@query(f"SELECT id, distance FROM ({_ONE}) ORDER BY distance, id LIMIT 10")
def search_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest over shards: the best of each, merged."""
    rows = _vectors(spark, sf_dir).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(7)))
    return search.sharded_search(rows, _first(spark, sf_dir)).select("id", "distance")


@query(f"SELECT id, distance FROM ({_ONE}) WHERE label = 4 ORDER BY distance, id LIMIT 5")
def search_content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of one type."""
    return search.nearest(_vectors(spark, sf_dir), _first(spark, sf_dir), keep=F.col("label") == 4).select("id", "distance")


@query(f"SELECT label, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, id) AS rank FROM ({_ONE})) WHERE rank <= 3")
def search_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest vectors of each type."""
    return search.nearest_per_group(_vectors(spark, sf_dir), _first(spark, sf_dir), "label").select("label", "id", "distance", F.col("rank").cast("long").alias("rank"))


_ASKED = f"SELECT DISTINCT case_id AS query_id, unnest(list_distinct({_tokens('query')})) AS token FROM eval_cases WHERE case_id % 20 = 0"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_cases").filter("case_id % 20 = 0").select(F.col("case_id").alias("query_id"), F.col("query").alias("text"))


_KEYWORD = f"""WITH q AS ({_ASKED}), d AS (SELECT doc_id, unnest(list_distinct({_tokens('text')})) AS token FROM documents),
    s AS (SELECT query_id, doc_id, count(*) AS score FROM q JOIN d USING (token) GROUP BY ALL)
    SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5"""


@query(_KEYWORD)
def search_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by shared tokens, for the stated questions."""
    return search.keyword_hits(table(spark, sf_dir, "documents"), _questions(spark, sf_dir)).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


@query(
    f"""WITH q AS ({_ASKED}), t AS (SELECT doc_id, {_tokens('text')} AS toks FROM documents), c AS (SELECT count(*) AS n, avg(len(toks)) AS avg_length FROM t),
    p AS (SELECT doc_id, len(toks) AS length, unnest(toks) AS token FROM t), f AS (SELECT doc_id, length, token, count(*) AS tf FROM p SEMI JOIN (SELECT DISTINCT token FROM q) USING (token) GROUP BY ALL),
    w AS (SELECT f.doc_id, f.token, ln(1 + (c.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length)) AS w FROM f JOIN (SELECT token, count(*) AS df FROM f GROUP BY 1) USING (token), c),
    s AS (SELECT query_id, doc_id, round(sum(w), 6) AS score FROM w JOIN q USING (token) GROUP BY ALL)
    SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5"""
)
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by BM25, for the stated questions."""
    return search.bm25_hits(table(spark, sf_dir, "documents"), _questions(spark, sf_dir)).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def _legs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    hits = table(spark, sf_dir, "search_hits").filter(F.col("query_id").isNotNull() & F.col("distance").isNotNull())
    best = hits.groupBy("query_id", F.lower("retriever").alias("retriever"), F.col("doc_id").alias("id")).agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query_id", "retriever").orderBy("distance", "id")
    ranked = best.withColumn("rank", F.row_number().over(order))
    return {name: ranked.filter(F.col("retriever") == name) for name in ("vector", "keyword")}


_LEGS = """WITH b AS (SELECT query_id, lower(retriever) AS retriever, doc_id AS id, min(distance) AS distance FROM search_hits WHERE query_id IS NOT NULL AND distance IS NOT NULL GROUP BY ALL),
    l AS (SELECT *, row_number() OVER (PARTITION BY query_id, retriever ORDER BY distance, id) AS leg_rank, CASE retriever WHEN 'vector' THEN 0 WHEN 'keyword' THEN 1 END AS leg FROM b),
    m AS (SELECT * FROM l WHERE (leg = 0 AND leg_rank <= 6) OR (leg = 1 AND leg_rank <= 3)),
    u AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY leg, leg_rank) AS place FROM m),
    h AS (SELECT query_id, id, leg, row_number() OVER (PARTITION BY query_id ORDER BY leg, leg_rank, id) AS rank FROM u WHERE place = 1)"""


@query(f"{_LEGS} SELECT query_id, rank, id, leg FROM h WHERE rank <= 5")
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked legs merged by quotas of 2 to 1."""
    legs = _legs(spark, sf_dir)
    return search.merge_legs([legs["vector"], legs["keyword"]], [2, 1]).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "leg")


@query(
    """WITH h AS (SELECT DISTINCT query_id, hit_rank, hit_id, text FROM search_hits JOIN documents USING (doc_id) WHERE query_id IS NOT NULL AND text IS NOT NULL)
    SELECT query_id, hit_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY hit_rank, hit_id) AS place FROM h) WHERE place = 1"""
)
def search_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits without those whose text came before in their query; texts are compared by hash, so they aren't shuffled."""
    hits = table(spark, sf_dir, "search_hits").filter(F.col("query_id").isNotNull()).select("query_id", "hit_rank", "hit_id", "doc_id").distinct()
    docs = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("content"))
    rows = hits.join(docs, "doc_id").select("query_id", F.struct("hit_rank", "hit_id").alias("rank"), "content")
    return search.first_by_content(rows).select("query_id", "rank.hit_id")


@query("SELECT query_id, round(coalesce(avg(1 - distance), 0), 6) AS confidence FROM search_hits WHERE query_id IS NOT NULL GROUP BY 1")
def search_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean relevance of each query's hits."""
    return search.confidence(table(spark, sf_dir, "search_hits").filter(F.col("query_id").isNotNull()))


_STEPS = "SELECT case_id, query, query AS x FROM eval_cases"
for _en, _de in search.EXPANSIONS.items():
    _STEPS = f"SELECT case_id, query, CASE WHEN contains(lower(query), '{_en}') THEN replace(x, '{_en}', '{_en} {_de}') ELSE x END AS x FROM ({_STEPS})"


@query(f"SELECT case_id, x AS expanded FROM ({_STEPS})")
def search_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions widened by the term list."""
    return table(spark, sf_dir, "eval_cases").select("case_id", search.expand_query(F.col("query")).alias("expanded"))


@query(f"SELECT doc_id, regexp_extract(text, '(Der Abschnitt über [^.]*(?:[.][^ \\n\\t\\r\\f][^.]*)*[.])(?:{S}|$)', 1) AS statement FROM documents WHERE regexp_matches(text, 'Der Abschnitt über [^.]*(?:[.][^ \\n\\t\\r\\f][^.]*)*[.](?:{S}|$)')")
def search_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence that begins with a fixed phrase, up to a full stop before white space."""
    pattern = rf"(Der Abschnitt über [^.]*(?:[.][^ \n\t\r\f][^.]*)*[.])(?:{S}|$)"
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike(pattern))
    return docs.select("doc_id", F.regexp_extract("text", pattern, 1).alias("statement"))


# contexts and prompts


def _top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = _legs(spark, sf_dir)
    hits = search.merge_legs([legs["vector"], legs["keyword"]], [2, 1])
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source", "filetype")
    return hits.join(docs, "id")


_TOP = f"{_LEGS}, t AS (SELECT query_id, rank, text AS content, source, filetype FROM h JOIN documents ON id = doc_id WHERE rank <= 5 AND text <> '')"
_META = "CASE WHEN trim(source) <> '' THEN ' [Metadata: source: ' || source || ']' ELSE '' END"


@query(f"{_TOP} SELECT query_id, string_agg('Document ' || rank || {_META} || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM t GROUP BY query_id")
def context_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of each query as a plain context."""
    hits = _top_hits(spark, sf_dir).withColumn("about", F.when(F.trim("source") != "", F.concat(F.lit("source: "), "source")))
    return context.simple_context(hits, metadata="about")


@query(
    f"""{_TOP}, c AS (SELECT query_id, string_agg('Document ' || rank || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS x FROM t GROUP BY query_id),
    k AS (SELECT query_id, x, substring(x, 1, 2000) AS head, 2000 - instr(reverse(substring(x, 1, 2000)), '.') + 1 AS stop FROM c)
    SELECT query_id, CASE WHEN length(x) <= 2000 THEN x ELSE CASE WHEN contains(head, '.') AND stop - 1 > 1800 THEN substring(head, 1, stop) ELSE head END || chr(10) || '[Context truncated due to length]' END AS context FROM k"""
)
def context_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts cut at 2,000 characters, at a full stop if one is near."""
    return context.simple_context(_top_hits(spark, sf_dir), max_length=2000)


@query(
    f"""{_TOP} SELECT query_id, string_agg('## Document ' || rank || chr(10) || CASE WHEN {_strip("coalesce(source, '')")} <> '' OR {_strip("coalesce(filetype, '')")} <> '' THEN '### Metadata' || chr(10) ||
    CASE WHEN {_strip("coalesce(source, '')")} <> '' THEN '- **source**: ' || source || chr(10) ELSE '' END || CASE WHEN {_strip("coalesce(filetype, '')")} <> '' THEN '- **filetype**: ' || filetype || chr(10) ELSE '' END
    || chr(10) || '### Content' || chr(10) ELSE '' END || content || chr(10) || chr(10), '' ORDER BY rank) AS context FROM t GROUP BY query_id"""
)
def context_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of each query as a Markdown context."""
    return context.markdown_context(_top_hits(spark, sf_dir), {"source": "source", "filetype": "filetype"})


@query()
def context_markdown_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown contexts cut at 2,000 characters, before a header or behind a full stop if one is near."""
    return context.markdown_context(_top_hits(spark, sf_dir), {"source": "source", "filetype": "filetype"}, 2000)


@query(
    """SELECT case_id, CASE suite WHEN 'compare' THEN 'Compare: ' || coalesce(query, '') || chr(10) || coalesce(passage, '') ELSE 'Q: ' || coalesce(query, '') || chr(10) || 'C: ' || coalesce(passage, '') END AS prompt FROM eval_cases"""
)
def context_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts from named templates."""
    rows = table(spark, sf_dir, "eval_cases").withColumnRenamed("suite", "template_name")
    chosen = context.named_template(rows, {"qa": "Q: {query}\nC: {context}", "compare": "Compare: {query}\n{context}"}, "qa")
    return chosen.select("case_id", context.fill_template(F.col("template"), query=F.col("query"), context=F.col("passage")).alias("prompt"))


# history: the events of a user are the turns of a conversation


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.when(F.col("event_id") % 2 == 0, "human").otherwise("ai").alias("role"), F.col("event_type").alias("text"))


@query("SELECT conv_id, turn FROM (SELECT user_id AS conv_id, event_id AS turn, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events) WHERE place <= 6")
def history_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns of each conversation."""
    return context.recent_turns(_turns(spark, sf_dir)).select("conv_id", "turn")


@query(
    """SELECT user_id AS conv_id, event_id AS turn, coalesce(string_agg(CASE WHEN event_id % 2 = 0 THEN 'Human: ' ELSE 'Assistant: ' END || event_type, chr(10)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS history FROM events"""
)
def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came before each turn."""
    return context.history_before(_turns(spark, sf_dir)).select("conv_id", "turn", "history")


# evaluation

_RETRIEVED = "SELECT query_id, source AS item FROM (SELECT DISTINCT query_id, hit_id, doc_id FROM search_hits WHERE query_id IS NOT NULL AND hit_rank <= 5) JOIN documents USING (doc_id) WHERE source IS NOT NULL"
_SCORES = f"""WITH r AS ({_RETRIEVED}), w AS (SELECT DISTINCT case_id AS query_id, unnest(relevant_docs) AS item FROM eval_cases),
    g AS (SELECT query_id, count(*) AS got FROM r GROUP BY 1), t AS (SELECT query_id, count(*) AS tp FROM (SELECT DISTINCT * FROM r) SEMI JOIN w USING (query_id, item) GROUP BY 1),
    s AS (SELECT query_id, coalesce(tp, 0) / got::DOUBLE AS p, coalesce(tp, 0) / want::DOUBLE AS c FROM (SELECT query_id, count(*) AS want FROM w GROUP BY 1) LEFT JOIN g USING (query_id) LEFT JOIN t USING (query_id))
    SELECT query_id, round(coalesce(p, 0), 6) AS precision, round(c, 6) AS recall, round(CASE WHEN coalesce(p, 0) + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END, 6) AS f1 FROM s"""


def _retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits").filter(F.col("query_id").isNotNull() & (F.col("hit_rank") <= 5)).select("query_id", "hit_id", "doc_id").distinct()
    got = hits.join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("item")), "doc_id").filter(F.col("item").isNotNull())
    want = table(spark, sf_dir, "eval_cases").select(F.col("case_id").alias("query_id"), F.explode("relevant_docs").alias("item"))
    return evaluation.retrieval_scores(got.select("query_id", "item"), want)


@query(_SCORES)
def eval_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of the first five hits of each question."""
    return _retrieval(spark, sf_dir)


@query(f"SELECT count(*) AS cases, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM ({_SCORES})")
def eval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means of these scores."""
    return _retrieval(spark, sf_dir).agg(F.count(F.lit(1)).alias("cases"), *(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")))


_A, _B = f"list_distinct({_tokens('expected_answer')})", f"list_distinct({_tokens('passage')})"


@query(f"SELECT case_id, round(CASE WHEN len({_A}) = 0 OR len({_B}) = 0 THEN 0 ELSE len(list_filter({_A}, lambda z: list_contains({_B}, z))) / len(list_distinct(list_concat({_A}, {_B})))::DOUBLE END, 6) AS jaccard FROM eval_cases")
def eval_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike answers and passages are."""
    return table(spark, sf_dir, "eval_cases").select("case_id", F.round(evaluation.answer_jaccard(F.col("expected_answer"), F.col("passage")), 6).alias("jaccard"))


@query(
    """WITH r AS (SELECT query_id, list(DISTINCT source) AS got FROM search_hits JOIN documents USING (doc_id) WHERE query_id IS NOT NULL AND source IS NOT NULL AND hit_rank <= 5 GROUP BY 1)
    SELECT case_id, len(list_filter(relevant_docs, lambda w: len(list_filter(coalesce(got, []), lambda g: contains(g, w))) > 0)) > 0 AS included FROM eval_cases LEFT JOIN r ON query_id = case_id"""
)
def eval_source_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any expected source is within a source of the first five hits."""
    hits = table(spark, sf_dir, "search_hits").filter(F.col("query_id").isNotNull() & (F.col("hit_rank") <= 5)).select("query_id", "doc_id").distinct()
    got = hits.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").filter(F.col("source").isNotNull()).select(F.col("query_id").alias("case_id"), "source").distinct()
    want = table(spark, sf_dir, "eval_cases").select("case_id", F.explode("relevant_docs").alias("want"))
    found = want.join(got, "case_id").filter(F.contains("source", "want")).select("case_id").distinct().withColumn("included", F.lit(True))
    return table(spark, sf_dir, "eval_cases").select("case_id").join(found, "case_id", "left").select("case_id", F.coalesce("included", F.lit(False)).alias("included"))


@query()
def eval_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance in characters and character error rate of every case; a null text has no distance and an error rate of 1."""
    pairs = table(spark, sf_dir, "eval_cases").select("case_id", F.col("query").alias("truth"), F.col("expected_answer").alias("text"))
    return evaluation.edit_rates(pairs).select("case_id", F.col("edits").cast("long").alias("edits"), F.round("cer", 6).alias("cer"))


@query()
def eval_ratio_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character and word error by matching ratio."""
    a, b = F.col("passage"), F.col("expected_answer")
    return table(spark, sf_dir, "eval_cases").select("case_id", F.round(evaluation.ratio_error(a, b), 6).alias("cer"), F.round(evaluation.ratio_word_error(a, b), 6).alias("wer"))


@query(
    """WITH s AS (SELECT coalesce(lower(retriever), 'none') AS method, coalesce(distance, 1) AS error, 1 - coalesce(distance, 1) AS accuracy FROM search_hits),
    m AS (SELECT CASE method WHEN 'vector' THEN 'baseline' ELSE method END AS method, avg(error) AS error, avg(accuracy) AS accuracy FROM s GROUP BY 1), b AS (SELECT error AS be, accuracy AS ba FROM m WHERE method = 'baseline')
    SELECT method, round(error, 6) AS error, round(accuracy, 6) AS accuracy, round(CASE WHEN be = 0 THEN -1 ELSE (be - error) / be * 100 END, 4) AS error_gain, round(CASE WHEN ba = 0 THEN 0 ELSE (accuracy - ba) / ba * 100 END, 4) AS accuracy_gain FROM m, b"""
)
def eval_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrievers against a baseline."""
    method = F.coalesce(F.lower("retriever"), F.lit("none"))
    d = F.coalesce("distance", F.lit(1.0))
    return evaluation.compare_methods(table(spark, sf_dir, "search_hits").select(F.when(method == "vector", "baseline").otherwise(method).alias("method"), d.alias("error"), (1 - d).alias("accuracy")))


# whole pipelines


def retrieve(documents: DataFrame, questions: DataFrame, top_k: int = 5) -> DataFrame:
    """Hits (query_id, rank, id, leg, content) of questions (query_id, query): BM25 and nearest embeddings merged 2 to 1."""
    asked = questions.select("query_id", F.col("query").alias("text"))
    by_words = search.bm25_hits(documents.select("doc_id", "text"), asked, 2 * top_k).withColumnRenamed("doc_id", "id")
    vectors = documents.select(F.col("doc_id").alias("id"), feature_hash_embedding(F.col("text")).alias("vector"))
    near = search.search_many(vectors, asked.select("query_id", feature_hash_embedding(F.col("text")).alias("vector")), 2 * top_k)
    hits = search.merge_legs([by_words, near], [2, 1], top_k)
    return hits.join(documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id")


@query()
def rag_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to grounded answers: retrieval by words and vectors over all documents, context, generation, verification by entities and vectors."""
    questions = table(spark, sf_dir, "eval_cases").select(F.col("case_id").alias("query_id"), "query")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    answers = Pipeline.standard(lambda asked: retrieve(documents, asked)).answer(questions)
    return answers.select("query_id", "answer", F.round("entity_coverage", 6).alias("entity_coverage"), F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"), "verified", "needs_review")


@query(
    """SELECT grouping(lang) + 2 * grouping(filetype) AS kind, lang, filetype, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY CUBE (lang, filetype)"""
)
def corpus_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and file type with all totals."""
    cube = table(spark, sf_dir, "documents").cube("lang", "filetype").agg((F.grouping("lang") + 2 * F.grouping("filetype")).cast("long").alias("kind"), F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))
    return cube.select("kind", "lang", "filetype", "n", "sources")


@query(f"SELECT doc_id, len({_tokens('text')}) AS n_tokens, len(list_distinct({_tokens('text')})) AS n_distinct FROM documents")
def corpus_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.token_list(F.col("text"))).cast("long").alias("n_tokens"), F.size(T.tokens(F.col("text"))).cast("long").alias("n_distinct"))


@query("SELECT source FROM documents WHERE lang = 'de' AND source IS NOT NULL INTERSECT SELECT source FROM documents WHERE lang = 'fr' AND source IS NOT NULL")
def corpus_sources_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with documents of two languages."""
    of = lambda lang: table(spark, sf_dir, "documents").filter((F.col("lang") == lang) & F.col("source").isNotNull()).select("source")
    return of("de").intersect(of("fr"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM search_hits")
def corpus_never_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no search gave."""
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "search_hits").select("doc_id").distinct()).distinct()


@query()
def corpus_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts and the middle length of each file type, by sketches."""
    rows = table(spark, sf_dir, "documents").groupBy("filetype")
    return rows.agg(F.approx_count_distinct("text", 0.02).alias("texts"), F.approx_percentile("n_chars", 0.5, F.lit(10_000)).alias("middle_chars"))
