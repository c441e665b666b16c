"""Document comparison: alignment of section rows, classes, and diffs.

Pairs of documents come as (pair_id, source_doc, target_doc); sections as (pair_id, section_idx, section_type, title, content),
one frame for each side.
"""

from __future__ import annotations

import difflib
import html
import textwrap
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import escape_html, jaccard, strip, tokens
from ..functions.vectors import cosine, feature_hash_embedding
from .filters import too_short

ALIGNED = "pair_id bigint, pair_idx int, source_idx int, target_idx int, similarity double, method string"
GAP, MATCH_LEAST = -0.5, 0.7


def match_key(sections: DataFrame) -> Column:
    """What a heading is matched by: its stripped content, or its title where that is empty."""
    return F.coalesce(F.when(strip(F.col("content")) != "", strip(F.col("content"))), F.when(strip(F.col("title")) != "", strip(F.col("title"))))


def with_segments(sections: DataFrame) -> DataFrame:
    """sections with segment: the number of headings up to the row, so that text before the first heading has 0."""
    order = Window.partitionBy("pair_id").orderBy("section_idx")
    return sections.withColumn("segment", F.sum(F.when(F.col("section_type") == "HEADING", 1).otherwise(0)).over(order))


def with_heading(sections: DataFrame) -> DataFrame:
    """sections with heading_idx: the last heading at or before the row, null before the first."""
    order = Window.partitionBy("pair_id").orderBy("section_idx")
    return sections.withColumn("heading_idx", F.last(F.when(F.col("section_type") == "HEADING", F.col("section_idx")), ignorenulls=True).over(order))


def match_headings(source: DataFrame, target: DataFrame) -> DataFrame:
    """(pair_id, source_idx, target_idx): each source heading with the first target heading of the same text, null if none."""
    s = source.filter("section_type = 'HEADING'").select("pair_id", match_key(source).alias("key"), F.col("section_idx").alias("source_idx"))
    t = target.filter("section_type = 'HEADING'").select("pair_id", match_key(target).alias("key"), "section_idx").filter(F.col("key").isNotNull()).groupBy("pair_id", "key").agg(F.min("section_idx").alias("target_idx"))
    return s.join(t, ["pair_id", "key"], "left").select("pair_id", "source_idx", "target_idx")


def pair_by_position(source: DataFrame, target: DataFrame) -> DataFrame:
    """(pair_id, segment, place, source_idx, target_idx): the rows of equal segments by position, the longer side one-sided."""
    order = Window.partitionBy("pair_id", "segment").orderBy("section_idx")
    s = with_segments(source).withColumn("place", F.row_number().over(order)).select("pair_id", "segment", "place", F.col("section_idx").alias("source_idx"))
    t = with_segments(target).withColumn("place", F.row_number().over(order)).select("pair_id", "segment", "place", F.col("section_idx").alias("target_idx"))
    return s.join(t, ["pair_id", "segment", "place"], "full")


def similarity_matrix(source: DataFrame, target: DataFrame) -> DataFrame:
    """(pair_id, source_idx, target_idx, similarity): the token similarity of all sections within each pair of documents."""
    s = source.select("pair_id", F.col("section_idx").alias("source_idx"), tokens(F.col("content")).alias("a"))
    t = target.select("pair_id", F.col("section_idx").alias("target_idx"), tokens(F.col("content")).alias("b"))
    return s.join(t, "pair_id").select("pair_id", "source_idx", "target_idx", F.round(jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


def _token_sets(frame: pd.DataFrame) -> list[set[str]]:
    return [set((c or "").lower().split()) for c in frame["content"]]


def _matrix(a: list[set[str]], b: list[set[str]]) -> np.ndarray:
    return np.array([[len(x & y) / len(x | y) if x and y else 0.0 for y in b] for x in a]).reshape(len(a), len(b))


def sequence_path(sim: np.ndarray) -> list[tuple[int | None, int | None]]:
    """The global alignment of most similarity less GAP for each gap; a match is preferred over a source gap, that over a target gap."""
    n, m = sim.shape
    score = np.zeros((n + 1, m + 1))
    score[:, 0], score[0, :] = GAP * np.arange(n + 1), GAP * np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            score[i, j] = max(score[i - 1, j - 1] + sim[i - 1, j - 1], score[i - 1, j] + GAP, score[i, j - 1] + GAP)
    path: list[tuple[int | None, int | None]] = []
    i, j = n, m
    while i or j:
        if i and j and score[i, j] == score[i - 1, j - 1] + sim[i - 1, j - 1]:
            i, j = i - 1, j - 1
            path.append((i, j))
        elif i and score[i, j] == score[i - 1, j] + GAP:
            i -= 1
            path.append((i, None))
        else:
            j -= 1
            path.append((None, j))
    return path[::-1]


def best_path(sim: np.ndarray) -> list[tuple[int | None, int | None]]:
    """Pairs of at least MATCH_LEAST taken from the most similar on while both are free, then what is left of either side."""
    order = sorted((-sim[i, j], i, j) for i in range(sim.shape[0]) for j in range(sim.shape[1]) if sim[i, j] >= MATCH_LEAST)
    a: dict[int, int] = {}
    b: set[int] = set()
    for _, i, j in order:
        if i not in a and j not in b:
            a[i] = j
            b.add(j)
    return [(i, a.get(i)) for i in range(sim.shape[0])] + [(None, j) for j in range(sim.shape[1]) if j not in b]


def _align(source: DataFrame, target: DataFrame, keys: list[str], method: str, path: object) -> DataFrame:
    """Align each group of keys by itself; groups are the sections of one pair of documents, bounded by a document."""

    def work(s: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        s, t = s.sort_values("section_idx"), t.sort_values("section_idx")
        sim = _matrix(_token_sets(s), _token_sets(t))
        pair = (s if len(s) else t)["pair_id"].iloc[0]
        si, ti = s["section_idx"].tolist(), t["section_idx"].tolist()
        rows = [(pair, k, None if i is None else si[i], None if j is None else ti[j], 0.0 if i is None or j is None else round(float(sim[i, j]), 6), method) for k, (i, j) in enumerate(path(sim))]
        out = pd.DataFrame(rows, columns=["pair_id", "pair_idx", "source_idx", "target_idx", "similarity", "method"])
        return out.astype({"source_idx": "Int32", "target_idx": "Int32"})

    names = ["pair_id", "section_idx", "content", *(k for k in keys if k != "pair_id")]
    a, b = (side.select(*names).toDF(*names) for side in (source, target))  # new attributes: both sides may stem from one table
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(work, ALIGNED)


def align_sequence(source: DataFrame, target: DataFrame) -> DataFrame:
    """Needleman-Wunsch over the section similarities of each pair."""
    return _align(source, target, ["pair_id"], "SEQUENCE", sequence_path)


def align_best(source: DataFrame, target: DataFrame) -> DataFrame:
    """Greedy best matches of each pair."""
    return _align(source, target, ["pair_id"], "SIMILARITY", best_path)


def align_hybrid(source: DataFrame, target: DataFrame) -> DataFrame:
    """Segments under headings of the same text aligned in sequence; the rest one-sided. pair_idx counts within a segment."""

    def keyed(sections: DataFrame) -> DataFrame:
        rows = with_segments(sections)
        heads = rows.filter("section_type = 'HEADING'").select("pair_id", "segment", match_key(rows).alias("key"))
        first = heads.withColumn("_n", F.row_number().over(Window.partitionBy("pair_id", "key").orderBy("segment")))
        return rows.join(first, ["pair_id", "segment"], "left").withColumn("key", F.concat_ws("#", F.coalesce("key", F.lit("")), F.coalesce(F.col("_n"), F.lit(0)).cast("string"))).drop("_n", "segment")

    return _align(keyed(source), keyed(target), ["pair_id", "key"], "HYBRID", sequence_path)


def classify(similarity: Column, similar: float = 0.95, modified: float = 0.8) -> Column:
    """SIMILAR, MODIFIED or DIFFERENT."""
    return F.when(similarity >= similar, "SIMILAR").when(similarity >= modified, "MODIFIED").otherwise("DIFFERENT")


def compare_pairs(pairs: DataFrame, similar: float = 0.95, modified: float = 0.8) -> DataFrame:
    """Aligned pairs (source_idx, target_idx, similarity) with result_type: DELETED, NEW or their class."""
    return pairs.withColumn("result_type", F.when(F.col("target_idx").isNull(), "DELETED").when(F.col("source_idx").isNull(), "NEW").otherwise(classify(F.coalesce("similarity", F.lit(0.0)), similar, modified)))


RESULTS = ("SIMILAR", "MODIFIED", "DIFFERENT", "NEW", "DELETED")


def diff_summary(compared: DataFrame) -> DataFrame:
    """How many results of each type a pair of documents has."""
    return compared.groupBy("pair_id").pivot("result_type", list(RESULTS)).agg(F.count(F.lit(1))).na.fill(0, list(RESULTS))


def with_cosine(pairs: DataFrame, embed: Callable[[Column], Column] = feature_hash_embedding, source: str = "source_text", target: str = "target_text") -> DataFrame:
    """pairs with similarity: the cosine of the embeddings of both texts, 0 where one has none."""
    a, b = embed(F.col(source)), embed(F.col(target))
    return pairs.withColumns({"_a": a, "_b": b}).withColumn("similarity", F.coalesce(cosine(F.col("_a"), F.col("_b")), F.lit(0.0))).drop("_a", "_b")


def analysis_request(source: Column, target: Column) -> Column:
    """What a model is asked about two versions of a section."""
    ask = f"Compare the two versions of a section and reply with JSON: comparison_category (one of {', '.join(CATEGORIES[:-1])}), explanation, confidence from 0 to 1.\n\nVersion 1:\n"
    return F.concat(F.lit(ask), F.coalesce(source, F.lit("")), F.lit("\n\nVersion 2:\n"), F.coalesce(target, F.lit("")))


def with_analysis(compared: DataFrame, model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """compared (pair_id, source_idx, target_idx, source_text, target_text, result_type) with analysis, STRUCT<category, explanation, confidence>.

    Modified and different sections with enough text on both sides are sent to the model, (request_id, prompt) to
    (request_id, reply), as one table; all others have a null analysis, a request without a reply is an LLM_ERROR.
    """
    key = F.concat_ws("/", "pair_id", "source_idx", "target_idx")
    asked = F.col("result_type").isin("MODIFIED", "DIFFERENT") & ~too_short(F.col("source_text"), F.col("target_text"))
    rows = compared.withColumn("request_id", F.when(asked, key))
    requests = rows.filter("request_id is not null").select("request_id", analysis_request(F.col("source_text"), F.col("target_text")).alias("prompt"))
    replies = model(requests).select("request_id", "reply").dropDuplicates(["request_id"])
    joined = rows.join(replies, "request_id", "left")
    return joined.withColumn("analysis", F.when(F.col("request_id").isNotNull(), parse_category(F.col("reply")))).drop("request_id", "reply")


_HEAD = {
    "markdown": ("## Summary\n\n", "- {label}: {n}", "\n\n## Details\n\n"),
    "text": ("SUMMARY\n=======\n\n", "{label}: {n}", "\n\nDETAILS\n=======\n\n"),
    "html": ("<div class='summary'>\n<h2>Summary</h2>\n<ul>\n", "<li>{label}: {n}</li>", "\n</ul>\n</div>\n<h2>Details</h2>\n"),
}
#: What the counts of a report are called.
_LABELS = {"SIMILAR": "Similar sections", "MODIFIED": "Modified sections", "DIFFERENT": "Different sections", "NEW": "New", "DELETED": "Deleted"}


def _lines(*parts: Column | str | tuple) -> Column:
    """Lines below each other; a (condition, lines) pair only where the condition holds."""
    out = [F.when(p[0], _lines(*p[1:])) if isinstance(p, tuple) else F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("\n", *out)


def _two(x: Column) -> Column:
    return F.format_string("%.2f", F.bround(x, 2))


def _section(style: str, detailed: bool, analysed: bool) -> Column:
    """One result (no, result_type, similarity, source_text, target_text, analysis) as it reads in a report."""
    kind, no, near = F.col("result_type"), F.col("no").cast("string"), F.coalesce("similarity", F.lit(0.0))
    src, tgt = (F.coalesce(c, F.lit("")) for c in ("source_text", "target_text"))
    one, two = F.when(kind == "NEW", tgt).otherwise(src), kind.isin("MODIFIED", "DIFFERENT")
    name = F.concat(F.lit("Section "), no, F.lit(": "), kind)
    found = F.col("analysis") if analysed else F.lit(None).cast("struct<category:string,explanation:string,confidence:double>")
    category, why, sure = found["category"], found["explanation"], found["confidence"]
    if style == "markdown":
        def fenced(x: Column) -> Column:
            return _lines("```", x, "```")

        explained = F.array_join(F.transform(F.split(why, "\n"), lambda x: F.concat(F.lit("  _Explanation: "), x, F.lit("_"))), "\n")
        return _lines(
            F.concat(F.lit("### "), name), "",
            (near > 0, F.concat(F.lit("*Similarity: "), _two(near), F.lit("*")), ""),
            (category.isNotNull(), F.concat(F.lit("**LLM Analysis:** "), category), (F.coalesce(why, F.lit("")) != "", explained), (sure.isNotNull(), F.concat(F.lit("  _Confidence: "), _two(sure), F.lit("_"))), ""),
            F.concat(F.lit("**["), kind, F.lit("]**")), "",
            (~two, fenced(one)),
            (two, "Source:", fenced(src), "Target:", fenced(tgt), *(["Diff:", "```diff", unified_diff(src, tgt), "```"] if detailed else [])),
            "", "---", "",
        )
    if style == "text":
        return _lines(
            name, F.repeat(F.lit("-"), F.length(name)), "",
            (near > 0, F.concat(F.lit("Similarity: "), _two(near)), ""),
            (category.isNotNull(), F.concat(F.lit("LLM Analysis: "), category), (F.coalesce(why, F.lit("")) != "", F.concat(F.lit("Explanation: "), why)), (sure.isNotNull(), F.concat(F.lit("Confidence: "), _two(sure))), ""),
            F.concat(F.lit("["), kind, F.lit("]")), "",
            (~two, wrapped(one)),
            (two, "Source:", wrapped(src), "", "Target:", wrapped(tgt), *(["", "Diff:", unified_diff(src, tgt)] if detailed else [])),
            "", "=" * 80, "",
        )
    def boxed(x: Column) -> Column:
        return _lines("<div class='content'>", escape_html(x), "</div>")

    def note(label: str, x: Column) -> Column:
        return F.concat(F.lit(f"<div class='similarity'>{label}: "), x, F.lit("</div>"))

    return _lines(
        F.concat(F.lit("<div class='section "), F.lower(kind), F.lit("'>")), F.concat(F.lit("<div class='header'>"), name, F.lit("</div>")),
        (near > 0, note("Similarity", _two(near))),
        (category.isNotNull(), note("LLM Analysis", category), (F.coalesce(why, F.lit("")) != "", note("Explanation", escape_html(why))), (sure.isNotNull(), note("Confidence", _two(sure)))),
        (~two, boxed(one)),
        (two, "<div class='source'>", "<strong>Source:</strong>", boxed(src), "</div>", "<div class='target'>", "<strong>Target:</strong>", boxed(tgt), "</div>", *(["<div class='diff'>", "<strong>Diff:</strong>", inline_diff(src, tgt), "</div>"] if detailed else [])),
        "</div>",
    )


def diff_report(compared: DataFrame, show_similar: bool = True, style: str = "markdown", title: str | None = None, detailed: bool = False) -> DataFrame:
    """(pair_id, report): counts of all results and every section with its texts and score, by position, as Markdown, HTML or text.

    compared: pair_id, source_idx, target_idx, result_type, similarity, source_text, target_text and, optionally, analysis.
    Similar sections may be left out of the details; the numbers of the others stay. detailed adds a diff of changed
    texts. Null texts are empty.
    """
    if style not in _HEAD:
        raise ValueError(f"unknown format {style}")
    before, entry, between = _HEAD[style]
    at = F.coalesce("source_idx", "target_idx")
    rows = compared.withColumn("no", F.row_number().over(Window.partitionBy("pair_id").orderBy(at, F.col("source_idx").isNull(), "target_idx")))
    text = F.when((F.col("result_type") != "SIMILAR") | F.lit(show_similar), _section(style, detailed, "analysis" in compared.columns))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("no", F.col("text").alias("text")))), lambda x: x["text"])
    joined = rows.withColumn("text", text).groupBy("pair_id").agg(F.array_join(F.filter(ordered, lambda x: x.isNotNull()), "\n").alias("details"), *(F.count_if(F.col("result_type") == k).alias(k) for k in RESULTS))
    left, right = entry.split("{n}")
    counts = F.concat_ws("\n", *(F.concat(F.lit(left.format(label=_LABELS[k])), F.col(k).cast("string"), F.lit(right)) for k in RESULTS))
    if style == "html":
        name = html.escape(title or "Document Comparison")
        start, end = f"<!DOCTYPE html>\n<html>\n<head>\n<meta charset='utf-8'>\n<title>{name}</title>\n</head>\n<body>\n<h1>{name}</h1>\n", "\n</body>\n</html>"
    else:
        start, end = "" if not title else f"# {title}\n\n" if style == "markdown" else f"{title.upper()}\n{'=' * len(title)}\n\n", ""
    return joined.select("pair_id", F.concat(F.lit(start + before), counts, F.lit(between), F.col("details"), F.lit(end)).alias("report"))


CATEGORIES = ("SEMANTIC_REWRITE", "MEANING_CHANGE", "STRUCTURAL_CHANGE", "EXPANSION", "REDUCTION", "NO_MEANINGFUL_CONTENT", "UNCERTAIN", "LLM_ERROR")


def parse_category(reply: Column) -> Column:
    """A model's reply as STRUCT<category, explanation, confidence>: code fences off, a category that isn't known or a confidence beyond [0, 1] is LLM_ERROR."""
    bare = F.regexp_replace(F.coalesce(reply, F.lit("")), r"^[ \t\n\r\f]*```(?:json)?[ \t\n\r\f]*|[ \t\n\r\f]*```[ \t\n\r\f]*$", "")
    parsed = F.from_json(bare, "comparison_category string, explanation string, confidence double")
    category = F.upper(parsed["comparison_category"])
    good = category.isin(*CATEGORIES) & parsed["confidence"].between(0, 1)
    return F.when(good, F.struct(category.alias("category"), parsed["explanation"].alias("explanation"), parsed["confidence"].alias("confidence"))).otherwise(F.struct(F.lit("LLM_ERROR").alias("category"), F.lit(None).cast("string").alias("explanation"), F.lit(0.0).alias("confidence")))


@F.pandas_udf(StringType())
def unified_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """The unified diff of two texts with three lines of context."""
    return pd.Series(["\n".join(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "source", "target", lineterm="", n=3)) for x, y in zip(a, b)])


@F.pandas_udf(StringType())
def inline_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """The words of two texts as HTML, taken out and put in."""

    def one(x: str, y: str) -> str:
        u, v = x.split(), y.split()
        out = []
        for op, i, j, k, n in difflib.SequenceMatcher(None, u, v, autojunk=False).get_opcodes():
            if op == "equal":
                out.append(html.escape(" ".join(u[i:j])))
            else:
                out += [f"<del>{html.escape(' '.join(u[i:j]))}</del>"] * (i < j) + [f"<ins>{html.escape(' '.join(v[k:n]))}</ins>"] * (k < n)
        return " ".join(out)

    return pd.Series([one(x or "", y or "") for x, y in zip(a, b)])


@F.pandas_udf(StringType())
def wrapped(text: pd.Series) -> pd.Series:
    """A text in lines of at most 100 characters, its own line ends kept."""
    return text.map(lambda t: None if t is None else "\n".join(x for line in t.split("\n") for x in (textwrap.wrap(line, 100) or [""])))


def consecutive_revisions(parsed: DataFrame) -> DataFrame:
    """(pair_id, source_doc, target_doc): each revision of a file with the next one; pair_id is the later document."""
    order = Window.partitionBy("doc_number").orderBy("revision", "doc_id")
    rows = parsed.filter(F.col("doc_number").isNotNull()).dropDuplicates(["doc_id"]).withColumn("source_doc", F.lag("doc_id").over(order)).filter(F.col("source_doc").isNotNull())
    return rows.select(F.col("doc_id").alias("pair_id"), "source_doc", F.col("doc_id").alias("target_doc"))


def side(pairs: DataFrame, sections: DataFrame, doc: str) -> DataFrame:
    """The sections of one side of the pairs, repeated rows once, kinds in capitals."""
    rows = sections.dropDuplicates(["section_id"]).select(F.col("doc_id").alias(doc), "section_idx", F.upper("section_type").alias("section_type"), "title", "content")
    return pairs.select("pair_id", doc).join(rows, doc).drop(doc)

