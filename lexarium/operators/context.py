"""Prompt contexts, templates and conversation history."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, strip, tokens, truncate
from .numbering import number_rows

PROMPT = "Answer the question using only the context.\n\nContext:\n{context}\n\nHistory:\n{history}\n\nQuestion: {query}\nAnswer:"


def _ordered(text: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))), lambda x: x["text"]), separator)


def simple_context(hits: DataFrame, max_length: int | None = None, separator: str = "\n\n", metadata: str | None = None) -> DataFrame:
    """(query_id, context): `Document i`, its metadata and content for each hit (query_id, rank, content) by rank.

    Hits without content are left out and leave a gap in the numbers. metadata names a STRING column such as "source: x".
    """
    kept = hits.filter(F.coalesce(F.col("content"), F.lit("")) != "")
    head = F.concat(F.lit("Document "), F.col("rank").cast("string"))
    if metadata:
        head = F.when(F.coalesce(strip(F.col(metadata)), F.lit("")) != "", F.concat(head, F.lit(" [Metadata: "), F.col(metadata), F.lit("]"))).otherwise(head)
    joined = kept.groupBy("query_id").agg(_ordered(F.concat(head, F.lit("\n"), F.col("content")), separator).alias("context"))
    return joined if max_length is None else joined.withColumn("context", truncate(F.col("context"), max_length, 0.9, "\n[Context truncated due to length]"))


def truncate_markdown(text: Column, limit: int) -> Column:
    """A Markdown text cut at limit characters: before its last header if that lies in the last fifth, else behind its last full stop if that lies in the last tenth."""
    head = F.substring(text, 1, limit)
    # As in a search from the end: counted from 0, and -1 where there is none.
    header = F.greatest(*(F.when(F.instr(head, m) > 0, F.length(head) - F.instr(F.reverse(head), m[::-1]) - len(m) + 1).otherwise(-1) for m in ("\n## ", "\n### ")))
    stop = F.length(head) - F.instr(F.reverse(head), ".")
    at_stop = F.when((F.instr(head, ".") > 0) & (stop > 0.9 * limit), F.substring(head, F.lit(1), stop + 1)).otherwise(head)
    cut = F.when(header > 0.8 * limit, F.substring(head, F.lit(1), header)).otherwise(at_stop)
    return F.when(F.length(text) > limit, F.concat(cut, F.lit("\n\n*[Context truncated due to length]*"))).otherwise(text)


def markdown_context(hits: DataFrame, metadata: Mapping[str, str] | None = None, max_length: int | None = None) -> DataFrame:
    """(query_id, context): each hit under a Markdown header, with the named columns as a list of metadata."""
    kept = hits.filter(F.coalesce(F.col("content"), F.lit("")) != "")
    block = F.concat(F.lit("## Document "), F.col("rank").cast("string"), F.lit("\n"))
    if metadata:
        items = [F.when(F.coalesce(strip(F.col(c)), F.lit("")) != "", F.concat(F.lit(f"- **{label}**: "), F.col(c), F.lit("\n"))).otherwise("") for label, c in metadata.items()]
        joined = F.concat(*items)
        block = F.concat(block, F.when(joined != "", F.concat(F.lit("### Metadata\n"), joined, F.lit("\n### Content\n"))).otherwise(""))
    whole = kept.groupBy("query_id").agg(_ordered(F.concat(block, F.col("content"), F.lit("\n\n")), "").alias("context"))
    return whole if max_length is None else whole.withColumn("context", truncate_markdown(F.col("context"), max_length))


def fill_template(template: str | Column, **values: Column) -> Column:
    """A template with each {name} replaced; null values become empty."""
    out = template if isinstance(template, Column) else F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def named_template(requests: DataFrame, templates: Mapping[str, str], default: str) -> DataFrame:
    """requests with the template of their template_name, or the default one; the templates are literals of the plan."""
    if default not in templates:
        raise ValueError(f"unknown template {default}")
    name = F.coalesce(F.col("template_name"), F.lit(default))
    chosen = F.lit(templates[default])
    for key, text in templates.items():
        chosen = F.when(name == key, F.lit(text)).otherwise(chosen)
    return requests.withColumn("template", chosen)


def extractive_answer(pairs: DataFrame) -> DataFrame:
    """pairs (query_id, query, context) with answer: the sentence, within a line of the context, that shares most tokens with the query, the first of equals; a stand-in for a generator."""
    asked = tokens(F.col("query"))
    scored = F.transform(F.flatten(F.transform(F.split("context", "\n"), sentences)), lambda s, i: F.struct((-F.size(F.array_intersect(tokens(s), asked))).alias("score"), i.alias("place"), s.alias("text")))
    return pairs.withColumn("answer", F.coalesce(F.array_min(scored)["text"], F.lit("")))


def reset_history(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """turns without those of the given conversations (conv_id)."""
    return turns.join(conversations.select("conv_id").distinct(), "conv_id", "left_anti")


def recent_turns(turns: DataFrame, history_size: int = 3) -> DataFrame:
    """The last 2 * history_size messages (conv_id, turn, role, text) of each conversation."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_place", F.row_number().over(last)).filter(F.col("_place") <= 2 * history_size).drop("_place")


def history_before(turns: DataFrame, history_size: int = 3) -> DataFrame:
    """turns with history: the lines of the messages before, at most 2 * history_size, as `Human: ..` and `Assistant: ..`.

    Turns are numbered over all conversations, and each line is sent to the few turns that follow it, so that no
    conversation, however long, has to be brought into one task.
    """
    line = F.concat(F.when(F.col("role") == "human", "Human: ").otherwise("Assistant: "), F.coalesce("text", F.lit("")))
    numbered = number_rows(turns, "conv_id", "turn", name="_no")
    sent = numbered.select("conv_id", line.alias("_line"), F.col("_no").alias("_from"), F.explode(F.sequence(F.lit(1), F.lit(2 * history_size))).alias("_ahead"))
    sent = sent.select("conv_id", "_from", "_line", (F.col("_from") + F.col("_ahead")).alias("_no"))
    lines = sent.groupBy("conv_id", "_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_from", "_line"))), lambda x: x["_line"]), "\n").alias("history"))
    return numbered.join(lines, ["conv_id", "_no"], "left").withColumn("history", F.coalesce("history", F.lit(""))).drop("_no")
