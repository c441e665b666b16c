"""Question-answering pipelines over a table of questions, and the registry of their parts."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from copy import deepcopy
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..functions.vectors import cosine, feature_hash_embedding
from ..operators import context as C
from ..operators import grounding as G

#: (query_id, query) -> (query_id, rank, content, ...)
Retriever = Callable[[DataFrame], DataFrame]
#: hits -> (query_id, context)
Formatter = Callable[[DataFrame], DataFrame]
#: (query_id, query, context, prompt) -> the same with answer
Generator = Callable[[DataFrame], DataFrame]


class PipelineError(ValueError):
    """A pipeline that can't be built or asked as it was."""


@dataclass(frozen=True)
class Pipeline:
    """retrieve, format, prompt, generate, verify: one plan for a whole table of questions."""

    retriever: Retriever
    formatter: Formatter = C.simple_context
    generator: Generator = C.extractive_answer
    template: str = C.PROMPT
    embed: Callable[[Column], Column] | None = feature_hash_embedding
    grounding: G.Grounding = field(default_factory=G.Grounding)

    @staticmethod
    def standard(retriever: Retriever) -> Pipeline:
        return Pipeline(retriever)

    def answer(self, questions: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """questions (query_id, query) with context, prompt, answer and the columns of grounding.post_process.

        Blank questions give no rows; a question without hits has an empty context. history (query_id, history) is optional.
        """
        asked = questions.filter(~is_blank(F.col("query"))).select("query_id", "query")
        rows = asked.join(self.formatter(self.retriever(asked)), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
        rows = rows.join(history.select("query_id", "history"), "query_id", "left") if history is not None else rows.withColumn("history", F.lit(""))
        rows = rows.withColumn("prompt", C.fill_template(self.template, context=F.col("context"), history=F.col("history"), query=F.col("query")))
        answered = self.generator(rows)
        if not self.embed:
            return G.post_process(answered, self.grounding)
        answered = answered.withColumns({"_answer": self.embed(F.col("answer")), "_context": self.embed(F.col("context"))})
        return G.post_process(answered, self.grounding, cosine(F.col("_answer"), F.col("_context"))).drop("_answer", "_context")

    def converse(self, questions: DataFrame, turns: DataFrame, history_size: int = 3) -> tuple[DataFrame, DataFrame]:
        """Questions (conv_id, query) answered with the history of their conversation, and the turns (conv_id, turn, role, text) with the
        new ones behind, cut to the last 2 * history_size. A conversation has one open question."""
        recent = C.recent_turns(turns, history_size)
        line = F.concat(F.when(F.col("role") == "human", "Human: ").otherwise("Assistant: "), F.coalesce("text", F.lit("")))
        lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
        history = recent.groupBy(F.col("conv_id").alias("query_id")).agg(F.array_join(lines, "\n").alias("history"))
        answers = self.answer(questions.withColumnRenamed("conv_id", "query_id"), history)
        last = turns.groupBy(F.col("conv_id").alias("query_id")).agg(F.max("turn").alias("last"))
        said = answers.join(last, "query_id", "left").withColumn("last", F.coalesce("last", F.lit(-1)))
        new = said.select(F.col("query_id").alias("conv_id"), F.posexplode(F.array(F.struct(F.lit("human").alias("role"), F.col("query").alias("text")), F.struct(F.lit("ai").alias("role"), F.col("answer").alias("text")))).alias("at", "said"), "last")
        new = new.select("conv_id", (F.col("last") + 1 + F.col("at")).cast("bigint").alias("turn"), "said.role", "said.text")
        return answers, C.recent_turns(turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(new), history_size)

    def rejected(self, questions: DataFrame) -> DataFrame:
        """The questions that answer leaves out, with the reason."""
        return questions.filter(is_blank(F.col("query"))).withColumn("reason", F.when(F.col("query").isNull(), "the query is null").otherwise("the query is blank"))


class Registry:
    """Named parts: a name can be taken once, and a part must be callable."""

    def __init__(self, *kinds: str):
        self.parts: dict[str, dict[str, Callable]] = {k: {} for k in kinds}

    def register(self, kind: str, name: str, part: Callable) -> None:
        if kind not in self.parts:
            raise ValueError(f"unknown kind {kind}")
        if name in self.parts[kind]:
            raise ValueError(f"{kind} {name} is registered already")
        if not callable(part):
            raise ValueError(f"{kind} {name} can't be called")
        self.parts[kind][name] = part

    def create(self, kind: str, name: str, **options: Any) -> Callable:
        """The part, with its options bound."""
        if name not in self.parts.get(kind, {}):
            raise ValueError(f"unknown {kind} {name}")
        part = self.parts[kind][name]
        return (lambda df: part(df, **options)) if options else part

    def names(self, kind: str) -> list[str]:
        return sorted(self.parts.get(kind, {}))


COMPONENTS = Registry("retriever", "formatter", "generator")
COMPONENTS.register("formatter", "simple", C.simple_context)
COMPONENTS.register("formatter", "markdown", C.markdown_context)
COMPONENTS.register("generator", "extractive", C.extractive_answer)


class PipelineBuilder:
    """Builds a pipeline part by part; each with_ method gives a new builder."""

    def __init__(self, parts: Mapping[str, Any] | None = None):
        self._parts = dict(parts or {})

    def _with(self, **more: Any) -> PipelineBuilder:
        return PipelineBuilder(self._parts | more)

    def with_retriever(self, retriever: Retriever | str, **options: Any) -> PipelineBuilder:
        return self._with(retriever=COMPONENTS.create("retriever", retriever, **options) if isinstance(retriever, str) else retriever)

    def with_formatter(self, formatter: Formatter | str, **options: Any) -> PipelineBuilder:
        return self._with(formatter=COMPONENTS.create("formatter", formatter, **options) if isinstance(formatter, str) else formatter)

    def with_generator(self, generator: Generator | str, **options: Any) -> PipelineBuilder:
        return self._with(generator=COMPONENTS.create("generator", generator, **options) if isinstance(generator, str) else generator)

    def with_template(self, template: str) -> PipelineBuilder:
        return self._with(template=template)

    def with_grounding(self, **rules: Any) -> PipelineBuilder:
        """Rules by name; a bound may be given as a mapping of what differs from its default."""
        before = self._parts.get("grounding", G.Grounding())
        return self._with(grounding=replace(before, **{k: replace(getattr(before, k), **v) if isinstance(v, Mapping) else v for k, v in rules.items()}))

    def build(self) -> Pipeline:
        if "retriever" not in self._parts:
            raise PipelineError("a pipeline needs a retriever")
        return Pipeline(**self._parts)


def create_pipeline(config: Mapping[str, Any]) -> Pipeline:
    """A pipeline from a configuration: retriever, formatter, generator (a name or a callable), template, grounding."""
    rest = dict(config)
    builder = PipelineBuilder()
    for kind in ("retriever", "formatter", "generator"):
        if kind in rest:
            builder = getattr(builder, f"with_{kind}")(rest.pop(kind))
    if "template" in rest:
        builder = builder.with_template(rest.pop("template"))
    builder = builder.with_grounding(**rest.pop("grounding", {}))
    if rest:
        raise PipelineError(f"unknown settings: {', '.join(sorted(rest))}")
    return builder.build()


def merge_settings(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """Nested settings, later layers over earlier ones."""
    out: dict[str, Any] = {}
    for layer in layers:
        for key, value in layer.items():
            out[key] = merge_settings(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else deepcopy(value)
    return out


def _read_settings(file: str) -> Mapping[str, Any]:
    text = Path(file).read_text()
    if Path(file).suffix.lower() in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise PipelineError("reading YAML needs pyyaml") from e
        return yaml.safe_load(text) or {}
    return json.loads(text)


def check_settings(settings: Mapping[str, Any], kinds: Mapping[str, Any], path: str = "") -> None:
    """Raise an error that names every setting that is unknown or of another kind; kinds nests types, or tuples of allowed values."""
    wrong = []

    def visit(node: Mapping[str, Any], known: Mapping[str, Any], at: str) -> None:
        for key, value in node.items():
            name, kind = f"{at}{key}", known.get(key)
            if kind is None:
                wrong.append(f"{name} is unknown")
            elif isinstance(kind, Mapping):
                visit(value, kind, f"{name}.") if isinstance(value, Mapping) else wrong.append(f"{name} must have settings of its own")
            elif isinstance(kind, tuple):
                wrong.extend([] if value in kind else [f"{name} must be one of {', '.join(map(str, kind))}"])
            elif not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
                wrong.append(f"{name} must be {kind.__name__}")

    visit(settings, kinds, path)
    if wrong:
        raise PipelineError("; ".join(wrong))


def load_settings(defaults: Mapping[str, Any], *files: str, prefix: str = "LEXARIUM_", environ: Mapping[str, str] | None = None, kinds: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Defaults, then JSON or YAML files in order, then environment variables with the prefix, whose `__` nests; held against kinds if given.

    Values of the environment are strings; with kinds they take the kind of the default they replace.
    """
    layers: list[Mapping[str, Any]] = [defaults]
    layers += [_read_settings(f) for f in files]
    for key, value in sorted((environ if environ is not None else os.environ).items()):
        if key.startswith(prefix):
            parts = key[len(prefix) :].lower().split("__")
            before: Any = defaults
            for part in parts:
                before = before.get(part) if isinstance(before, Mapping) else None
            node: Any = value if kinds is None else value.lower() in ("1", "true", "yes") if isinstance(before, bool) else type(before)(value) if isinstance(before, (int, float)) else value
            for part in reversed(parts):
                node = {part: node}
            layers.append(node)
    merged = merge_settings(*layers)
    if kinds is not None:
        check_settings(merged, kinds)
    return merged


def register_functions(spark: SparkSession) -> list[str]:
    """Make the Python functions and the table function of chunks known to SQL; gives their names."""
    from pyspark.sql.functions import udtf

    from ..operators import chunking, compare, evaluation

    @udtf(returnType="chunk_index int, chunk_count int, content string")
    class TextChunks:
        """The chunks of a text: SELECT * FROM text_chunks('...', 1000, 200)."""

        def eval(self, text: str, size: int, overlap: int):  # noqa: ANN202, A003
            found = chunking.split_text(text, size, overlap)
            for k, chunk in enumerate(found):
                yield k, len(found), chunk

    functions = {"unified_diff": compare.unified_diff, "inline_diff": compare.inline_diff, "wrapped_text": compare.wrapped, "ratio_error": evaluation.ratio_error, "ratio_word_error": evaluation.ratio_word_error}
    for name, function in functions.items():
        spark.udf.register(name, function)
    spark.udtf.register("text_chunks", TextChunks)
    return [*functions, "text_chunks"]
