"""Structured Streaming: cleaning queues, deduplication with watermarks, event windows and conversation state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """Parquet files of a directory as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(path)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what there is now into a Parquet sink and give the sink's rows."""
    spark = stream.sparkSession
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def clean_stream(pages: DataFrame, clean: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """A cleaning queue: each micro-batch is cleaned and appended; a batch that is run again replaces itself."""

    def each(batch: DataFrame, no: int) -> None:
        clean(batch).write.mode("overwrite").parquet(f"{path}/batch={no}")

    pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_seen(stream: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """The first row of each key within the watermark, so that the state stays bounded."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def tumbling_counts(stream: DataFrame, time: str, width: str, lateness: str, *keys: str) -> DataFrame:
    """Rows counted by window and keys; later rows than the watermark are left out."""
    rows = stream.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), *keys, "n")


def sliding_counts(stream: DataFrame, time: str, width: str, slide: str, lateness: str, *keys: str) -> DataFrame:
    """Rows counted by windows of a width that begin every `slide`, and keys; a row counts in each window it falls into."""
    rows = stream.withWatermark(time, lateness).groupBy(F.window(time, width, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(stream: DataFrame, key: str, time: str, gap: str, lateness: str) -> DataFrame:
    """Rows counted by key and session."""
    rows = stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


class RecentTurns(StatefulProcessor):
    """Keeps the last messages of each conversation and gives the history with each new one."""

    def __init__(self, history_size: int = 3):
        self.limit = 2 * history_size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "line string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [r[0] for r in self.turns.get()] if self.turns.exists() else []
        out = []
        frame = pd.concat(list(rows)).sort_values("turn")
        for turn, role, text in zip(frame["turn"], frame["role"], frame["text"]):
            out.append((key[0], turn, "\n".join(held)))
            held = [*held, f"{'Human' if role == 'human' else 'Assistant'}: {text or ''}"][-self.limit :]
        self.turns.put([(x,) for x in held])
        yield pd.DataFrame(out, columns=["conv_id", "turn", "history"])

    def close(self) -> None:
        pass


def conversation_history(turns: DataFrame, history_size: int = 3) -> DataFrame:
    """turns (conv_id, turn, role, text) with the history before each, from keyed state."""
    return turns.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=RecentTurns(history_size), outputStructType="conv_id bigint, turn bigint, history string", outputMode="Append", timeMode="None")
