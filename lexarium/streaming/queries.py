"""Streaming queries: each reads a table as a stream to its end and gives what its sink holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import error_rate, strip
from ..plans.registry import query
from ..session import shared_folder
from . import streams


def _work(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return streams.read_stream(spark, path, schema)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by minute windows in a stream, added up by type.

    The watermark spans the table's times, so no row is late; rows of a later time behind the events close their windows.
    """
    work = _work(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.write.parquet(f"{work}/in")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    days = (last - first).days + 1 if first else 1
    counts = streams.tumbling_counts(streams.read_stream(spark, f"{work}/in", events.schema), "ts", "1 minute", f"{days} days", "event_type")
    done = streams.run_to_end(counts, f"{work}/out", f"{work}/state")
    for later in (days + 1, days + 2):  # the first moves the watermark, the second lets a batch give what it closed
        events.agg(F.max("ts").alias("ts")).filter("ts is not null").select((F.col("ts") + F.expr(f"interval {later} days")).alias("ts"), F.lit("end").alias("event_type")).write.mode("append").parquet(f"{work}/in")
        done = streams.run_to_end(counts, f"{work}/out", f"{work}/state")
    real = done.filter(F.col("window_start") <= F.lit(last)) if last else done
    return real.groupBy("event_type").agg(F.sum("n").alias("n"))


@query("SELECT DISTINCT hit_id, query_id, doc_id FROM search_hits")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits logged twice, given once in a stream; none is late, for the watermark spans all arrival times of the table."""
    work = _work(spark)
    first, last = spark.read.parquet(f"{sf_dir}/search_hits.parquet").agg(F.min("arrived_at"), F.max("arrived_at")).first()
    span = f"{(last - first).days + 1 if first else 1} days"
    return streams.run_to_end(streams.first_seen(_source(spark, sf_dir, "search_hits"), ["hit_id"], "arrived_at", span).select("hit_id", "query_id", "doc_id"), f"{work}/out", f"{work}/state")


@query("SELECT block_key, regexp_replace(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'), '^ | $', '', 'g') AS cleaned FROM text_blocks WHERE text IS NOT NULL")
def stream_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cleaning queue over the blocks, batch by batch."""
    work = _work(spark)
    blocks = _source(spark, sf_dir, "text_blocks").filter(F.col("text").isNotNull())
    streams.clean_stream(blocks, lambda b: b.select("block_key", strip(F.regexp_replace("text", "[ \t\n\r\f]+", " ")).alias("cleaned"), error_rate(F.col("text")).alias("rate")), f"{work}/out", f"{work}/state")
    return spark.read.parquet(f"{work}/out").select("block_key", "cleaned")


@query(
    """SELECT user_id AS conv_id, event_id AS turn, coalesce(string_agg(CASE WHEN event_id % 2 = 0 THEN 'Human: ' ELSE 'Assistant: ' END || event_type, chr(10)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS history FROM events"""
)
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation histories from keyed state; the same as the batch query."""
    work = _work(spark)
    own = spark.newSession()  # the state store is set for this query alone
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    turns = _source(own, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.when(F.col("event_id") % 2 == 0, "human").otherwise("ai").alias("role"), F.col("event_type").alias("text"))
    streams.run_to_end(streams.conversation_history(turns), f"{work}/out", f"{work}/state")
    return spark.read.schema("conv_id bigint, turn bigint, history string").parquet(f"{work}/out")
