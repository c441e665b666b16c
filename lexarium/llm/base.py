"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is a longest run of letters and digits.
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words of a text in lower case."""
    return WORD.findall(text.lower())


def map_arrow(df: DataFrame, schema: str, work: Callable[[dict[str, list]], dict[str, list] | pa.RecordBatch]) -> DataFrame:
    """Apply work to the columns of each Arrow batch as Python lists; its result's columns become rows.

    Only the columns of df travel to Python, so callers select what they need before.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work({n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns)})
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow form of a schema in DDL."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, so that what follows doesn't compute it again and survives lost executors.

    The folder is that of spark.checkpoint.dir. Only a session with a local master, whose executors share the machine,
    gets one of its own where none is set; elsewhere that is an error.
    """
    session = df.sparkSession
    if session.sparkContext.getCheckpointDir() is None:
        shared = session.conf.get("spark.checkpoint.dir", None)
        if not shared and not session.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        session.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def spread(scan: DataFrame) -> DataFrame:
    """A table's scan, spread over the cores where its files have fewer parts than there are cores; larger tables stay as they are.

    Only for a plain scan, whose number of parts is known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if 0 < scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def records(df: DataFrame, rec_table: str, rec_id: str, text: str) -> DataFrame:
    """(rec_table, rec_id, text) of a table; whatever other columns it has, clashing names included, stay out."""
    return df.select(F.lit(rec_table).alias("rec_table"), df[rec_id].cast("bigint").alias("rec_id"), df[text].cast("string").alias("text"))
