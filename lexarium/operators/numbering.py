"""Numbering rows in a total order without bringing them together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def number_rows(rows: DataFrame, *order: str, name: str = "row_no") -> DataFrame:
    """rows numbered from 1 in a total order, without bringing them into one partition.

    Rows are sorted by range and written to the checkpoint folder, so that the numbers are counted on the very
    partitions they are given in; only one count for each partition is gathered.
    """
    shared_folder(rows.sparkSession)
    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    within = parted.withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = parted.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return within.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
