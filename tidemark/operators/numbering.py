"""Gapless numbers over one order of all rows, by two passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.steps import cut


def numbered(df: DataFrame, order: list[Column], name: str = "row_num", first: int = 1) -> DataFrame:
    """``df`` with the number (long) of each row in ``order``, which should be total: rows equal in it are numbered as they come.

    A range shuffle deals the rows to tasks by ``order``, and each task sorts and numbers its own. One count of each task reaches the driver; the sums
    of those before it are added to a task's numbers. So no task sees more than its range, and no window goes over all rows.
    """
    spark, columns = df.sparkSession, [F.col(f"`{c}`") for c in df.columns]
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    task, own = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(rows.groupBy(task.alias("task")).count().collect())  # a row a task
    before, starts = first, []
    for part, size in sizes:
        starts.append((part, before))
        before += size
    added = spark.createDataFrame(starts, "_task int, _before long")
    return rows.join(F.broadcast(added), task == F.col("_task")).select(*columns, (own + F.col("_before")).alias(name))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file (n from 0, line), in their order, whichever tasks read them."""
    at = [F.col("file"), F.col("start"), F.col("place")]
    text = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    return numbered(text, at, "n", 0).select("n", "line")
