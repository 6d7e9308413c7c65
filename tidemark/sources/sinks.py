"""Sinks: partitioned history, CSV, ticker lists, metadata."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.metrics import summary
from tidemark.sources.versions import laid_out


def write_history(df: DataFrame, path: str, key: str = "ticker") -> None:
    """Rows in plain Parquet, a folder for each date, for readers that know no versions; within a date by ranges of ``key``, see ``versions.laid_out``.
    Only dates in ``df`` are replaced, one after the other. ``df`` must not be read from ``path``; see plans.history for updates.
    """
    laid_out(df, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def write_csv(df: DataFrame, path: str, order: Sequence[Column | str] = (), one: bool = False) -> None:
    """CSV with header. With an ``order`` the parts, by name, are the rows in that order; ``one`` makes them one file, as for a download, which one task
    writes from the parts that others have sorted."""
    rows = df.orderBy(*order) if order else df
    (rows.coalesce(1) if one else rows).write.mode("overwrite").option("header", True).csv(path)


def write_lists(lists: DataFrame, path: str) -> None:
    """A text for each row of (file_name, tickers), in a folder of its name."""
    lists.select("file_name", "tickers").write.mode("overwrite").partitionBy("file_name").text(path)


def metadata(df: DataFrame, key: str, **more: int | str) -> DataFrame:
    """The one-row description of a history as JSON text, with the time it was made."""
    row = summary(df, key).withColumn("last_updated", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    return row.withColumns({k: F.lit(v) for k, v in more.items()}).select(F.to_json(F.struct("*")).alias("value"))


def write_metadata(df: DataFrame, path: str, key: str, **more: int | str) -> dict:
    """Writes it as one text file, and returns it."""
    metadata(df, key, **more).coalesce(1).write.mode("overwrite").text(path)
    return read_metadata(df.sparkSession, path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
