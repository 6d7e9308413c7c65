"""Appends to a history as streams: of landed Parquet or CSV files, and of a repository's commits (ST1-ST6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import coerced, day
from tidemark.functions.schema import STOCK_NAMES
from tidemark.plans import history
from tidemark.sources import commits, versions
from tidemark.sources.files import accepted, records, rejected


def landed(spark: SparkSession, folder: str, schema: T.StructType, names: dict[str, str]) -> DataFrame:
    """The files that land in ``folder`` as Parquet, as a stream; ``schema`` is that of the files."""
    raw = spark.readStream.schema(schema).parquet(folder)
    df = coerced(raw.withColumnsRenamed(names))
    return df.withColumn("date", day(F.col("date"))) if "date" in df.columns else df


def landed_csv(spark: SparkSession, folder: str, date: Column | None = None, **options: str) -> DataFrame:
    """S05, T6, ST1: the CSV files that land in ``folder``, as a stream of whole texts (source_file, content) that ``run_csv`` reads; files of any header share
    one stream and one checkpoint. ``date``, of source_file, gives the date of files without a column of that name."""
    raw = spark.readStream.format("text").options(wholetext="true", **options).load(folder)
    texts = raw.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("content"))
    return texts if date is None else texts.withColumn("date", date)


def _started(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool, every: str):
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def _appended(rows: DataFrame, path: str, key: str, lateness: int) -> None:
    """One batch joins the history, which it begins if there is none."""
    spark = rows.sparkSession
    if history.append(spark, path, rows, key, lateness).state == "missing" and not rows.isEmpty():
        history.replace_dates(spark, path, history.build([rows], key), key)


def run(stream: DataFrame, path: str, checkpoint: str, key: str, once: bool = True, every: str = "30 minutes", lateness: int = 0):
    """Append what has landed: all of it now (``once``, for a scheduler), or again and again.

    The checkpoint's offsets say what is new (T26). A batch is one change of the history, so one that failed has changed nothing and may be run
    again. Histories that do not exist yet are begun by the first batch.
    """

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.persist()
        try:
            _appended(rows, path, key, lateness)
        finally:
            rows.unpersist()

    return _started(stream, batch, checkpoint, once, every)


def _read_batch(found: DataFrame, places: list[str], unused: str, path: str, rejects: str | None, key: str, lateness: int, number: int) -> None:
    """The records of a batch, read in one pass: those that can be read join the history, the others are written to ``rejects``, each batch in a folder of its own that
    a repeated batch replaces."""
    found = found.persist()
    try:
        if rejects:
            rejected(found, *places).write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        _appended(accepted(found).drop(unused), path, key, lateness)
    finally:
        found.unpersist()


def run_csv(stream: DataFrame, path: str, checkpoint: str, key: str, names: dict[str, str] = STOCK_NAMES, rejects: str | None = None, once: bool = True, every: str = "30 minutes", lateness: int = 0, **how):
    """S05, T6, T25, ST1-ST5: append the CSV files that have landed (``landed_csv``), each read by its own header. The history is that of ``read_all`` and ``build``;
    records that cannot be read are written to ``rejects`` with their file, line and reason."""

    def batch(texts: DataFrame, number: int) -> None:
        _read_batch(records(texts, names, **how), ["source_file"], "line", path, rejects, key, lateness, number)

    return _started(stream, batch, checkpoint, once, every)


def run_commits(
    stream: DataFrame, repo: str, path: str, checkpoint: str, key: str, names: dict[str, str] = STOCK_NAMES, rejects: str | None = None, once: bool = True, every: str = "30 minutes", lateness: int = 0, program: str = "git"
):
    """ST1-ST6: append the snapshots of a repository's new commits (``commits.stream``) as they come. Files of commits that the history's newest date
    leaves out are not read; unreadable records are written to ``rejects``."""

    def batch(found: DataFrame, number: int) -> None:
        spark = found.sparkSession
        found = found.persist()
        try:
            base = versions.version(spark, path)
            cutoff = history.cutoff_of(base, lateness) if base else None
            wanted = found.where(F.col("date") > F.lit(cutoff)) if cutoff else found
            if not wanted.isEmpty():
                rows = history.from_index(wanted, repo, names, program=program)
                _read_batch(rows, ["commit_hash", "date", "file"], "file", path, rejects, key, lateness, number)
        finally:
            found.unpersist()

    return _started(stream, batch, checkpoint, once, every)


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Beyond the reference: rows and mean value for each day and type of an event stream, late rows dropped after ``delay``."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
