"""Versions of a history: changes that readers see whole or not at all, with sums by day kept beside them (S06, K01, ST5, O01, A07-A10)."""

from __future__ import annotations

import datetime as dt
import json
import os
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.files import _list, _path, delete, exists, union

# Where things lie in a history's folder: the manifests, the files of each change by date, and its sums by day.
MANIFESTS, CHANGE, SUMS = "_versions", "change", "_daily"
NULL_DATE = "__HIVE_DEFAULT_PARTITION__"


class Conflict(Exception):
    """Another writer has made the version that this one was to make."""


@dataclass(frozen=True)
class Version:
    """What a manifest says: the columns, and for each date (as text) the change whose files hold it and how many rows it has. Dates of a history from before
    there were versions belong to the change ``""``."""

    number: int
    schema: T.StructType
    dates: dict[str, tuple[str, int | None]] = field(default_factory=dict)

    def newest(self) -> dt.date | None:
        """S06, ST3: the newest date. No file of the history is opened for it."""
        return max((dt.date.fromisoformat(d) for d in self.dates if d != NULL_DATE), default=None)

    def rows(self) -> int | None:
        counts = [n for _, n in self.dates.values()]
        return None if None in counts else sum(counts)


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The versions that a history has, oldest first."""
    return sorted(int(s.getPath().getName().split(".")[0]) for s in _list(spark, f"{path}/{MANIFESTS}/[0-9]*.json"))


def version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """A version of a history, by default the newest; None if there is no history."""
    found = numbers(spark, path)
    if not found:
        plain = [s.getPath().getName().removeprefix("date=") for s in _list(spark, f"{path}/date=*")]
        return Version(0, spark.read.parquet(path).schema, {d: ("", None) for d in plain}) if plain and not number else None
    if number is not None and number not in found:
        raise ValueError(f"no version {number}: {path} has {found}")
    where = _path(spark, _manifest(path, found[-1] if number is None else number))
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        text = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    known = json.loads(text)
    return Version(known["version"], T.StructType.fromJson(known["schema"]), {d: tuple(x) for d, x in known["dates"].items()})


def _manifest(path: str, number: int) -> str:
    return f"{path}/{MANIFESTS}/{number:010d}.json"


def read(spark: SparkSession, path: str, at: Version | None = None, dates: Iterable[dt.date | None] | None = None, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame | None:
    """The rows of a version (by default the newest), all of them, or of ``dates``, or of those from ``start`` to ``end``; None if there is no history.

    Which folders are read is known from the manifest, as are the columns, so others are not even listed and no file is opened to plan a query. Files are
    never written over: a version that a query has begun with stays as it is, whatever is appended meanwhile, until it is vacuumed.
    """
    at = at or version(spark, path)
    if at is None:
        return None
    wanted = None if dates is None else {NULL_DATE if d is None else d.isoformat() for d in dates}

    def fits(day: str) -> bool:
        if wanted is not None and day not in wanted:
            return False
        return (start is None or day != NULL_DATE and day >= start.isoformat()) and (end is None or day != NULL_DATE and day <= end.isoformat())

    plain, changed = [], []
    for day, (change, _) in at.dates.items():
        if fits(day):
            (changed if change else plain).append(f"{path}/{CHANGE}={change}/date={day}" if change else f"{path}/date={day}")
    source = spark.read.schema(at.schema).option("basePath", path)
    frames = [source.parquet(*x).drop(CHANGE).select(*[f"`{c}`" for c in at.schema.names]) for x in (plain, changed) if x]
    return union(frames) if frames else spark.createDataFrame([], at.schema)


def sums(rows: DataFrame) -> DataFrame:
    """What time series need of each date and sector: counts, exact sums, least and greatest values. Sums of parts make those of the whole."""
    have = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    exact = lambda c: F.sum(have(c, "double").cast("decimal(18,2)")).alias(f"sum_{c}")
    rs, price = have("rs", "double"), have("price", "double")
    return rows.groupBy("date", have("sector", "string").alias("sector")).agg(
        F.count(F.lit(1)).alias("n"), F.count(have("ticker", "string")).alias("n_tickers"), F.count(rs).alias("n_rs"), exact("rs"), F.min(rs).alias("min_rs"), F.max(rs).alias("max_rs"),
        F.count(have("percentile", "double")).alias("n_percentile"), exact("percentile"), F.count(price).alias("n_price"), F.sum(price.cast("double")).alias("sum_price"),
    )


def daily(spark: SparkSession, path: str, at: Version | None = None) -> DataFrame | None:
    """The ``sums`` of a version, which were kept up with its changes; the history itself is not read, but for dates from before there were versions."""
    at = at or version(spark, path)
    if at is None:
        return None
    live = [(d, c) for d, (c, _) in at.dates.items() if c]
    frames = []
    if live:
        kept = spark.createDataFrame([(None if d == NULL_DATE else dt.date.fromisoformat(d), c) for d, c in live], "_date date, _change string")
        stored = spark.read.option("basePath", f"{path}/{SUMS}").parquet(*sorted({f"{path}/{SUMS}/{CHANGE}={c}" for _, c in live}))
        same = F.col("date").eqNullSafe(F.col("_date")) & (F.col(CHANGE).cast("string") == F.col("_change"))
        frames.append(stored.join(F.broadcast(kept), same, "left_semi").drop(CHANGE))
    plain = {d: x for d, x in at.dates.items() if not x[0]}
    if plain:
        frames.append(sums(read(spark, path, Version(at.number, at.schema, plain))))
    return union(frames) if frames else sums(spark.createDataFrame([], at.schema))


def laid_out(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to tasks by ranges of (date, key) and sorted so: a date with many rows is written by many tasks, small dates together by one, and
    the statistics of files and row groups tell which hold a key."""
    by = ["date", key] if key in rows.columns else ["date"]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def _widened(old: T.StructType | None, rows: DataFrame) -> tuple[T.StructType, DataFrame]:
    """The columns of both, those that were there in their types, and the rows in these."""
    known = {f.name: f for f in old.fields} if old else {}
    fitted = rows.select(*[F.col(f"`{f.name}`").cast(known[f.name].dataType).alias(f.name) if f.name in known and known[f.name].dataType != f.dataType else F.col(f"`{f.name}`") for f in rows.schema.fields])
    more = [T.StructField(f.name, f.dataType) for f in fitted.schema.fields if f.name not in known]
    return T.StructType([*(T.StructField(f.name, f.dataType) for f in known.values()), *more]), fitted


def commit(spark: SparkSession, path: str, base: Version | None, rows: DataFrame, key: str) -> Version | None:
    """ST5: the version after ``base``, in which ``rows``, whole dates, stand in the place of those dates; ``base`` itself if there are none.

    The change's files and sums are written first, where no version looks. Then the manifest of the next number is made, whole, by an operation that fails if
    there is one: of two writers that began with the same version one gets its change and the other Conflict, and readers see all dates of a change or
    none. What a failed writer leaves belongs to no version; ``vacuum`` removes it.
    """
    change = f"{time.strftime('%Y%m%d')}-{uuid.uuid4().hex}"
    schema, fitted = _widened(base.schema if base else None, rows)
    folder = f"{path}/{CHANGE}={change}"
    laid_out(fitted, key).write.partitionBy("date").parquet(folder)
    days = [s.getPath().getName().removeprefix("date=") for s in _list(spark, f"{folder}/date=*")]
    if not days:
        delete(spark, folder)
        return base
    written = Version(0, schema, {d: (change, 0) for d in days})
    by_day = sums(read(spark, path, written))
    by_day.coalesce(1).write.parquet(f"{path}/{SUMS}/{CHANGE}={change}")
    counts = spark.read.parquet(f"{path}/{SUMS}/{CHANGE}={change}").groupBy("date").agg(F.sum("n")).collect()  # a row a date
    dates = {**(base.dates if base else {}), **{NULL_DATE if d is None else d.isoformat(): (change, n) for d, n in counts}}
    made = Version(base.number + 1 if base else 1, schema, dict(sorted(dates.items())))
    _publish(spark, _manifest(path, made.number), json.dumps({"version": made.number, "schema": json.loads(schema.json()), "dates": made.dates}))
    return made


def _publish(spark: SparkSession, path: str, text: str) -> None:
    """Makes a file, whole from the start, or raises Conflict if it is there."""
    staged = f"{path}.{uuid.uuid4().hex}"
    where, to = _path(spark, staged), _path(spark, path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(where)
    out.write(bytearray(text.encode()))
    out.close()
    if store.getScheme() == "file":  # a local rename would replace a file that is there
        local = [store.makeQualified(p).toUri().getPath() for p in (where, to)]
        try:
            os.link(*local)
        except FileExistsError:
            raise Conflict(path) from None
        finally:
            store.delete(where, False)
    elif exists(spark, path) or not store.rename(where, to):
        store.delete(where, False)
        raise Conflict(path)


def vacuum(spark: SparkSession, path: str, keep: int = 5, hours: float = 24) -> int:
    """Removes all but the last ``keep`` versions and the changes that none of these needs, unless they are younger than ``hours`` (a writer may be at them); returns
    how many changes went."""
    found = numbers(spark, path)
    needed = {c for n in found[-keep:] for c, _ in version(spark, path, n).dates.values()}
    for n in found[:-keep]:
        delete(spark, _manifest(path, n))
    gone = 0
    for status in _list(spark, f"{path}/{CHANGE}=*"):
        name = status.getPath().getName()
        if name.removeprefix(f"{CHANGE}=") not in needed and status.getModificationTime() / 1000 <= time.time() - 3600 * hours:
            delete(spark, f"{path}/{name}")
            delete(spark, f"{path}/{SUMS}/{name}")
            gone += 1
    return gone
