"""Composable filters."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(df: DataFrame, column: str = "date") -> tuple:
    """Least and greatest value, resolved once so that filters on them are literals that scans can use."""
    row = df.agg(F.min(column), F.max(column)).first()
    return row[0], row[1]


def between(df: DataFrame, start: dt.date | None, end: dt.date | None, column: str = "date") -> DataFrame:
    """both ends included; with an end missing, all rows."""
    return df if start is None or end is None else df.where(F.col(column).between(F.lit(start), F.lit(end)))


def last_days(df: DataFrame, days: int = 30, column: str = "date") -> DataFrame:
    """Rows of the last ``days`` days up to the newest date."""
    newest = bounds(df, column)[1]
    return df.limit(0) if newest is None else between(df, newest - dt.timedelta(days=days), newest, column)


def after(df: DataFrame, cutoff: dt.date | None, column: str = "date") -> DataFrame:
    """rows strictly after ``cutoff``; all if it is None."""
    return df if cutoff is None else df.where(F.col(column) > F.lit(cutoff))


def on_newest(df: DataFrame, column: str = "date") -> DataFrame:
    """rows of the newest date."""
    return df.where(F.col(column) == F.lit(bounds(df, column)[1]))


def on_oldest(df: DataFrame, column: str = "date") -> DataFrame:
    """rows of the oldest date."""
    return df.where(F.col(column) == F.lit(bounds(df, column)[0]))


@dataclass(frozen=True)
class FilterSpec:
    """The sidebar's filters: dates or dataset, then sectors, percentile and strength.

    ``sectors`` with "All" takes every sector, an empty tuple none. The two minima drop null values.
    """

    start: dt.date | None = None
    end: dt.date | None = None
    source_file: str = "All Files"
    sectors: tuple[str, ...] = ("All",)
    min_percentile: float = 0
    min_rs: float = 0.0

    def apply(self, df: DataFrame) -> DataFrame:
        df = between(df, self.start, self.end) if "date" in df.columns else df
        if "date" not in df.columns and "source_file" in df.columns and self.source_file != "All Files":
            df = df.where(F.col("source_file") == self.source_file)
        if "All" not in self.sectors:
            df = df.where(F.col("sector").isin(*self.sectors) if self.sectors else F.lit(False))
        return df.where((F.col("percentile") >= self.min_percentile) & (F.col("rs") >= self.min_rs))


def search(df: DataFrame, text: str, column: str = "ticker", literal: bool = False) -> DataFrame:
    """rows whose ``column``, in upper case, contains the trimmed upper-case pattern; no null matches."""
    wanted = text.strip().upper()
    if not wanted:
        return df
    if literal:
        return df.where(F.contains(F.upper(column), F.lit(wanted)))
    re.compile(wanted)
    return df.where(F.upper(column).rlike(wanted))


def numeric_ranges(df: DataFrame, limit: int = 9) -> dict[str, tuple[float, float]]:
    """bounds of the first ``limit`` numeric columns that have two different values; one aggregate over all."""
    columns = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "long", "integer", "short")][:limit]
    if not columns:
        return {}
    row = df.agg(*[g(f"`{c}`").cast("double").alias(f"{k}{i}") for i, c in enumerate(columns) for k, g in (("lo", F.min), ("hi", F.max))]).first()
    found = {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}
    return {c: v for c, v in found.items() if v[0] is not None and v[0] < v[1]}


def in_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]], compat: bool = False) -> DataFrame:
    """rows within all ``ranges``. A range as wide as the data drops nothing, or, with ``compat``, nulls."""
    full = {} if compat else numeric_ranges(df, len(df.columns))
    condition: Column = F.lit(True)
    for name, (low, high) in ranges.items():
        if compat or name not in full or low > full[name][0] or high < full[name][1]:
            condition &= F.col(f"`{name}`").between(low, high)
    return df.where(condition)


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    """rows without null in ``columns``."""
    return df.dropna(subset=list(columns))


def options(df: DataFrame, column: str, ordered: bool = True) -> DataFrame:
    """The distinct values of ``column`` that are not null, in order."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return values.orderBy(column) if ordered else values


def sampled(df: DataFrame, n: int, key: str = "ticker") -> DataFrame:
    """``n`` rows for a plot that cannot show them all: those of least digest of date and ``key``, so that rows are alike to be taken and a rerun takes
    the same. Each task keeps its ``n`` least; nothing else is shuffled."""
    digest = F.md5(F.concat_ws("/", F.col("date").cast("string"), F.col(key)))
    return df.orderBy(digest, "date", key).limit(n)
