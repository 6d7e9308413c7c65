"""First rows of a key: newest row, newest rows, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, which should be total; Spark limits each key's rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def newest_first(df: DataFrame, compat_ascending: bool = False) -> list[Column]:
    """The order of "keep first": newest date (oldest in ``compat_ascending``, as in old histories), then explicit ties (T4, T5)."""
    date = F.col("date").asc_nulls_last() if compat_ascending else F.col("date").desc_nulls_last()
    ties = [("precedence", False), ("age", False), ("ordinal", True), ("file_num", False), ("line", False), ("rs", True)]
    return [date, *[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in ties if c in df.columns]]


def latest_per_ticker(df: DataFrame, compat_ascending: bool = False) -> DataFrame:
    """One row per ticker, the newest."""
    return first_rows(df, ["ticker"], newest_first(df, compat_ascending))


def recent(df: DataFrame, ticker: str, n: int = 10) -> DataFrame:
    """The last ``n`` rows of a ticker, oldest first."""
    return df.where(F.col("ticker") == ticker).orderBy(F.col("date").desc()).limit(n).orderBy("date")


def per_key_and_date(df: DataFrame, key: str) -> DataFrame:
    """One row per key and date. Rows that tie in all of ``newest_first`` go by a hash of all their columns, so the
    order is total (T5)."""
    rest = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return first_rows(df, [key, "date"], [*newest_first(df), F.xxhash64(*rest)])
