"""The data table: newest rows, chosen columns, order, row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import billions, or_na
from tidemark.operators import numbering
from tidemark.operators.filters import on_newest
from tidemark.operators.snapshot import latest_per_ticker

DEFAULT = ("rank", "ticker", "industry", "p1m", "p3m", "p6m", "price", "market_cap", "avg_vol30", "pct_from_high")


def latest_table(df: DataFrame) -> DataFrame:
    """Rows of the newest date of all data, whatever the filters."""
    return on_newest(df) if "date" in df.columns else df


def chosen(df: DataFrame, columns: tuple[str, ...] = DEFAULT) -> DataFrame:
    """Those of ``columns`` that ``df`` has; none is an error."""
    found = [c for c in columns if c in df.columns]
    if not found:
        raise ValueError("no column chosen")
    return df.select(*found)


def numbered(df: DataFrame, by: str, ascending: bool = True, ties: str = "ticker") -> DataFrame:
    """Rows in order of ``by``, nulls last both ways, with row_num from 1 as first column.

    The number does not replace the data's own rank (T12). Tables of any size are numbered by tasks, see ``numbering``.
    """
    key = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return numbering.numbered(df, [key, F.col(ties)]).select("row_num", *df.columns)


def company(df: DataFrame, ticker: str) -> DataFrame:
    """The newest row of a ticker as text, N/A for null."""
    keys = ("sector", "industry", "price", "market_cap", "avg_vol30", "pct_from_high", "rs", "percentile", "p1m", "p3m", "p6m")
    row = latest_per_ticker(df.where(F.col("ticker") == ticker))
    return row.select("ticker", *[(billions(F.col(c)) if c == "market_cap" else or_na(F.col(c))).alias(c) for c in keys if c in df.columns])
