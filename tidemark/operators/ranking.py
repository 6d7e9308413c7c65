"""Top lists, gainers, momentum, trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import exact_mean
from tidemark.operators.filters import bounds
from tidemark.operators.snapshot import first_rows, latest_per_ticker, newest_first


def top_k(df: DataFrame, by: str, k: int = 15, columns: list[str] | None = None) -> DataFrame:
    """The ``k`` rows of greatest ``by``, nulls last, ties by ticker."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col("ticker")).limit(k).select(*(columns or df.columns))


def top_performers(df: DataFrame, by: str, k: int = 15, columns: list[str] | None = None) -> DataFrame:
    """Top tickers, each by its newest row."""
    return top_k(latest_per_ticker(df), by, k, columns)


def ends(df: DataFrame) -> tuple[DataFrame, object, object]:
    """the rows of the oldest and the newest date, and the two dates."""
    low, high = bounds(df)
    return df.where(F.col("date").isin(low, high)), low, high


def sector_momentum(df: DataFrame) -> DataFrame:
    """Mean strength by sector on the newest date less that on the oldest; null if a side is missing.

    One pass over the rows of the two dates does what a full outer join of two aggregates would.
    """
    rows, low, high = ends(df)
    rows = rows.where(F.col("sector").isNotNull())
    new, old = (exact_mean(F.when(F.col("date") == F.lit(d), F.col("rs"))) for d in (high, low))
    return rows.groupBy("sector").agg((new - old).alias("rs_change")).orderBy(F.col("rs_change").desc_nulls_last(), "sector")


def top_gainers(df: DataFrame, k: int = 10, compat: bool = False) -> DataFrame:
    """Tickers of greatest change from the oldest date to the newest. With ``compat`` null tickers match."""
    rows, low, high = ends(df)
    firsts = first_rows(rows, ["ticker", "date"], newest_first(rows))
    new = firsts.where(F.col("date") == F.lit(high)).select("ticker", "sector", F.col("rs").alias("rs_latest"))
    old = firsts.where(F.col("date") == F.lit(low)).select(F.col("ticker").alias("old_ticker"), F.col("rs").alias("rs_oldest"))
    same = F.col("ticker").eqNullSafe(F.col("old_ticker")) if compat else F.col("ticker") == F.col("old_ticker")
    joined = new.join(old, same).withColumn("rs_change", F.col("rs_latest") - F.col("rs_oldest"))
    return top_k(joined, "rs_change", k, ["ticker", "sector", "rs_change"])


def trajectory(df: DataFrame, ticker: str) -> DataFrame:
    """Strength, percentile, price and rank of a ticker by date."""
    return df.where(F.col("ticker") == ticker).select("date", "rs", "percentile", "price", "rank").orderBy("date")
