"""Industry rotation and ticker lists by industry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import delta_class, descending, file_label, first_listed, joined, whole
from tidemark.operators.filters import on_newest
from tidemark.operators.numbering import numbered
from tidemark.operators.snapshot import first_rows


def latest_industries(df: DataFrame) -> DataFrame:
    """The newest snapshot, one row per industry. Without dates (A17), the first row of each industry by rank."""
    order = [F.col(c).asc_nulls_last() for c in ("rank", "rs", "tickers") if c in df.columns]
    return first_rows(on_newest(df) if "date" in df.columns else df, ["industry"], order)


def deltas(df: DataFrame) -> DataFrame:
    """Whole ranks (or, without them, percentiles) of the horizons, with deltas that are positive for better.

    Which of the two, or neither, follows from the columns that ``df`` has (P11).
    """
    rank = [whole(F.col("rank")).alias("rank")] if "rank" in df.columns else []
    ranks, percentiles = ["r1m", "r3m", "r6m"], ["p1m", "p3m", "p6m"]
    if set(ranks) <= set(df.columns):
        one, three, six = (F.col(c) for c in ranks)
        first, second = three - one, six - one
    elif set(percentiles) <= set(df.columns):
        one, three, six = (F.col(c) for c in percentiles)
        first, second = one - three, one - six
    else:
        return df.select(*rank, "industry")
    shown = df.select(*rank, "industry", whole(one).alias("m1"), whole(three).alias("m3"), whole(six).alias("m6"), whole(first).alias("delta_1m_3m"), whole(second).alias("delta_1m_6m"))
    return shown.withColumns({"class_1m_3m": delta_class(F.col("delta_1m_3m")), "class_1m_6m": delta_class(F.col("delta_1m_6m"))})


def top_tickers(stocks: DataFrame, n: int = 5) -> DataFrame:
    """(industry, top): the ``n`` strongest tickers of each industry in one snapshot, joined in order."""
    rows = first_rows(stocks, ["ticker"], [F.col("rs").desc_nulls_last()]).dropna(subset=["ticker", "rs", "industry"])
    best = first_rows(rows, ["industry"], [F.col("rs").desc(), F.col("ticker")], n)
    return best.groupBy("industry").agg(joined("ticker", ", ", *descending("rs")).alias("top"))


def rotation(industries: DataFrame, stocks: DataFrame, n: int = 5) -> DataFrame:
    """Each industry with its top tickers from the stocks' snapshot, or else from its own list."""
    top = top_tickers(stocks, n).withColumnRenamed("industry", "_industry")
    listed = first_listed(F.col("tickers"), n) if "tickers" in industries.columns else F.lit("")
    joined = industries.join(top, F.col("industry") == F.col("_industry"), "left")
    return joined.withColumn("top_tickers", F.coalesce("top", listed)).drop("top", "_industry")


def grouped_top(stocks: DataFrame, industries: DataFrame, n: int = 200) -> DataFrame:
    """The ``n`` strongest tickers of a snapshot, with the strength of their industry (null if unknown)."""
    one = first_rows(stocks, ["ticker"], [F.col("rs").desc_nulls_last()])
    best = one.orderBy(F.col("rs").desc_nulls_last(), "ticker").limit(n).select("ticker", "industry", "rs")
    known = first_rows(industries, ["industry"], [F.col("rank").asc_nulls_last()]).select(F.col("industry").alias("_industry"), F.col("rs").alias("industry_rs"))
    return best.join(known, F.col("industry") == F.col("_industry"), "left").drop("_industry")


def lists_by_industry(top: DataFrame) -> DataFrame:
    """One row per industry (null excluded, T10): place by strength, size, its tickers in order, a file name."""
    groups = top.where(F.col("industry").isNotNull()).groupBy("industry").agg(F.max("industry_rs").alias("industry_rs"), F.count(F.lit(1)).alias("n_tickers"), joined("ticker", ",", *descending("rs")).alias("tickers"))
    named = groups.withColumn("file_name", F.concat(file_label(F.col("industry")), F.lit("_tickers.txt")))
    return numbered(named, [F.col("industry_rs").desc_nulls_last(), F.col("industry")], "place")


def whole_list(top: DataFrame) -> DataFrame:
    """All tickers in one text, the strongest industry first."""
    listed = joined("ticker", ",", *descending("industry_rs"), F.col("industry"), *descending("rs"))
    return top.where(F.col("industry").isNotNull()).agg(listed.alias("tickers"), F.count(F.lit(1)).alias("n_tickers"))
