"""Aggregates: overview, time series, description, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import exact_mean
from tidemark.operators.quantiles import quantiles
from tidemark.operators.snapshot import latest_per_ticker


def overview(df: DataFrame, mean=exact_mean) -> DataFrame:
    """Rows, mean strength, percentile and price, distinct dates and tickers, in one row."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), mean(F.col("rs")).alias("avg_rs"), mean(F.col("percentile")).alias("avg_percentile"), F.avg("price").alias("avg_price"),
        F.count_distinct("date").alias("n_dates"), F.count_distinct("ticker").alias("n_tickers"),
    )


def top_groups(df: DataFrame, key: str, value: Column, name: str, n: int = 10) -> DataFrame:
    """The ``n`` groups of ``key`` (null excluded, T10) of greatest ``value``, ties by key."""
    groups = df.where(F.col(key).isNotNull()).groupBy(key).agg(value.alias(name))
    return groups.orderBy(F.col(name).desc_nulls_last(), key).limit(n)


def sector_counts(df: DataFrame, n: int = 10) -> DataFrame:
    """Tickers by sector."""
    return top_groups(latest_per_ticker(df), "sector", F.count(F.lit(1)), "n_stocks", n)


def sector_means(df: DataFrame, n: int = 10) -> DataFrame:
    """Mean strength by sector, of each ticker's newest row."""
    return top_groups(latest_per_ticker(df), "sector", exact_mean(F.col("rs")), "avg_rs", n)


def by_date(df: DataFrame, **values: Column) -> DataFrame:
    """Aggregates for each date."""
    return df.where(F.col("date").isNotNull()).groupBy("date").agg(*[v.alias(k) for k, v in values.items()])


def daily_strength(df: DataFrame) -> DataFrame:
    """Mean, median and maximum strength by date (T23); the medians of all dates are selected together. Dates without a strength have nulls."""
    days = df.where(F.col("date").isNotNull()).select("date", "rs")
    found = quantiles(days, ["date"], ["rs"], {"median_rs": 0.5}, mean_rs=exact_mean, max_rs=F.max)
    empty = days.groupBy("date").agg(F.count("rs").alias("n")).where("n = 0").select("date", *[F.lit(None).cast("double").alias(c) for c in ("mean_rs", "median_rs", "max_rs")])
    return found.select("date", "mean_rs", "median_rs", "max_rs").unionByName(empty)


def series_of_sums(sums: DataFrame) -> DataFrame:
    """Mean percentile, tickers, mean price and mean strength of each date from a history's sums by day (``versions.daily``); its keys are unique in a date."""
    mean = lambda c: (F.sum(f"sum_{c}").cast("double") / F.nullif(F.sum(f"n_{c}"), F.lit(0))).alias(f"avg_{c}")
    return sums.where(F.col("date").isNotNull()).groupBy("date").agg(mean("percentile"), F.sum("n_tickers").alias("n_tickers"), mean("price"), mean("rs"), F.max("max_rs").alias("max_rs"))


def trend_of_sums(sums: DataFrame, sector: str | None = None) -> DataFrame:
    """As ``sector_trend``, from a history's sums by day."""
    rows = sums.where(F.col("sector").isNotNull()) if sector is None else sums.where(F.col("sector") == sector)
    return rows.select("sector", "date", (F.col("sum_rs").cast("double") / F.nullif(F.col("n_rs"), F.lit(0))).alias("mean_rs"), "min_rs", "max_rs")


def sector_trend(df: DataFrame, sector: str | None = None) -> DataFrame:
    """Mean, least and greatest strength by sector and date; of one sector if it is named."""
    rows = df.where(F.col("sector").isNotNull()) if sector is None else df.where(F.col("sector") == sector)
    return rows.groupBy("sector", "date").agg(exact_mean(F.col("rs")).alias("mean_rs"), F.min("rs").alias("min_rs"), F.max("rs").alias("max_rs"))


def horizon_means(df: DataFrame) -> DataFrame:
    """Mean percentile of each horizon, a row each."""
    means = df.agg(*[exact_mean(F.col(c)).alias(c) for c in ("p1m", "p3m", "p6m")])
    return means.select(F.expr("stack(3, '1M', p1m, '3M', p3m, '6M', p6m) AS (horizon, mean_percentile)"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, standard deviation, least, quartiles (interpolated) and greatest of each column, in their order; a column without values
    has a count of 0 and nulls. The quartiles of all columns are selected together, by passes that combine in the tasks."""
    quartiles = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    found = quantiles(df, [], columns, quartiles, mean=F.avg, std=F.stddev_samp, min=F.min, max=F.max).withColumnRenamed("metric", "_metric")
    every = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("_at", "metric"))
    both = every.join(F.broadcast(found), F.col("metric") == F.col("_metric"), "left")
    return both.orderBy("_at").select("metric", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "mean", "std", "min", *quartiles, "max")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Counts in ``bins`` bins of equal width from the least value to the greatest, which is in the last;
    all in bin 0 if they are equal (T14). Empty bins have no row."""
    x = F.col(column).cast("double")
    values = df.select(x.alias("x")).where(F.col("x").isNotNull())
    low, high = values.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return values.limit(0).select(F.lit(0).alias("bin"), F.lit(0.0).alias("bin_start"), F.lit(0.0).alias("bin_end"), F.lit(0).cast("bigint").alias("n"))
    width = (high - low) / bins
    place = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int") if width > 0 else F.lit(0)
    edges = {"bin_start": F.lit(low) + F.col("bin") * F.lit(width), "bin_end": F.lit(low) + (F.col("bin") + 1) * F.lit(width)}
    return values.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumns(edges).select("bin", "bin_start", "bin_end", "n")


def summary(df: DataFrame, key: str) -> DataFrame:
    """Records, distinct dates and keys, first and last date."""
    return df.agg(F.count(F.lit(1)).alias("total_records"), F.count_distinct("date").alias("unique_dates"), F.count_distinct(key).alias(f"unique_{key}s"), F.min("date").cast("string").alias("date_min"), F.max("date").cast("string").alias("date_max"))
