"""Views of the driver's tables in the shape of stock and industry histories, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import exact_mean, joined
from tidemark.operators.steps import table

#: Cells of a measure's logarithmic scale in a factor of e.
CELLS = 32


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cell(x: Column) -> Column:
    """A whole number that never falls in the order of ``x``: nulls, negative numbers, zero, positive numbers, NaN."""
    scaled = F.when(x > 0, 1000 + F.log(x)).when(x < 0, -1000 - F.log(-x)).otherwise(0.0)
    return F.when(x.isNull(), -(1 << 20)).when(F.isnan(x), 1 << 20).otherwise(F.floor(scaled * CELLS)).cast("int")


def spread_places(rows: DataFrame, places: dict[str, str]) -> DataFrame:
    """``rows`` with rank (by rs, falling) and the ``places`` (name: column) of ``snap``, where a date may have any number of rows.

    A column's cells are ranges of its values. A row's place in its date is its place in its cell and the rows of the cells before, which are counted in one pass that
    combines in the tasks. So a task sorts cells and not dates, and one column at a time, as each has a shuffle of its own.
    """
    of = {name: F.col(c).cast("double") for name, c in places.items()}
    listed = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), _cell(x).alias("cell")) for name, x in of.items()]))
    counts = rows.select("date", listed.alias("_at")).groupBy("date", "_at.name", "_at.cell").count()
    own = Window.partitionBy("date", "name")
    cells = table(counts.select(F.col("date").alias("_date"), "name", F.col("cell").alias("_in"), (F.sum("count").over(own.orderBy("cell")) - F.col("count")).alias("_before"), F.sum("count").over(own).alias("_n")))
    for name, c in places.items():
        known = F.broadcast(cells.where(F.col("name") == name).drop("name"))  # dates times the cells of a column
        within = Window.partitionBy("date", "_cell").orderBy(c)
        placed = rows.withColumn("_cell", _cell(of[name])).withColumn("_less", F.rank().over(within) - 1)
        if c == "rs":
            placed = placed.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("date", "_cell", c)))
        placed = placed.join(known, F.col("date").eqNullSafe(F.col("_date")) & (F.col("_cell") == F.col("_in")))
        less = F.col("_before") + F.col("_less")
        share = F.when(F.col("_n") > 1, less.cast("double") / (F.col("_n") - 1).cast("double")).otherwise(0.0)
        more = [(F.col("_n") - less - F.col("_same") + 1).cast("int").alias("rank")] if c == "rs" else []
        rows = placed.select(*rows.columns, *more, (F.floor(share * 98) + 1).cast("int").alias(name))
    return rows


def snap(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """A stock history: one row per month and part. The aggregate is the only step over all lineitems. Where all ranks are asked for, ``spread`` finds them
    by cells instead of a chain of sorts of whole dates."""
    items = read(spark, sf_dir, "lineitem").select("l_partkey", F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"), "l_extendedprice", "l_quantity", "l_discount")
    sums = items.groupBy("date", "l_partkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("rs"), F.max(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.sum("l_quantity").alias("avg_vol"),
        F.max(F.when(F.col("l_discount") > 0.05, F.col("l_discount") * 100)).alias("short_float_pct"),
    )
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("sector"), F.col("p_brand").alias("industry"), "p_retailprice")
    rows = sums.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("date", F.col("l_partkey").cast("string").alias("ticker"), "sector", "industry", "rs", "price", "avg_vol", (F.col("p_retailprice") * F.col("avg_vol")).alias("market_cap"), "short_float_pct")

    places = {"percentile": "rs", "p1m": "price", "p3m": "avg_vol", "p6m": "market_cap"}

    def place(by: str):
        return (F.floor(F.percent_rank().over(Window.partitionBy("date").orderBy(by)) * 98) + 1).cast("int")

    if spread:
        ranked = spread_places(rows, places)
    else:
        ranked = rows.withColumns({"rank": F.rank().over(Window.partitionBy("date").orderBy(F.col("rs").desc())).cast("int"), **{name: place(by) for name, by in places.items()}})
    own = Window.partitionBy("ticker")
    return ranked.withColumns({"pct_from_high": (F.col("price") / F.max("price").over(own) - 1) * 100, "revenue_growth": (F.col("rs") / F.lag("rs").over(own.orderBy("date")) - 1) * 100})


SNAP = """
sums AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(l_partkey AS VARCHAR) AS ticker, p_type AS sector, p_brand AS industry,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS rs, max(l_extendedprice / l_quantity) AS price, sum(l_quantity) AS avg_vol,
    max(p_retailprice) * sum(l_quantity) AS market_cap, max(CASE WHEN l_discount > 0.05 THEN l_discount * 100 END) AS short_float_pct
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4
), snap AS (
  SELECT *, CAST(rank() OVER (PARTITION BY date ORDER BY rs DESC) AS INTEGER) AS rank,
    CAST(floor(percent_rank() OVER (PARTITION BY date ORDER BY rs) * 98) + 1 AS INTEGER) AS percentile,
    CAST(floor(percent_rank() OVER (PARTITION BY date ORDER BY price) * 98) + 1 AS INTEGER) AS p1m,
    CAST(floor(percent_rank() OVER (PARTITION BY date ORDER BY avg_vol) * 98) + 1 AS INTEGER) AS p3m,
    CAST(floor(percent_rank() OVER (PARTITION BY date ORDER BY market_cap) * 98) + 1 AS INTEGER) AS p6m,
    (price / max(price) OVER (PARTITION BY ticker) - 1) * 100 AS pct_from_high,
    (rs / lag(rs) OVER (PARTITION BY ticker ORDER BY date) - 1) * 100 AS revenue_growth
  FROM sums
)"""


def ind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An industry history: one row per month and brand."""
    groups = snap(spark, sf_dir).groupBy("industry", "date").agg(
        exact_mean(F.col("rs")).alias("rs"), F.count(F.lit(1)).alias("n"), *[F.floor(F.sum(p) / F.count(p)).cast("int").alias(p) for p in ("p1m", "p3m", "p6m")],
        joined("ticker", ",").alias("tickers"),
    )
    ranked = groups.withColumn("rank", F.rank().over(Window.partitionBy("date").orderBy(F.col("rs").desc())).cast("int"))
    return ranked.withColumns({r: (F.lit(101) - F.col(p)).cast("double") for p, r in (("p1m", "r1m"), ("p3m", "r3m"), ("p6m", "r6m"))})


IND = """
groups AS (
  SELECT industry, date, CAST(sum(CAST(rs AS DECIMAL(18,2))) AS DOUBLE) / count(rs) AS rs, count(*) AS n,
    CAST(floor(sum(p1m) / CAST(count(*) AS DOUBLE)) AS INTEGER) AS p1m, CAST(floor(sum(p3m) / CAST(count(*) AS DOUBLE)) AS INTEGER) AS p3m, CAST(floor(sum(p6m) / CAST(count(*) AS DOUBLE)) AS INTEGER) AS p6m,
    string_agg(ticker, ',' ORDER BY ticker) AS tickers
  FROM snap GROUP BY industry, date
), ind AS (
  SELECT *, CAST(rank() OVER (PARTITION BY date ORDER BY rs DESC) AS INTEGER) AS rank,
    CAST(101 - p1m AS DOUBLE) AS r1m, CAST(101 - p3m AS DOUBLE) AS r3m, CAST(101 - p6m AS DOUBLE) AS r6m
  FROM groups
)"""


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily snapshots with several rows for a key and date."""
    return read(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), F.col("user_id").cast("string").alias("ticker"), F.col("event_type").alias("sector"), F.col("value").alias("rs"), F.col("event_id").alias("ordinal"), "ts")


EV = """
ev AS (
  SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS ticker, event_type AS sector, value AS rs, event_id AS ordinal, ts FROM events
)"""
