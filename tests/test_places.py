"""Ranks by cells against ranks by windows over whole dates."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans import views


def test_places_by_cells_are_those_of_whole_dates(spark):
    rnd, odd = random.Random(3), [None, 0.0, -1.5, -2.0, 1e-300, 1e300, float("nan"), 7.0, 7.0]
    given = [(dt.date(2024, 1 + k % 3, 1) if k % 17 else None, k, *[rnd.choice(odd) if rnd.random() < 0.3 else rnd.uniform(-50, 2000) for _ in range(4)]) for k in range(400)] + [(dt.date(2025, 1, 1), 999, 1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(given, "date date, id int, rs double, price double, avg_vol double, market_cap double").repartition(3)
    places = {"percentile": "rs", "p1m": "price", "p3m": "avg_vol", "p6m": "market_cap"}
    own = Window.partitionBy("date")
    wanted = df.withColumn("rank", F.rank().over(own.orderBy(F.col("rs").desc())).cast("int"))
    wanted = wanted.withColumns({name: (F.floor(F.percent_rank().over(own.orderBy(c)) * 98) + 1).cast("int") for name, c in places.items()})
    got = views.spread_places(df, places)
    assert got.columns.count("rank") == 1
    columns = ["id", "rank", *places]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, wanted.select(columns).collect()))
