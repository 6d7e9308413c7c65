"""Selection and numbering over many tasks."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, numbering, quantiles, table
from tidemark.plans import registry
from tidemark.sources import commits

SF = "/root/testdata/sf0.001"
PROBS = {"least": 0.0, "q10": 0.1, "q50": 0.5, "q99": 0.99, "most": 1.0}


def samples():
    rnd = random.Random(1)
    return {
        "flat": [rnd.random() for _ in range(3001)], "ties": [float(rnd.randrange(4)) for _ in range(2000)], "one": [7.5], "same": [-3.0] * 1500, "two": [1.0, 2.0],
        "steep": [math.exp(rnd.uniform(-300, 300)) for _ in range(2000)], "wide": [rnd.choice((-1, 1)) * rnd.uniform(1e307, 1.7e308) for _ in range(1500)], "tiny": [rnd.randrange(9) * 5e-324 for _ in range(1500)],
        "ends": [float("inf")] * 300 + [float("-inf")] * 300 + [rnd.gauss(0, 1) for _ in range(1500)], "signs": [0.0, -0.0] * 600 + [1e-300] * 500,
    }


def expected(values, p):
    ordered = sorted(values)
    at = (len(ordered) - 1) * p
    low, high = math.floor(at), math.ceil(at)
    return ordered[low] if low == high else (1 - (at - low)) * ordered[low] + (at - low) * ordered[high]


@pytest.mark.parametrize(("few", "buckets"), [(1000, 4096), (2, 64)])
def test_quantiles(spark, monkeypatch, few, buckets):
    """Whatever a task may hold at once, the results are those of sorting all values."""
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    given = [(k, x) for k, xs in samples().items() for x in xs] + [("flat", None), ("flat", float("nan")), ("none", None), (None, 4.0), (None, 5.0)]
    random.Random(2).shuffle(given)
    df = spark.createDataFrame(given, "k string, v double").repartition(5)
    got = {r["k"]: r for r in quantiles.quantiles(df, ["k"], ["v"], PROBS, total=F.count).collect()}
    assert set(got) == {*samples(), None} and got["flat"]["n"] == got["flat"]["total"] == 3001
    for k, xs in [*samples().items(), (None, [4.0, 5.0])]:
        want = [expected(xs, p) for p in PROBS.values()]
        assert [got[k][name] for name in PROBS] == pytest.approx(want, rel=1e-15, abs=0, nan_ok=True), k


def test_quantiles_of_columns(spark):
    rnd = np.random.default_rng(3)
    data = rnd.normal(size=(20_000, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double").withColumn("none", F.lit(None).cast("double"))
    got = {r["metric"]: r for r in metrics.describe(df, ["a", "none", "b", "c"]).collect()}
    assert list(got) == ["a", "none", "b", "c"] and got["none"][1:] == (0, None, None, None, None, None, None, None)
    for i, c in enumerate("abc"):
        assert [got[c][x] for x in ("q25", "q50", "q75", "min", "max", "std")] == pytest.approx([*np.percentile(data[:, i], [25, 50, 75]), data[:, i].min(), data[:, i].max(), data[:, i].std(ddof=1)])
    assert quantiles.quantiles(df.limit(0), [], ["a", "b"], PROBS).count() == 0 and metrics.describe(df.limit(0), ["a"]).first()["n"] == 0


def test_daily_strength_without_values(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 1, 1), 4.0), (dt.date(2024, 1, 2), None), (None, 9.0)], "date date, rs double")
    assert sorted(map(tuple, metrics.daily_strength(df).collect())) == [(dt.date(2024, 1, 1), 2.5, 2.5, 4.0), (dt.date(2024, 1, 2), None, None, None)]


def test_selection_holds_no_column_in_a_task(spark):
    """No exact aggregate over all values; what is listed has passed through brackets of few values."""
    for name in ("describe_stats", "daily_rs_stats"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString().lower()
        assert "percentile(" not in plan and "median(" not in plan


def test_numbers_without_a_window(spark):
    for name in ("table_sorted_ranked", "grouped_ticker_list", "dated_line_pairs"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number() windowspecdefinition(" not in plan.replace("windowspecdefinition(industry", "").replace("windowspecdefinition(ticker", "")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 7.0).otherwise(F.col("id") % 11).alias("x"), F.col("id").cast("string").alias("ticker")).repartition(7)
        got = table.numbered(df, "x", ascending=False).orderBy("row_num").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["row_num"] for r in got] == list(range(1, 5001))
    assert [(r["x"], r["ticker"]) for r in got] == sorted(((r["x"], r["ticker"]) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    assert table.numbered(df.limit(0), "x").count() == 0


def test_log_of_lines(spark, tmp_path):
    """A log larger than a split keeps its order."""
    pairs = [(f"{i:040x}", dt.date(2020, 1, 1) + dt.timedelta(i % 900)) for i in range(3000)]
    (tmp_path / "log").write_text("".join(f"{h}\n{d} 10:00:00 +0000\n" for h, d in pairs))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = commits.log_of_lines(spark, str(tmp_path / "log"))
        assert sorted(map(tuple, got.collect())) == sorted(pairs)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
