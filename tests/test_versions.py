"""Versions of histories: atomic changes, marks without scans, layout, sums by day."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, ranking
from tidemark.plans import history
from tidemark.plans.views import snap
from tidemark.sources import sinks, versions

D = dt.date
SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def stocks(spark, *given):
    return spark.createDataFrame(given, "date date, ticker string, rs double")


def day(spark, n, rs, *tickers):
    return stocks(spark, *[(D(2024, 1, n), t, float(rs)) for t in tickers or "AB"])


def held(spark, path, **which):
    return sorted((r["date"] and r["date"].day, r["ticker"], r["rs"]) for r in history.read_history(spark, path, **which).collect())


def test_readers_see_all_of_a_change_or_none(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/history"
    history.replace_dates(spark, path, day(spark, 1, 1).union(day(spark, 2, 2)))
    before = history.read_history(spark, path)
    publish, seen = versions._publish, []

    def look(*args):
        seen.append(held(spark, path))  # all files of the change are written, its version is not
        publish(*args)

    monkeypatch.setattr(versions, "_publish", look)
    assert history.append(spark, path, day(spark, 2, 9).union(day(spark, 3, 3)), "ticker", lateness=1) == history.Appended("appended", 4, D(2024, 1, 1))
    old = [(1, "A", 1.0), (1, "B", 1.0), (2, "A", 2.0), (2, "B", 2.0)]
    assert seen == [old] and sorted((r["date"].day, r["ticker"], r["rs"]) for r in before.collect()) == old
    assert held(spark, path) == [(1, "A", 1.0), (1, "B", 1.0), (2, "A", 9.0), (2, "B", 9.0), (3, "A", 3.0), (3, "B", 3.0)]
    assert held(spark, path, at=versions.version(spark, path, 1)) == old and versions.numbers(spark, path) == [1, 2]
    with pytest.raises(ValueError):
        versions.version(spark, path, 7)


def test_two_writers(spark, tmp_path, monkeypatch):
    """Two appends begin with the same version: one is made anew on top of the other, and no row is lost."""
    path = f"{tmp_path}/history"
    history.replace_dates(spark, path, day(spark, 1, 1))
    publish, others = versions._publish, [day(spark, 2, 2, "B"), day(spark, 3, 3, "C")]

    def overtaken(*args):
        if others:
            other = others.pop(0)
            monkeypatch.setattr(versions, "_publish", publish)
            assert history.append(spark, path, other, "ticker", lateness=1).state == "appended"
            monkeypatch.setattr(versions, "_publish", overtaken)
        publish(*args)

    monkeypatch.setattr(versions, "_publish", overtaken)
    done = history.append(spark, path, day(spark, 2, 7, "A").union(day(spark, 4, 4, "D")), "ticker", lateness=3)
    assert done.state == "appended" and held(spark, path) == [(1, "A", 1.0), (1, "B", 1.0), (2, "A", 7.0), (2, "B", 2.0), (3, "C", 3.0), (4, "D", 4.0)]
    assert versions.numbers(spark, path) == [1, 2, 3, 4]
    base = versions.version(spark, path, 2)
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, base, day(spark, 5, 5), "ticker")
    assert versions.vacuum(spark, path, keep=1, hours=1) == 0 and versions.vacuum(spark, path, keep=1, hours=0) >= 3
    assert len(held(spark, path)) == 6 and versions.numbers(spark, path) == [4]


def test_the_mark_needs_no_file(spark, tmp_path):
    """An append finds its cutoff though the history's files cannot be read at all."""
    path = f"{tmp_path}/history"
    history.replace_dates(spark, path, day(spark, 1, 1).union(day(spark, 2, 2)))
    change = next(x for x in (tmp_path / "history").iterdir() if x.name.startswith("change="))
    shutil.move(change, tmp_path / "away")
    assert history.append(spark, path, day(spark, 2, 5), "ticker") == history.Appended("current", 0, D(2024, 1, 2))
    assert history.append(spark, path, day(spark, 3, 3), "ticker") == history.Appended("appended", 2, D(2024, 1, 2))
    shutil.move(tmp_path / "away", change)
    assert len(held(spark, path)) == 6 and versions.version(spark, path).rows() == 6


def test_dates_are_pruned_by_the_manifest(spark, tmp_path):
    path = f"{tmp_path}/history"
    for n in range(1, 6):
        new = day(spark, n, n)
        history.replace_dates(spark, path, new) if n == 1 else history.append(spark, path, new, "ticker")
    part = history.read_history(spark, path, start=D(2024, 1, 2), end=D(2024, 1, 3))
    assert {x.split("date=")[1][:10] for x in part.inputFiles()} == {"2024-01-02", "2024-01-03"} and part.count() == 4
    assert held(spark, path, dates=[D(2024, 1, 5), D(2030, 1, 1)]) == [(5, "A", 5.0), (5, "B", 5.0)] and history.read_history(spark, path, dates=[]).columns == ["date", "ticker", "rs"]


def test_columns_and_null_dates(spark, tmp_path):
    path = f"{tmp_path}/history"
    history.replace_dates(spark, path, stocks(spark, (None, "N", 1.0), (D(2024, 1, 1), "A", 2.0)))
    wider = stocks(spark, (D(2024, 1, 2), "A", 3.0)).select("date", "ticker", F.col("rs").cast("int").alias("rs"), F.lit("x").alias("sector"))
    history.append(spark, path, wider, "ticker")
    got = history.read_history(spark, path)
    assert got.dtypes == [("date", "date"), ("ticker", "string"), ("rs", "double"), ("sector", "string")]
    assert rows(got.select("date", "ticker", "rs", "sector")) == sorted([(None, "N", 1.0, None), (D(2024, 1, 1), "A", 2.0, None), (D(2024, 1, 2), "A", 3.0, "x")], key=repr)
    assert versions.version(spark, path).newest() == D(2024, 1, 2) and versions.daily(spark, path).count() == 3


def test_a_plain_history_goes_on_as_versions(spark, tmp_path):
    path = f"{tmp_path}/history"
    sinks.write_history(day(spark, 1, 1).union(day(spark, 2, 2)), path)
    assert versions.version(spark, path).newest() == D(2024, 1, 2) and versions.daily(spark, path).count() == 2
    history.append(spark, path, day(spark, 2, 8, "B").union(day(spark, 3, 3, "C")), "ticker", lateness=1)
    assert held(spark, path) == [(1, "A", 1.0), (1, "B", 1.0), (2, "A", 2.0), (2, "B", 8.0), (3, "C", 3.0)]
    assert sorted((r["date"].day, float(r["sum_rs"])) for r in versions.daily(spark, path).collect()) == [(1, 2.0), (2, 10.0), (3, 3.0)]
    assert versions.version(spark, str(tmp_path / "none")) is None and versions.daily(spark, str(tmp_path / "none")) is None


@pytest.mark.parametrize("plain", [False, True])
def test_layout_of_a_skewed_date(spark, tmp_path, plain):
    """A date with nearly all rows is written by several tasks, each with a range of tickers; a ticker's rows are found without reading the others."""
    path = f"{tmp_path}/history"
    big = spark.range(40_000).select(F.when(F.col("id") % 100 == 0, F.lit("2024-01-01")).otherwise("2024-01-02").cast("date").alias("date"), F.format_string("T%06d", "id").alias("ticker"), F.rand(1).alias("rs"), F.lit(50).alias("percentile"), F.lit(1.0).alias("price"), F.lit(1).alias("rank"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_history(big, path) if plain else history.replace_dates(spark, path, big)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    df = spark.read.parquet(path) if plain else history.read_history(spark, path)
    bounds = df.where("date = DATE '2024-01-02'").groupBy(F.input_file_name().alias("file")).agg(F.min("ticker").alias("low"), F.max("ticker").alias("high")).orderBy("low").collect()
    assert len(bounds) >= 3 and all(a["high"] < b["low"] for a, b in zip(bounds, bounds[1:], strict=False))
    found = ranking.trajectory(df, "T012345")
    assert found.count() == 1
    plan = df.where("ticker = 'T012345'")
    plan.collect()
    read = int(plan._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value())
    assert 0 < read <= 20_000  # row groups of other ranges are skipped by their statistics


def test_series_from_sums(spark, tmp_path):
    """After a build, appends and a late date, the series of the sums are those of the whole history, which is not read for them."""
    path = f"{tmp_path}/history"
    whole = snap(spark, SF).select("date", "ticker", "sector", "rs", "percentile", "price").persist()
    days = sorted(r[0] for r in whole.select("date").distinct().collect())
    cut, late = days[len(days) // 2], days[3]
    history.replace_dates(spark, path, whole.where((F.col("date") <= F.lit(cut)) & (F.col("date") != F.lit(late))))
    history.append(spark, path, whole.where(F.col("date") > F.lit(cut)), "ticker")
    history.append(spark, path, whole.where(F.col("date") == F.lit(late)), "ticker", lateness=10_000)
    changed = whole.where(F.col("date") == F.lit(days[-1])).withColumn("rs", F.col("rs") + 1)
    history.append(spark, path, changed, "ticker", lateness=1)
    now = history.read_history(spark, path)
    sums = versions.daily(spark, path)
    assert not any(f"date={days[0]}" in x for x in sums.inputFiles()) and sums.count() < whole.count()
    series = metrics.series_of_sums(sums)
    full = metrics.by_date(now, avg_percentile=metrics.exact_mean(F.col("percentile")), n_tickers=F.count_distinct("ticker"), avg_price=F.round(F.avg("price"), 6), avg_rs=metrics.exact_mean(F.col("rs")), max_rs=F.max("rs"))
    columns = ["date", "avg_percentile", "n_tickers", "avg_price", "avg_rs", "max_rs"]
    assert rows(series.withColumn("avg_price", F.round("avg_price", 6)).select(columns)) == rows(full.select(columns))
    assert rows(metrics.trend_of_sums(sums, "PROMO")) == rows(metrics.sector_trend(now, "PROMO")) and rows(metrics.trend_of_sums(sums)) == rows(metrics.sector_trend(now))
    whole.unpersist()


def test_nothing_to_change(spark, tmp_path):
    path = f"{tmp_path}/history"
    assert history.replace_dates(spark, path, day(spark, 1, 1).limit(0)) == 0 and history.read_history(spark, path) is None
    history.replace_dates(spark, path, day(spark, 1, 1))
    assert history.append(spark, path, day(spark, 1, 1).limit(0), "ticker").state == "current" and versions.numbers(spark, path) == [1]
