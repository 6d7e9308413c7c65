"""Micro-fixtures for the behaviour of operators, sources, sinks, histories and streams."""

import datetime as dt
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.schema import INDUSTRY_NAMES, STOCK_NAMES
from tidemark.operators import filters, industry, metrics, ranking, snapshot, table
from tidemark.plans import history
from tidemark.sources import commits, files, sinks, versions
from tidemark.streaming import append as stream

D = dt.date


def rows(df):
    return [tuple(r) for r in df.collect()]


def stocks(spark, data):
    return spark.createDataFrame(data, "date date, ticker string, sector string, industry string, rs double, percentile double, price double, p1m double")


DATA = [
    (D(2024, 1, 1), "A", "Tech", "Chips", 10.0, 50.0, 5.0, 99.0), (D(2024, 1, 2), "A", "Tech", "Chips", 30.0, 60.0, 6.0, 75.0), (D(2024, 1, 2), "A", "Tech", "Chips", 40.0, 60.0, 6.0, 50.0),
    (D(2024, 1, 1), "B", "Old", None, 90.0, 95.0, 7.0, 25.0), (D(2024, 1, 2), "C", "New", "Oil", None, None, None, None), (D(2024, 1, 2), "D", None, "Oil", 5.0, 9.0, 1.0, 1.0),
]


def test_numbers(spark):
    given = ["1", " 2 ", "1e3", "inf", "nan", "", "N/A", "1,000", "5%", "0x10", "1d", "2f", "-", None, ".5", "-3."]
    got = spark.createDataFrame([(x,) for x in given], "x string").select(C.number(F.col("x")))
    assert [r[0] for r in got.collect()] == [1.0, 2.0, 1000.0, float("inf"), None, None, None, None, None, None, None, None, None, None, 0.5, -3.0]


def test_rounding_ranks_and_deltas(spark):
    got = spark.createDataFrame([(x,) for x in (0.5, 1.5, 2.5, -0.5, None)], "x double").select(C.whole(F.col("x")))
    assert [r[0] for r in got.collect()] == [0, 2, 2, 0, None]
    ranks = C.with_ranks(stocks(spark, DATA)).select("p1m", "r1m").where("p1m IS NOT NULL").distinct()
    assert dict(rows(ranks)) == {99.0: 2.0, 75.0: 26.0, 50.0: 51.0, 25.0: 76.0, 1.0: 100.0}
    ind = spark.createDataFrame([("X", 1.0, 35.0, 40.0, 30.0), ("Y", 2.0, 40.0, 30.0, None)], "industry string, rank double, r1m double, r3m double, r6m double")
    assert rows(industry.deltas(ind).select("industry", "delta_1m_3m", "delta_1m_6m", "class_1m_3m", "class_1m_6m").orderBy("industry")) == [("X", 5, -5, "green", "red"), ("Y", -10, None, "red", "")]
    assert industry.deltas(ind.select("industry", "rank")).columns == ["rank", "industry"]


def test_formats(spark):
    df = spark.createDataFrame([("AEHR, TRT,,ASYS,a,b,c", 1234567890123.0), (None, None)], "t string, m double")
    assert rows(df.select(C.first_listed(F.col("t")), C.billions(F.col("m")))) == [("AEHR, TRT, ASYS, a, b", "$1234.57B"), ("", "N/A")]
    lines = spark.createDataFrame([("h|2024-01-02|a|b",), ("h|2024-01-02|",), ("",)], "x string")
    assert rows(lines.select(C.commit_fields(F.col("x")).alias("c")).select("c.*")) == [("h", D(2024, 1, 2), "a|b"), ("h", D(2024, 1, 2), ""), ("", None, "")]


def test_metrics_and_labels(spark):
    df = spark.createDataFrame([(1234567.0, 0.25), (None, None), (-5.0, 0.75)], "n double, x double")
    assert rows(df.select(C.metric(F.col("n")), C.metric(F.col("x"), 1), C.metric(F.col("n"), 2, "$"))) == [("1,234,567", "0.2", "$1234567.00"), ("N/A", "N/A", "N/A"), ("-5", "0.8", "$-5.00")]
    assert rows(df.select(C.group_label(F.lit("Oil"), F.lit(3), F.col("n")))) == [("Oil (3 tickers) | RS: 1234567.0",), ("Oil (3 tickers) | RS: N/A",), ("Oil (3 tickers) | RS: -5.0",)]


def test_filters(spark):
    df = stocks(spark, DATA)
    assert filters.FilterSpec().apply(df).count() == 5  # the default minima drop nulls
    assert filters.FilterSpec(sectors=()).apply(df).count() == 0
    assert filters.FilterSpec(sectors=("Tech",), min_percentile=60).apply(df).count() == 2
    assert filters.between(df, D(2024, 1, 1), None).count() == 6
    assert filters.last_days(df, 0).count() == 4 and filters.last_days(df.limit(0)).count() == 0
    assert filters.after(df, None).count() == 6 and filters.after(df, D(2024, 1, 1)).count() == 4
    assert rows(filters.options(df, "sector")) == [("New",), ("Old",), ("Tech",)]


def test_search_and_ranges(spark):
    df = spark.createDataFrame([("BRK.A", 1.0, None), ("BRKXA", 2.0, 1.0), (None, 3.0, 2.0)], "ticker string, x double, y double")
    assert filters.search(df, "k.a").count() == 2 and filters.search(df, "k.a", literal=True).count() == 1 and filters.search(df, " ").count() == 3
    with pytest.raises(Exception):
        filters.search(df, "(")
    found = filters.numeric_ranges(df)
    assert found == {"x": (1.0, 3.0), "y": (1.0, 2.0)}
    assert filters.in_ranges(df, found).count() == 3 and filters.in_ranges(df, found, compat=True).count() == 2 and filters.in_ranges(df, {"x": (1, 2)}).count() == 2


def test_keep_first(spark):
    df = stocks(spark, DATA)
    newest = {r["ticker"]: (r["date"], r["rs"]) for r in snapshot.latest_per_ticker(df).collect()}
    assert newest["A"] == (D(2024, 1, 2), 40.0)
    assert {r["ticker"]: r["rs"] for r in snapshot.latest_per_ticker(df, compat_ascending=True).collect()}["A"] == 10.0
    assert [r["rs"] for r in snapshot.recent(df, "A", 2).collect()][-1] in (30.0, 40.0)


def test_aggregates(spark):
    df = stocks(spark, DATA)
    assert rows(metrics.overview(df)) == [(6, 35.0, 54.8, 5.0, 2, 4)]
    assert rows(metrics.sector_counts(df)) == [("New", 1), ("Old", 1), ("Tech", 1)]
    assert rows(metrics.describe(df.where("ticker = 'D'"), ["rs"])) == [("rs", 1, 5.0, None, 5.0, 5.0, 5.0, 5.0, 5.0)]
    assert sum(r["n"] for r in metrics.histogram(df, "rs", 7).collect()) == 5
    assert rows(metrics.histogram(df.where("ticker = 'D'"), "rs")) == [(0, 5.0, 5.0, 1)] and metrics.histogram(df.limit(0), "rs").count() == 0
    assert rows(ranking.sector_momentum(df)) == [("Tech", 25.0), ("New", None), ("Old", None)]
    assert rows(ranking.top_gainers(df)) == [("A", "Tech", 30.0)]
    assert [r["ticker"] for r in ranking.top_k(df, "rs", 6).collect()][-1] == "C"


def test_industry_lists(spark):
    df = stocks(spark, DATA).where("date = DATE '2024-01-02'")
    ind = spark.createDataFrame([("Chips", 3.0, 1, "Z"), ("Gone", 9.0, 2, " x , y"), ("None", None, 3, None)], "industry string, rs double, rank int, tickers string")
    assert dict(rows(industry.rotation(ind, df).select("industry", "top_tickers"))) == {"Chips": "A", "Gone": "x, y", "None": ""}
    top = industry.grouped_top(df, ind, 10)
    lists = industry.lists_by_industry(top).orderBy("place")
    assert rows(lists.select("place", "industry", "industry_rs", "tickers")) == [(1, "Chips", 3.0, "A"), (2, "Oil", None, "D,C")]
    assert rows(industry.whole_list(top)) == [("A,D,C", 3)]


def test_table(spark):
    df = table.latest_table(stocks(spark, DATA))
    shown = table.numbered(table.chosen(df, ("ticker", "rs", "nope")), "rs")
    assert [r[0] for r in shown.collect()] == [1, 2, 3, 4] and shown.orderBy("row_num").collect()[-1]["ticker"] == "C"
    with pytest.raises(ValueError):
        table.chosen(df, ("nope",))
    assert table.company(stocks(spark, DATA).withColumn("market_cap", F.lit(2.5e9)), "A").first()["market_cap"] == "$2.50B"


def test_files(spark, tmp_path):
    (tmp_path / "rs_stocks_1.csv").write_text('Ticker,Relative Strength,Price\nNA,1.5,2\nNULL,x,3\n"A,B",2,\n')
    (tmp_path / "rs_stocks_2.csv").write_text("Price,Ticker,RevenueGrowth,Relative Strength\n9,Q,7%,4\n")
    (tmp_path / "rs_stocks_3.csv").write_text("")
    df, bad = files.read_all(spark, f"{tmp_path}/rs_stocks*.csv")
    assert bad == ["rs_stocks_3.csv"]
    got = {r["ticker"]: (r["rs"], r["price"], r["source_file"]) for r in df.collect()}
    assert got == {"NA": (1.5, 2.0, "rs_stocks_1.csv"), "NULL": (None, 3.0, "rs_stocks_1.csv"), "A,B": (2.0, None, "rs_stocks_1.csv"), "Q": (4.0, 9.0, "rs_stocks_2.csv")}
    assert {r["ticker"] for r in files.read_all(spark, f"{tmp_path}/rs_stocks_1.csv", compat_na_tokens=True)[0].collect()} == {None, "A,B"}
    assert files.load_stocks(spark, str(tmp_path)).count() == 4 and files.load_stocks(spark, str(tmp_path / "none")) is None
    (tmp_path / "rs_stocks_historical.csv").write_text("Ticker,date\nA,2024-01-02 00:00:00\n")
    assert rows(files.load_stocks(spark, str(tmp_path)).select("ticker", "date", "source_file")) == [("A", D(2024, 1, 2), "stocks_historical")]
    (tmp_path / "rs_industries_historical.csv").write_text("Industry,Rank,date\nX,1,2024-01-01\nX,2,2024-01-02\nX,2,2024-01-02\n")
    assert rows(files.load_industries(spark, str(tmp_path)).select("industry", "rank")) == [("X", 2.0)]
    cache = files.Cache(spark)
    first = cache.get(str(tmp_path), files.load_stocks)
    (tmp_path / "rs_stocks_4.csv").write_text("Price,Ticker,RevenueGrowth,Relative Strength\n1,R,2,3\n")
    grouped = files.read_all(spark, f"{tmp_path}/rs_stocks_[1-4].csv")[0]
    assert grouped._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2  # one scan for each header
    assert {(r["ticker"], r["source_file"]) for r in grouped.where("ticker IN ('Q', 'R')").collect()} == {("Q", "rs_stocks_2.csv"), ("R", "rs_stocks_4.csv")}
    (tmp_path / "rs_stocks_4.csv").unlink()
    assert cache.get(str(tmp_path), files.load_stocks) is first and "rs_stocks_1.csv:" in files.signature(spark, str(tmp_path))
    (tmp_path / "rs_stocks_historical.csv").unlink()
    assert cache.get(str(tmp_path), files.load_stocks) is not first
    cache.clear()
    assert files.empty(None) and not files.empty(df)
    assert set(INDUSTRY_NAMES.values()) - set(STOCK_NAMES.values()) == {"tickers"}


class Repo:
    """A git repository of test files."""

    def __init__(self, folder):
        self.folder = folder
        folder.mkdir(exist_ok=True)
        self.git("init", "-q")

    def git(self, *args, day="2024-01-01"):
        env = {"GIT_AUTHOR_DATE": f"{day}T12:00:00", "GIT_COMMITTER_DATE": f"{day}T12:00:00", "PATH": "/usr/bin:/bin", "HOME": str(self.folder)}
        subprocess.run(["git", "-C", str(self.folder), "-c", "user.name=t", "-c", "user.email=t@example.org", *args], check=True, capture_output=True, env=env)

    def commit(self, day, message, **texts):
        for name, text in texts.items():
            (self.folder / f"{name}.csv").write_text(text)
        self.git("add", ".", day=day)
        self.git("commit", "-q", "--allow-empty", "-m", message, day=day)
        return self


def test_commits(spark, tmp_path):
    Repo(tmp_path).commit("2024-01-01", "one | bar", a="Ticker\nA\n").commit("2024-01-02", "two", a="Ticker\n", b="Ticker\nB\n")
    assert [(d, m) for _, d, m in commits.log(str(tmp_path))] == [(D(2024, 1, 2), "two"), (D(2024, 1, 1), "one | bar")]
    assert commits.log(str(tmp_path / "none")) == []
    got = commits.snapshots(spark, str(tmp_path), ["a.csv", "b.csv"])
    assert sorted(rows(got.select("date", "file"))) == [(D(2024, 1, 1), "a.csv"), (D(2024, 1, 2), "a.csv"), (D(2024, 1, 2), "b.csv")]
    assert sorted(rows(commits.first_available(got).select("date", "file"))) == [(D(2024, 1, 1), "a.csv"), (D(2024, 1, 2), "b.csv")]
    assert [r["date"] for r in commits.snapshots(spark, str(tmp_path), ["b.csv"], D(2024, 1, 1)).collect()] == [D(2024, 1, 2)]
    assert not commits.upstream_ahead(str(tmp_path), "main")


def test_remote_ahead(tmp_path):
    far = Repo(tmp_path / "far").commit("2024-01-01", "one")
    far.git("branch", "-M", "main")
    far.git("clone", "-q", str(far.folder), str(tmp_path / "near"))
    far.commit("2024-01-02", "two")
    assert not commits.upstream_ahead(str(tmp_path / "near"), "main")
    far.git("-C", str(tmp_path / "near"), "fetch", "-q")
    assert commits.upstream_ahead(str(tmp_path / "near"), "main")


def test_parsed(spark):
    long = ",".join(f"T{i}" for i in range(5000))
    texts = [
        ("a", "\ufeffTicker,Sector,Price,date\r\nA,\"x, \"\"y\"\"\",1.5,1999-01-01\r\n\r\nNA,,N/A,\r\nshort\r\n"), ("b", 'Price,Ticker\n2,"two\nlines"\n3,C,extra'),
        ("c", f'Ticker,Sector\nL,"{long}"'), ("no records", "Ticker\n"), ("unknown", "x,y\n1,2"), ("open quote", 'Ticker\n"A\nB'), ("empty", ""), ("null", None),
    ]
    df = files.parsed(spark.createDataFrame(texts, "name string, content string").withColumn("date", F.lit(D(2024, 1, 1))))
    got = sorted(rows(df.select("name", "line", "ticker", "sector", "price")))
    assert got == [("a", 1, "A", 'x, "y"', 1.5), ("a", 2, "NA", None, None), ("a", 3, "short", None, None), ("b", 1, "two\nlines", None, 2.0), ("b", 2, "C", None, 3.0), ("c", 1, "L", long, None), ("open quote", 2, "B", None, None)]
    assert {r["date"] for r in df.collect()} == {D(2024, 1, 1)}
    own = files.parsed(spark.createDataFrame(texts[:1], "name string, content string"), compat_na_tokens=True)
    assert rows(own.select("ticker", "date")) == [("A", D(1999, 1, 1)), (None, None), ("short", None)]


STOCKS = ["s1.csv", "s2.csv"]


def test_history_of_commits(spark, tmp_path):
    """A whole build equals the build of a prefix and the append of the rest; every exit state."""
    repo = Repo(tmp_path / "repo")
    where, whole, grown = str(repo.folder), f"{tmp_path}/whole", f"{tmp_path}/grown"
    assert history.build_from_commits(spark, where, whole, STOCKS, "ticker").state == "current"
    repo.commit("2024-01-01", "none yet", other="x\n")
    assert history.build_from_commits(spark, where, whole, STOCKS, "ticker").state == "no file"
    assert history.append_from_commits(spark, where, grown, STOCKS, "ticker").state == "missing"
    repo.commit("2024-01-02", "one", s1="Ticker,1M_RS_Percentile\nA,99\nA,98\n", s2="Ticker,Price\nA,7\nB,8\n")
    assert history.build_from_commits(spark, where, grown, STOCKS, "ticker") == history.Appended("built", 2)
    assert history.append_from_commits(spark, where, grown, STOCKS, "ticker").state == "current"
    repo.commit("2024-01-03", "early", s1="Ticker,Price\nA,1\nC,3\n").commit("2024-01-03", "late", s1="Ticker,Price\nA,2\n").commit("2024-01-04", "next", s1="Price,Ticker\n5,A\n")
    assert history.append_from_commits(spark, where, grown, STOCKS, "ticker") == history.Appended("appended", 5, D(2024, 1, 2))
    repo.commit("2024-01-05", "bad", s1="", s2='Ticker\n"A\n')
    assert history.append_from_commits(spark, where, grown, STOCKS, "ticker") == history.Appended("no file", 0, D(2024, 1, 4))
    assert history.build_from_commits(spark, where, whole, STOCKS, "ticker").rows == 7
    shown = [sorted(map(repr, rows(history.read_history(spark, p).select("date", "ticker", "price", "p1m", "r1m", "commit_hash")))) for p in (whole, grown)]
    assert shown[0] == shown[1]
    got = {(r["date"].day, r["ticker"]): (r["price"], r["r1m"]) for r in history.read_history(spark, grown).collect()}
    assert got == {(2, "A"): (None, 2.0), (2, "B"): (8.0, None), (3, "A"): (2.0, None), (3, "B"): (8.0, None), (3, "C"): (3.0, None), (4, "A"): (5.0, None), (4, "B"): (8.0, None)}
    old = [(r["date"].day, r["ticker"], r["price"]) for r in history.build_legacy(spark, where, STOCKS).collect()]
    assert old[:2] == [(2, "A", None), (2, "A", None)] and [r for r in old if r[0] == 3] == [(3, "A", 1.0), (3, "C", 3.0), (3, "A", 2.0)]


def test_append_survives_failure(spark, tmp_path, monkeypatch):
    """A write that fails when all files are there but the version is not, be it the first or a later one, changes nothing and can be made again."""
    days = [stocks(spark, [(D(2024, 1, n), "A", "s", "i", float(n), 1.0, 1.0, 1.0)]) for n in (1, 2, 3, 4)]
    path, publish = f"{tmp_path}/history", versions._publish

    def lost(*_):
        raise OSError("lost")

    monkeypatch.setattr(versions, "_publish", lost)
    with pytest.raises(OSError):
        history.replace_dates(spark, path, history.build(days[:2], "ticker"))
    assert history.read_history(spark, path) is None
    monkeypatch.setattr(versions, "_publish", publish)
    history.replace_dates(spark, path, history.build(days[:2], "ticker"))
    monkeypatch.setattr(versions, "_publish", lost)
    with pytest.raises(OSError):
        history.append(spark, path, files.union(days[2:]), "ticker")
    assert sorted(r["rs"] for r in history.read_history(spark, path).collect()) == [1.0, 2.0]
    monkeypatch.setattr(versions, "_publish", publish)
    assert history.append(spark, path, files.union(days[:2]), "ticker").state == "current"
    history.append(spark, path, files.union(days[2:]), "ticker")
    assert sorted(r["rs"] for r in history.read_history(spark, path).collect()) == [1.0, 2.0, 3.0, 4.0]
    assert versions.vacuum(spark, path, keep=1, hours=0) == 2 and history.read_history(spark, path).count() == 4


def test_sinks(spark, tmp_path):
    df = stocks(spark, DATA)
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 6
    many = spark.range(3000).select((F.col("id") * 7 % 3000).alias("n")).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for one in (False, True):
        sinks.write_csv(many, f"{tmp_path}/ordered", [F.col("n").desc()], one)
        parts = sorted((tmp_path / "ordered").glob("part-*.csv"))
        assert (len(parts) == 1) == one and [int(x) for p in parts for x in p.read_text().splitlines()[1:]] == list(range(2999, -1, -1))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lists = spark.createDataFrame([("X_tickers.txt", "A,B"), ("Y_tickers.txt", "C")], "file_name string, tickers string")
    sinks.write_lists(lists, f"{tmp_path}/lists")
    assert spark.read.text(f"{tmp_path}/lists/file_name=X_tickers.txt").first()[0] == "A,B"
    made = sinks.write_metadata(df, f"{tmp_path}/meta", "ticker", files_processed=2)
    assert {k: made[k] for k in ("total_records", "unique_dates", "unique_tickers", "date_min", "files_processed")} == {"total_records": 6, "unique_dates": 2, "unique_tickers": 4, "date_min": "2024-01-01", "files_processed": 2}
    assert sinks.read_metadata(spark, f"{tmp_path}/meta") == json.loads(json.dumps(made))


def test_history(spark, tmp_path):
    path = f"{tmp_path}/history"
    first, rest = stocks(spark, DATA).where("date = DATE '2024-01-01'"), stocks(spark, DATA).where("date = DATE '2024-01-02'")
    assert history.append(spark, path, first, "ticker").state == "missing"
    sinks.write_history(history.build([first], "ticker"), path)
    assert history.append(spark, path, first, "ticker").state == "current"
    done = history.append(spark, path, rest, "ticker")
    assert (done.state, done.rows, done.cutoff) == ("appended", 3, D(2024, 1, 1))
    whole = sorted(map(repr, rows(history.build([first, rest], "ticker").select("date", "ticker", "rs", "r1m"))))
    assert sorted(map(repr, rows(history.read_history(spark, path).select("date", "ticker", "rs", "r1m")))) == whole
    assert history.append(spark, path, rest, "ticker").state == "current"
    late = rest.where("ticker = 'D'").withColumn("rs", F.lit(6.0))
    assert history.append(spark, path, late, "ticker", lateness=1).rows == 3
    assert sorted(r["rs"] for r in history.read_history(spark, path).where("ticker = 'D'").collect()) == [6.0]
    assert history.high_water_mark(history.read_history(spark, path)) == D(2024, 1, 2)


def test_stream_equals_batch(spark, tmp_path):
    names = {"Ticker": "ticker", "Relative Strength": "rs", "1M_RS_Percentile": "p1m"}
    landed, path = f"{tmp_path}/landed", f"{tmp_path}/history"
    raw = stocks(spark, DATA).select("date", F.col("ticker").alias("Ticker"), F.col("rs").cast("string").alias("Relative Strength"), F.col("p1m").cast("string").alias("1M_RS_Percentile"))
    for day in ("2024-01-01", "2024-01-02"):
        raw.where(F.col("date") == F.lit(day)).coalesce(1).write.mode("append").parquet(landed)
        stream.run(stream.landed(spark, landed, raw.schema, names), path, f"{tmp_path}/checkpoint", "ticker").awaitTermination()
    batch = history.build([C.coerced(raw.withColumnsRenamed(names))], "ticker").select("date", "ticker", "rs", "r1m")
    assert sorted(map(repr, rows(history.read_history(spark, path).select("date", "ticker", "rs", "r1m")))) == sorted(map(repr, rows(batch)))


def test_stream_by_interval(spark, tmp_path):
    """ST2: a query that runs on takes what lands between its triggers."""
    landed, path = f"{tmp_path}/landed", f"{tmp_path}/history"
    raw = stocks(spark, DATA).select("date", F.col("ticker").alias("Ticker"))
    days = [raw.where(F.col("date") == F.lit(f"2024-01-0{n}")).coalesce(1) for n in (1, 2)]
    days[0].write.parquet(landed)
    running = stream.run(stream.landed(spark, landed, raw.schema, {"Ticker": "ticker"}), path, f"{tmp_path}/checkpoint", "ticker", once=False, every="1 second")
    try:
        running.processAllAvailable()
        assert history.read_history(spark, path).count() == 2
        days[1].write.mode("append").parquet(landed)
        running.processAllAvailable()
    finally:
        running.stop()
    assert sorted(rows(history.read_history(spark, path).select("date", "ticker"))) == sorted({(r[0], r[1]) for r in DATA})
