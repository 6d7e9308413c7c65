"""The registered queries and their SQL. A query's tags are the operators that it uses."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import filters, industry, metrics, numbering, ranking, snapshot, table
from tidemark.plans import history
from tidemark.operators.steps import shared_folder
from tidemark.plans.views import EV, IND, SNAP, ev, ind, snap
from tidemark.sources import commits, sinks, versions
from tidemark.sources.files import load_stocks, parsed, read_all, records, union
from tidemark.streaming import append as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TICKER = "7"
MEAN = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE) / count({0})"
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, rs DESC) AS rn FROM snap) WHERE rn = 1)"
NEWEST = "newest AS (SELECT * FROM snap WHERE date = (SELECT max(date) FROM snap))"


def query(sql: str = "", *views: str):
    """Register a function of (spark, sf_dir) under its name, with SQL over the named views."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (f"WITH {', '.join(v.strip() for v in views)} " if views else "") + sql.strip()
        return f

    return register


@query(f"SELECT count(*) AS n_rows, {MEAN.format('rs')} AS avg_rs, {MEAN.format('percentile')} AS avg_percentile, round(avg(price), 4) AS avg_price, count(DISTINCT date) AS n_dates, count(DISTINCT ticker) AS n_tickers FROM snap", SNAP)
def overview_metrics(spark, sf_dir):
    """A01 A02 A03"""
    return metrics.overview(snap(spark, sf_dir)).withColumn("avg_price", F.round("avg_price", 4))


@query("SELECT date, ticker, sector, rs, ordinal FROM ev WHERE date BETWEEN (SELECT max(date) FROM ev) - INTERVAL 7 DAY AND (SELECT max(date) FROM ev)", EV)
def date_range_filter(spark, sf_dir):
    """F01 P21"""
    return filters.last_days(ev(spark, sf_dir), 7).select("date", "ticker", "sector", "rs", "ordinal")


@query("SELECT date, ticker, sector, rs, percentile FROM snap WHERE sector IN ('PROMO', 'SMALL') AND percentile >= 50 AND rs >= 30000 AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'", SNAP)
def sidebar_filter_chain(spark, sf_dir):
    """F01 F03 F04 F05"""
    spec = filters.FilterSpec(dt.date(1996, 1, 1), dt.date(1999, 12, 31), sectors=("PROMO", "SMALL"), min_percentile=50, min_rs=30000)
    return spec.apply(snap(spark, sf_dir)).select("date", "ticker", "sector", "rs", "percentile")


@query("SELECT ticker, date, sector, industry, rs, price, percentile FROM latest", SNAP, LATEST)
def latest_per_ticker(spark, sf_dir):
    """W01 T4 T5"""
    return snapshot.latest_per_ticker(snap(spark, sf_dir)).select("ticker", "date", "sector", "industry", "rs", "price", "percentile")


@query("SELECT sector, count(*) AS n_stocks FROM latest GROUP BY sector ORDER BY n_stocks DESC, sector LIMIT 10", SNAP, LATEST)
def sector_counts_top10(spark, sf_dir):
    """W01 A05 O06"""
    return metrics.sector_counts(snap(spark, sf_dir))


@query(f"SELECT sector, {MEAN.format('rs')} AS avg_rs FROM latest GROUP BY sector ORDER BY avg_rs DESC, sector LIMIT 10", SNAP, LATEST)
def sector_avg_rs_top10(spark, sf_dir):
    """W01 A04 O06"""
    return metrics.sector_means(snap(spark, sf_dir))


@query(f"SELECT date, {MEAN.format('rs')} AS mean_rs, median(rs) AS median_rs, max(rs) AS max_rs FROM snap GROUP BY date", SNAP)
def daily_rs_stats(spark, sf_dir):
    """A06"""
    return metrics.daily_strength(snap(spark, sf_dir))


@query(f"SELECT date, {MEAN.format('percentile')} AS avg_percentile FROM snap GROUP BY date", SNAP)
def daily_percentile_avg(spark, sf_dir):
    """A07"""
    return metrics.by_date(snap(spark, sf_dir), avg_percentile=C.exact_mean(F.col("percentile")))


@query("SELECT date, count(DISTINCT ticker) AS n_tickers FROM snap GROUP BY date", SNAP)
def daily_universe_size(spark, sf_dir):
    """A08"""
    return metrics.by_date(snap(spark, sf_dir), n_tickers=F.count_distinct("ticker"))


@query("SELECT date, round(avg(price), 4) AS avg_price FROM snap GROUP BY date", SNAP)
def daily_avg_price(spark, sf_dir):
    """A09"""
    return metrics.by_date(snap(spark, sf_dir), avg_price=F.round(F.avg("price"), 4))


@query(f"SELECT sector, date, {MEAN.format('rs')} AS mean_rs, min(rs) AS min_rs, max(rs) AS max_rs FROM snap WHERE sector = 'PROMO' GROUP BY sector, date", SNAP)
def sector_trend(spark, sf_dir):
    """F10 A10"""
    return metrics.sector_trend(snap(spark, sf_dir), "PROMO")


def _top(column: str, shown: str) -> str:
    return f"SELECT {shown} FROM latest ORDER BY {column} DESC, ticker LIMIT 15"


@query(_top("rs", "rank, ticker, sector, rs, percentile, price"), SNAP, LATEST)
def top15_rs(spark, sf_dir):
    """W01 O03"""
    return ranking.top_performers(snap(spark, sf_dir), "rs", columns=["rank", "ticker", "sector", "rs", "percentile", "price"])


@query(_top("percentile", "rank, ticker, sector, percentile, rs, price"), SNAP, LATEST)
def top15_percentile(spark, sf_dir):
    """W01 O03"""
    return ranking.top_performers(snap(spark, sf_dir), "percentile", columns=["rank", "ticker", "sector", "percentile", "rs", "price"])


@query("SELECT ticker, sector, '$' || printf('%.2f', market_cap / 1e9) || 'B' AS market_cap, rs, percentile FROM (SELECT * FROM latest ORDER BY market_cap DESC, ticker LIMIT 15)", SNAP, LATEST)
def top15_marketcap(spark, sf_dir):
    """W01 O03 P13"""
    top = ranking.top_performers(snap(spark, sf_dir), "market_cap", columns=["ticker", "sector", "market_cap", "rs", "percentile"])
    return top.withColumn("market_cap", C.billions(F.col("market_cap")))


@query(_top("p6m", "ticker, p6m AS m6, p3m AS m3, p1m AS m1"), SNAP, LATEST)
def top15_6m(spark, sf_dir):
    """W01 O03 P03"""
    return ranking.top_performers(snap(spark, sf_dir), "p6m", columns=["ticker", "p6m", "p3m", "p1m"]).withColumnsRenamed({"p6m": "m6", "p3m": "m3", "p1m": "m1"})


@query(" UNION ALL ".join(f"SELECT '{h}' AS horizon, {MEAN.format(c)} AS mean_percentile FROM snap" for h, c in (("1M", "p1m"), ("3M", "p3m"), ("6M", "p6m"))), SNAP)
def horizon_percentile_means(spark, sf_dir):
    """A11"""
    return metrics.horizon_means(snap(spark, sf_dir))


DESCRIBED = ("rs", "percentile", "p1m", "p3m", "p6m", "price", "avg_vol", "short_float_pct", "pct_from_high", "revenue_growth")
_stats = "SELECT '{0}' AS metric, count({0}) AS n, round(avg({0}), 3) AS mean, round(stddev_samp({0}), 3) AS std, CAST(min({0}) AS DOUBLE) AS min, round(quantile_cont({0}, 0.25), 3) AS q25, round(quantile_cont({0}, 0.5), 3) AS q50, round(quantile_cont({0}, 0.75), 3) AS q75, CAST(max({0}) AS DOUBLE) AS max FROM wide"


@query(" UNION ALL ".join(_stats.format(c) for c in DESCRIBED), SNAP, "wide AS (SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in DESCRIBED) + " FROM snap)")
def describe_stats(spark, sf_dir):
    """A12"""
    got = metrics.describe(snap(spark, sf_dir, spread=True), list(DESCRIBED))
    return got.withColumns({c: F.round(c, 3) for c in ("mean", "std", "q25", "q50", "q75")})


def _histogram(name: str, column: str, bins: int) -> None:
    sql = f"""
    , b AS (SELECT min(CAST({column} AS DOUBLE)) AS lo, (max(CAST({column} AS DOUBLE)) - min(CAST({column} AS DOUBLE))) / {bins} AS w FROM snap)
    SELECT bin, lo + bin * w AS bin_start, lo + (bin + 1) * w AS bin_end, count(*) AS n
    FROM (SELECT CAST(least(floor((CAST({column} AS DOUBLE) - lo) / w), {bins - 1}) AS INTEGER) AS bin, lo, w FROM snap, b WHERE {column} IS NOT NULL) GROUP BY bin, lo, w"""

    def run(spark, sf_dir):
        return metrics.histogram(snap(spark, sf_dir), column, bins)

    run.__name__, run.__doc__ = name, "F14 A13"
    query(sql, SNAP)(run)


for _name, _column, _bins in (("hist_rs_50", "rs", 50), ("hist_percentile_50", "percentile", 50), ("hist_price_50", "price", 50), ("hist_shortfloat_50", "short_float_pct", 50), ("hist_pct_high_40", "pct_from_high", 40)):
    _histogram(_name, _column, _bins)


@query("SELECT price, rs, percentile, ticker, sector FROM snap", SNAP)
def scatter_rs_price(spark, sf_dir):
    """P24"""
    return snap(spark, sf_dir).select("price", "rs", "percentile", "ticker", "sector")


@query("SELECT revenue_growth, rs, percentile, ticker, sector FROM snap WHERE revenue_growth IS NOT NULL", SNAP)
def scatter_growth_rs(spark, sf_dir):
    """P24 F14"""
    return filters.not_null(snap(spark, sf_dir), "revenue_growth").select("revenue_growth", "rs", "percentile", "ticker", "sector")


@query(f"SELECT sector, n.m - o.m AS rs_change FROM (SELECT sector, {MEAN.format('rs')} AS m FROM newest GROUP BY sector) n FULL JOIN (SELECT sector, {MEAN.format('rs')} AS m FROM snap WHERE date = (SELECT min(date) FROM snap) GROUP BY sector) o USING (sector)", SNAP, NEWEST)
def sector_momentum(spark, sf_dir):
    """F07 F08 J02 W07 O10 A19"""
    return ranking.sector_momentum(snap(spark, sf_dir))


@query("SELECT n.ticker, n.sector, n.rs - o.rs AS rs_change FROM newest n JOIN snap o ON n.ticker = o.ticker AND o.date = (SELECT min(date) FROM snap) ORDER BY rs_change DESC, n.ticker LIMIT 10", SNAP, NEWEST)
def top_gainers(spark, sf_dir):
    """J01 O04"""
    return ranking.top_gainers(snap(spark, sf_dir))


@query(f"SELECT date, rs, percentile, price, rank FROM snap WHERE ticker = '{TICKER}'", SNAP)
def ticker_trajectory(spark, sf_dir):
    """F09 W08"""
    return ranking.trajectory(snap(spark, sf_dir), TICKER)


@query(f"SELECT ticker, sector, industry, '$' || printf('%.2f', market_cap / 1e9) || 'B' AS market_cap, CAST(percentile AS VARCHAR) AS percentile, CAST(p1m AS VARCHAR) AS p1m, CAST(p3m AS VARCHAR) AS p3m, CAST(p6m AS VARCHAR) AS p6m FROM latest WHERE ticker = '{TICKER}'", SNAP, LATEST)
def ticker_latest_row(spark, sf_dir):
    """W05 P13 P14"""
    return table.company(snap(spark, sf_dir), TICKER).drop("price", "rs", "pct_from_high", "avg_vol30")


@query(f"SELECT date, price, rs, percentile FROM (SELECT * FROM snap WHERE ticker = '{TICKER}' ORDER BY date DESC LIMIT 10)", SNAP)
def ticker_recent10(spark, sf_dir):
    """W06"""
    return snapshot.recent(snap(spark, sf_dir), TICKER).select("date", "price", "rs", "percentile")


@query("SELECT industry, date, CAST(101 - p1m AS DOUBLE) AS r1m, CAST(101 - p3m AS DOUBLE) AS r3m, CAST(101 - p6m AS DOUBLE) AS r6m FROM ind", SNAP, IND)
def percentile_to_rank(spark, sf_dir):
    """P02 T17"""
    return C.with_ranks(ind(spark, sf_dir).drop("r1m", "r3m", "r6m")).select("industry", "date", "r1m", "r3m", "r6m")


_latest_ind = "li AS (SELECT * FROM ind WHERE date = (SELECT max(date) FROM ind))"
_class = "CASE WHEN {0} > 0 THEN 'green' WHEN {0} < 0 THEN 'red' ELSE 'gray' END"


def _deltas(one: str, three: str, six: str, a: str, b: str) -> str:
    shown = ", ".join(f"CAST({x} AS BIGINT) AS {n}" for x, n in (("rank", "rank"), (one, "m1"), (three, "m3"), (six, "m6"), (a, "delta_1m_3m"), (b, "delta_1m_6m")))
    return f"SELECT {shown}, industry, {_class.format(a)} AS class_1m_3m, {_class.format(b)} AS class_1m_6m FROM li"


@query(_deltas("r1m", "r3m", "r6m", "(r3m - r1m)", "(r6m - r1m)"), SNAP, IND, _latest_ind)
def industry_rank_deltas(spark, sf_dir):
    """P08 P09 P11 P12 O08 T18"""
    return industry.deltas(industry.latest_industries(ind(spark, sf_dir)))


@query(_deltas("p1m", "p3m", "p6m", "(p1m - p3m)", "(p1m - p6m)"), SNAP, IND, _latest_ind)
def industry_pct_deltas(spark, sf_dir):
    """P08 P10 P11 P12 O08"""
    return industry.deltas(industry.latest_industries(ind(spark, sf_dir).drop("r1m", "r3m", "r6m")))


@query("SELECT industry, date, rs, n, p1m, p3m, p6m, rank, tickers FROM li", SNAP, IND, _latest_ind)
def industry_latest_snapshot(spark, sf_dir):
    """F07 T21"""
    return industry.latest_industries(ind(spark, sf_dir)).select("industry", "date", "rs", "n", "p1m", "p3m", "p6m", "rank", "tickers")


_top5 = "t5 AS (SELECT industry, string_agg(ticker, ', ' ORDER BY rs DESC, ticker) AS top FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY rs DESC, ticker) AS rn FROM newest WHERE sector <> 'PROMO') WHERE rn <= 5 GROUP BY industry)"
_listed = "array_to_string(list_slice(string_split(tickers, ','), 1, 5), ', ')"


@query(f"SELECT ind.industry, date, coalesce(top, {_listed}) AS top_tickers FROM ind LEFT JOIN t5 ON ind.industry = t5.industry", SNAP, IND, NEWEST, _top5)
def industry_top5(spark, sf_dir):
    """J04 J05 W04 P18; stocks of one sector are left out, so that some industries need their own list"""
    stocks = table.latest_table(snap(spark, sf_dir)).where("sector <> 'PROMO'")
    return industry.rotation(ind(spark, sf_dir), stocks).select("industry", "date", "top_tickers")


_grouped = "g AS (SELECT s.ticker, s.industry, s.rs, li.rs AS industry_rs FROM (SELECT * FROM newest ORDER BY rs DESC, ticker LIMIT 60) s LEFT JOIN li ON s.industry = li.industry)"


@query("SELECT ticker, industry, rs, industry_rs FROM g", SNAP, IND, NEWEST, _latest_ind, _grouped)
def topn_by_industry(spark, sf_dir):
    """O05 J03 P23"""
    return industry.grouped_top(table.latest_table(snap(spark, sf_dir)), industry.latest_industries(ind(spark, sf_dir)), 60)


@query(
    "SELECT industry, industry_rs, n_tickers, tickers, CAST(row_number() OVER (ORDER BY industry_rs DESC, industry) AS INTEGER) AS place, replace(industry, ' ', '_') || '_tickers.txt' AS file_name FROM (SELECT industry, max(industry_rs) AS industry_rs, count(*) AS n_tickers, string_agg(ticker, ',' ORDER BY rs DESC, ticker) AS tickers FROM g GROUP BY industry)",
    SNAP, IND, NEWEST, _latest_ind, _grouped,
)
def grouped_ticker_list(spark, sf_dir):
    """A14 A15 O09 P22"""
    return industry.lists_by_industry(topn_by_industry(spark, sf_dir)).withColumn("place", F.col("place").cast("int"))


@query("SELECT string_agg(ticker, ',' ORDER BY industry_rs DESC, industry, rs DESC, ticker) AS tickers, count(*) AS n_tickers FROM g", SNAP, IND, NEWEST, _latest_ind, _grouped)
def whole_ticker_list(spark, sf_dir):
    """A14 K03"""
    return industry.whole_list(topn_by_industry(spark, sf_dir))


@query("SELECT ticker, rs, price FROM newest WHERE regexp_matches(upper(ticker), '1.5')", SNAP, NEWEST)
def table_search(spark, sf_dir):
    """F11 P17 T11"""
    return filters.search(table.latest_table(snap(spark, sf_dir)), " 1.5 ").select("ticker", "rs", "price")


@query("SELECT ticker, rs, price, percentile, short_float_pct FROM newest WHERE percentile BETWEEN 20 AND 80 AND price BETWEEN 950 AND 1500", SNAP, NEWEST)
def table_numeric_ranges(spark, sf_dir):
    """F12 F13 T13; the range that is as wide as the data keeps nulls"""
    rows = table.latest_table(snap(spark, sf_dir, spread=True))
    wide = filters.numeric_ranges(rows.select("short_float_pct"))
    return filters.in_ranges(rows, {"percentile": (20, 80), "price": (950, 1500), **wide}).select("ticker", "rs", "price", "percentile", "short_float_pct")


@query("SELECT CAST(row_number() OVER (ORDER BY short_float_pct DESC NULLS LAST, ticker) AS INTEGER) AS row_num, rank, ticker, industry, short_float_pct FROM newest", SNAP, NEWEST)
def table_sorted_ranked(spark, sf_dir):
    """O07 P05 P16 T12 T22"""
    shown = table.chosen(table.latest_table(snap(spark, sf_dir)), ("rank", "ticker", "industry", "short_float_pct", "not_there"))
    return table.numbered(shown, "short_float_pct", ascending=False).withColumn("row_num", F.col("row_num").cast("int"))


@query("SELECT DISTINCT 'sector' AS field, sector AS value FROM snap UNION ALL SELECT DISTINCT 'ticker', ticker FROM snap", SNAP)
def distinct_options(spark, sf_dir):
    """F16 U03"""
    rows = snap(spark, sf_dir)
    parts = [filters.options(rows, c, ordered=False).select(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("sector", "ticker")]
    return parts[0].unionByName(parts[1])


@query("SELECT date, ticker, rs, NULL AS price, 'a' AS source_file FROM snap WHERE sector = 'PROMO' UNION ALL SELECT date, ticker, rs, price, 'b' FROM snap WHERE sector = 'SMALL'", SNAP)
def history_union_drift(spark, sf_dir):
    """U01 P01 T6"""
    rows = snap(spark, sf_dir)
    a = rows.where("sector = 'PROMO'").select("date", "ticker", "rs").withColumn("source_file", F.lit("a"))
    b = rows.where("sector = 'SMALL'").select("price", "rs", "ticker", "date").withColumn("source_file", F.lit("b"))
    return union([a, b])


@query("SELECT date, ticker, sector, rs, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY (date < DATE '2024-01-20' AND ordinal % 2 = 0), ordinal DESC) AS rn FROM ev) WHERE rn = 1", EV)
def history_dedupe(spark, sf_dir):
    """Of the old rows (even, before the 20th) and the new ones, the new one stays"""
    rows = ev(spark, sf_dir).drop("ts")
    old = (F.col("date") < F.lit(dt.date(2024, 1, 20))) & (F.col("ordinal") % 2 == 0)
    return history.upserted(rows.where(~old), rows.where(old), "ticker").select("date", "ticker", "sector", "rs", "ordinal")


@query("SELECT industry, date, rs, n FROM ind", SNAP, IND)
def industry_history_dedupe(spark, sf_dir):
    """The same history twice"""
    rows = ind(spark, sf_dir)
    return history.build([rows, rows], "industry").select("industry", "date", "rs", "n")


@query("SELECT date, ticker, rs, ordinal FROM ev WHERE date > DATE '2024-01-20'", EV)
def append_after_cutoff(spark, sf_dir):
    """F02 ST3 ST4"""
    return filters.after(ev(spark, sf_dir), dt.date(2024, 1, 20)).select("date", "ticker", "rs", "ordinal")


@query("SELECT count(*) AS total_records, count(DISTINCT date) AS unique_dates, count(DISTINCT ticker) AS unique_tickers, CAST(min(date) AS VARCHAR) AS date_min, CAST(max(date) AS VARCHAR) AS date_max FROM snap", SNAP)
def dataset_metadata(spark, sf_dir):
    """A16 A18 K04"""
    return metrics.summary(snap(spark, sf_dir), "ticker")


_tokens = ("1d", "2f", "N/A", "1,000", "5%", "0x10", "-", "", "nan", "1e3", " 2 ", "+.5")
_bad = "CASE CAST(ordinal % 13 AS INTEGER) " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_tokens)) + " ELSE printf('%.2f', rs) END"


@query(f"SELECT ordinal, CASE WHEN regexp_full_match(trim(t), '[+-]?([0-9]+\\.?[0-9]*([eE][+-]?[0-9]+)?|\\.[0-9]+)') THEN CAST(trim(t) AS DOUBLE) END AS value FROM (SELECT ordinal, {_bad} AS t FROM ev)", EV)
def coerce_numeric(spark, sf_dir):
    """P07 T2 T3"""
    text = F.format_string("%.2f", F.col("rs"))
    for i, token in enumerate(_tokens):
        text = F.when(F.col("ordinal") % 13 == i, F.lit(token)).otherwise(text)
    return ev(spark, sf_dir).select("ordinal", C.number(text).alias("value"))


@query("SELECT CAST(date AS VARCHAR) AS commit_hash, file, CAST(file_num AS INTEGER) AS file_num FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY file_num) AS rn FROM (SELECT DISTINCT date, CASE sector WHEN 'SMALL' THEN 1 WHEN 'PROMO' THEN 2 ELSE 3 END AS file_num, sector AS file FROM snap WHERE (sector = 'SMALL' AND rs > 200000) OR (sector = 'PROMO' AND rs > 150000) OR sector = 'LARGE')) WHERE rn = 1", SNAP)
def first_available_source(spark, sf_dir):
    """Of each date the first of three files that has something in it"""
    rows = snap(spark, sf_dir).where("(sector = 'SMALL' AND rs > 200000) OR (sector = 'PROMO' AND rs > 150000) OR sector = 'LARGE'")
    number = F.when(F.col("sector") == "SMALL", 1).when(F.col("sector") == "PROMO", 2).otherwise(3)
    files = rows.select(F.col("date").cast("string").alias("commit_hash"), F.col("sector").alias("file"), number.alias("file_num")).distinct()
    return commits.first_available(files, F.lit(True))


@query("SELECT ordinal, ticker AS hash, date, sector || CASE WHEN ordinal % 2 = 0 THEN '|b' ELSE '' END AS message FROM ev", EV)
def commit_line_split(spark, sf_dir):
    """P19 P20 S01"""
    rows = ev(spark, sf_dir)
    line = F.concat_ws("|", "ticker", F.col("date").cast("string"), F.concat("sector", F.when(F.col("ordinal") % 2 == 0, "|b").otherwise("")))
    return rows.select("ordinal", C.commit_fields(line).alias("c")).select("ordinal", "c.*")


@query("SELECT CAST(k AS VARCHAR) AS hash, date FROM (SELECT row_number() OVER (ORDER BY date) AS k, date FROM (SELECT DISTINCT date FROM ev))", EV)
def dated_line_pairs(spark, sf_dir):
    """S02"""
    days = numbering.numbered(ev(spark, sf_dir).select("date").distinct(), [F.col("date")], "k")
    lines = days.select(F.posexplode(F.array(F.col("k").cast("string"), F.concat(F.col("date").cast("string"), F.lit(" 10:00:00 +0000")))).alias("half", "line"), "k")
    return commits.dated_lines(lines.select((F.col("k") * 2 - 2 + F.col("half")).alias("n"), "line"))


@query(f"SELECT format('{{:,}}', count(*)) AS n_rows, printf('%.1f', {MEAN.format('rs')}) AS avg_rs, printf('%.1f', {MEAN.format('percentile')}) AS avg_percentile, '$' || printf('%.2f', avg(price)) AS avg_price FROM snap", SNAP)
def overview_formatted(spark, sf_dir):
    """P15 A01 A02"""
    row = metrics.overview(snap(spark, sf_dir))
    return row.select(C.metric(F.col("n_rows")).alias("n_rows"), *[C.metric(F.col(c), 1).alias(c) for c in ("avg_rs", "avg_percentile")], C.metric(F.col("avg_price"), 2, "$").alias("avg_price"))


@query("SELECT industry, industry || ' (' || n || ' tickers) | RS: ' || CASE WHEN n % 2 = 0 THEN 'N/A' ELSE CAST(n + 0.5 AS VARCHAR) END AS label FROM ind WHERE date = (SELECT max(date) FROM ind)", SNAP, IND)
def industry_labels(spark, sf_dir):
    """Industries of an even number of tickers have no strength here"""
    rows = filters.on_newest(ind(spark, sf_dir))
    strength = F.when(F.col("n") % 2 != 0, F.col("n") + 0.5)
    return rows.select("industry", C.group_label(F.col("industry"), F.col("n"), strength).alias("label"))


@query("SELECT ticker, sector, rs, percentile FROM snap WHERE sector = 'SMALL' AND percentile >= 50 AND rs >= 30000", SNAP)
def dataset_filter(spark, sf_dir):
    """rows without dates are filtered by the file that they came from"""
    rows = snap(spark, sf_dir).drop("date").withColumn("source_file", F.concat("sector", F.lit(".csv")))
    return filters.FilterSpec(source_file="SMALL.csv", min_percentile=50, min_rs=30000).apply(rows).select("ticker", "sector", "rs", "percentile")


@query("SELECT industry, rank, rs FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY rank, rs, tickers) AS rn FROM ind) WHERE rn = 1", SNAP, IND)
def undated_industries(spark, sf_dir):
    """A17 F15"""
    return industry.latest_industries(ind(spark, sf_dir).drop("date")).select("industry", "rank", "rs")


@query("SELECT date, ticker, CASE WHEN day(date) % 2 = 0 THEN sector || ', \"x\"' END AS sector, CAST(printf('%.2f', rs) AS DOUBLE) AS rs FROM ev", EV)
def csv_text_parse(spark, sf_dir):
    """Texts of some hundred records, of two headers by turns"""
    even = F.dayofmonth("date") % 2 == 0
    record = F.when(even, F.format_string('%s,"%s, ""x""",%.2f', "ticker", "sector", "rs")).otherwise(F.format_string("%.2f,%s", "rs", "ticker"))
    rows = ev(spark, sf_dir).select("date", F.floor(F.col("ordinal") / 500).alias("file"), record.alias("record"))
    header = F.when(even, "Ticker,Sector,Relative Strength").otherwise("Relative Strength,Ticker")
    texts = rows.groupBy("date", "file").agg(F.array_join(F.collect_list("record"), "\r\n").alias("records"))
    return parsed(texts.select("date", F.concat_ws("\n", header, "records").alias("content"))).select("date", "ticker", "sector", "rs")


@query(
    """SELECT date, file, CASE WHEN bad THEN NULL ELSE ticker END AS ticker, CASE WHEN bad THEN NULL ELSE CAST(printf('%.2f', rs) AS DOUBLE) END AS rs,
      CASE WHEN bad THEN 'stray quote' END AS reason, CASE WHEN bad THEN '"' || ticker || ',' || printf('%.2f', rs) END AS record
    FROM (SELECT *, CAST(floor(ordinal / 500) AS BIGINT) AS file, ordinal % 37 = 0 AS bad FROM ev)
    UNION ALL SELECT date, -1, NULL, NULL, 'no known column', 'x,y' FROM (SELECT DISTINCT date FROM ev)""", EV,
)
def csv_rejects(spark, sf_dir):
    """Texts of some hundred records, of which some cannot be read, and for each day one text of an unknown header"""
    rows = ev(spark, sf_dir).select("date", F.floor(F.col("ordinal") / 500).alias("file"), F.concat(F.when(F.col("ordinal") % 37 == 0, '"').otherwise(""), F.format_string("%s,%.2f", "ticker", "rs")).alias("record"))
    texts = rows.groupBy("date", "file").agg(F.concat(F.lit("Ticker,Relative Strength\n"), F.array_join(F.collect_list("record"), "\n")).alias("content"))
    strange = rows.select("date").distinct().select("date", F.lit(-1).cast("bigint").alias("file"), F.lit("x,y\n1,2").alias("content"))
    return records(texts.unionByName(strange)).select("date", "file", "ticker", "rs", "reason", "record")


def _new_folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _grown(spark, sf_dir) -> str:
    """A history of the stock snapshots at a new folder: built to the end of 1995, extended by all that came after, and by the newest month once more with other
    strengths in one sector, which the default lateness leaves out and one of 31 days takes."""
    path, rows = _new_folder(spark), snap(spark, sf_dir).select("date", "ticker", "sector", "rs", "percentile", "price")
    rows = rows.persist()
    try:
        history.replace_dates(spark, path, rows.where("date <= DATE '1995-12-01'"))
        history.append(spark, path, rows, "ticker")
        newest = versions.version(spark, path).newest()
        again = rows.where((F.col("date") == F.lit(newest)) & (F.col("sector") == "PROMO")).withColumn("rs", F.col("rs") + 1)
        history.append(spark, path, again.withColumn("rs", F.lit(-1.0)), "ticker")
        history.append(spark, path, again, "ticker", lateness=31)
        return path
    finally:
        rows.unpersist()


_appended = "grown AS (SELECT * REPLACE (CASE WHEN sector = 'PROMO' AND date = (SELECT max(date) FROM snap) THEN rs + 1 ELSE rs END AS rs) FROM snap)"


@query("SELECT date, ticker, sector, rs, percentile, price FROM grown", SNAP, _appended)
def history_appends(spark, sf_dir):
    """ST3 ST4 ST5 S06 J06 U02 K01: a history built, extended twice and read back from its newest version"""
    return history.read_history(spark, _grown(spark, sf_dir)).select("date", "ticker", "sector", "rs", "percentile", "price")


@query(f"SELECT date, {MEAN.format('percentile')} AS avg_percentile, CAST(count(DISTINCT ticker) AS BIGINT) AS n_tickers, round(avg(price), 4) AS avg_price, {MEAN.format('rs')} AS avg_rs, max(rs) AS max_rs FROM grown GROUP BY date", SNAP, _appended)
def daily_series_of_sums(spark, sf_dir):
    """A07 A08 A09 ST5: the series of the same history from the sums that its changes have kept up"""
    series = metrics.series_of_sums(versions.daily(spark, _grown(spark, sf_dir)))
    return series.withColumn("avg_price", F.round("avg_price", 4))


@query(f"SELECT sector, date, {MEAN.format('rs')} AS mean_rs, min(rs) AS min_rs, max(rs) AS max_rs FROM grown GROUP BY sector, date", SNAP, _appended)
def sector_trend_of_sums(spark, sf_dir):
    """A10 ST5"""
    return metrics.trend_of_sums(versions.daily(spark, _grown(spark, sf_dir)))


@query("SELECT date, ticker, CASE WHEN day(date) % 2 = 0 THEN sector END AS sector, CASE WHEN day(date) % 2 = 1 THEN CAST(printf('%.2f', rs) AS DOUBLE) END AS rs FROM ev", EV)
def csv_files_union(spark, sf_dir):
    """Files of two headers written and read back by one glob"""
    folder, rows, even = _new_folder(spark), ev(spark, sf_dir), F.dayofmonth("date") % 2 == 0
    sinks.write_csv(rows.where(even).select(F.col("ticker").alias("Ticker"), "date", F.col("sector").alias("Sector")), f"{folder}/a")
    sinks.write_csv(rows.where(~even).select(F.format_string("%.2f", "rs").alias("Relative Strength"), "date", F.col("ticker").alias("Ticker")), f"{folder}/b")
    return read_all(spark, f"{folder}/*/part-*.csv")[0].select("date", "ticker", "sector", "rs")


@query("SELECT date, ticker, CAST(printf('%.2f', rs) AS DOUBLE) AS rs, 'historical_all' AS source_file FROM ev", EV)
def stock_history_fallback(spark, sf_dir):
    """A folder without the newer history, whose older one is loaded before the newest snapshot files"""
    folder, rows = _new_folder(spark), ev(spark, sf_dir)
    whole = rows.select("date", F.col("ticker").alias("Ticker"), F.format_string("%.2f", "rs").alias("Relative Strength"))
    sinks.write_csv(whole, f"{folder}/rs_historical_all.csv")
    sinks.write_csv(whole.where("date > DATE '2024-01-20'"), f"{folder}/rs_stocks.csv")
    return load_stocks(spark, folder).select("date", "ticker", "rs", "source_file")


@query("SELECT price, rs, percentile, ticker, sector FROM (SELECT *, row_number() OVER (ORDER BY md5(CAST(date AS VARCHAR) || '/' || ticker), date, ticker) AS place FROM snap) WHERE place <= 500", SNAP)
def scatter_sample(spark, sf_dir):
    """Points for a plot that cannot show all rows: 500, the same ones each time"""
    return filters.sampled(snap(spark, sf_dir), 500).select("price", "rs", "percentile", "ticker", "sector")


@query("SELECT date, ticker, max(CAST(printf('%.2f', rs) AS DOUBLE)) AS rs FROM ev GROUP BY date, ticker", EV)
def csv_stream_history(spark, sf_dir):
    """ST1 ST2 ST5 S05 T6 K01: files of two headers taken by a stream into a history, which keeps the strongest row of a ticker and date"""
    folder, rows, even = _new_folder(spark), ev(spark, sf_dir), F.col("ordinal") % 2 == 0
    strength = F.format_string("%.2f", "rs").alias("Relative Strength")
    sinks.write_csv(rows.where(even).select(F.col("ticker").alias("Ticker"), "date", F.col("sector").alias("Sector"), strength), f"{folder}/landing/a")
    sinks.write_csv(rows.where(~even).select(strength, "date", F.col("ticker").alias("Ticker")), f"{folder}/landing/b")
    landed = stream.landed_csv(spark, f"{folder}/landing/*")
    stream.run_csv(landed, f"{folder}/history", f"{folder}/checkpoint", "ticker", rejects=f"{folder}/rejects").awaitTermination()
    return history.read_history(spark, f"{folder}/history").select("date", "ticker", "rs")
