"""Snapshot files: reading with drifting columns, fallbacks, signatures, cached loads."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import NA_TOKENS, coerced, day
from tidemark.functions.schema import INDUSTRY_NAMES, STOCK_NAMES
from tidemark.operators.industry import latest_industries


#: Files whose headers are read at once.
OPEN_FILES = 32


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _list(spark: SparkSession, pattern: str) -> list:
    """File statuses of a glob, by name, in any store that Spark reads."""
    where = _path(spark, pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(found or [], key=lambda s: s.getPath().getName())


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows, columns by name, what a frame lacks as null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_csv(spark: SparkSession, path: str | list[str], names: dict[str, str] = STOCK_NAMES, compat_na_tokens: bool = False, with_source: bool = False) -> DataFrame:
    """A file, or files of one header: all columns read as text, renamed, numbers and dates parsed.

    Text columns are taken verbatim, so that a ticker NA stays one; ``compat_na_tokens`` makes such texts null (T7).
    """
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    if with_source:
        raw = raw.withColumn("source_file", F.col("_metadata.file_name"))
    if compat_na_tokens:
        raw = raw.select([F.when(~F.col(f"`{c}`").isin(*NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in raw.columns if c != "source_file"] + [c for c in raw.columns if c == "source_file"])
    df = coerced(raw.withColumnsRenamed(names))
    return df.withColumn("date", day(F.col("date"))) if "date" in df.columns else df


def header_of(spark: SparkSession, status) -> str | None:
    """The first line of a file, None if it has none; nothing beyond it is fetched."""
    path, conf = status.getPath(), spark._jsc.hadoopConfiguration()
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        plain = codec.createInputStream(stream) if codec else stream
        return spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(plain, "UTF-8")).readLine()
    finally:
        stream.close()


def read_all(spark: SparkSession, pattern: str, names: dict[str, str] = STOCK_NAMES, compat_na_tokens: bool = False) -> tuple[DataFrame | None, list[str]]:
    """The files of a glob, each by its own header (T6), with its name as source_file; and the names of the files
    that cannot be read, which are left out (T25).

    Files are grouped by their first line, and each group is one scan, so the plan grows with the headers and not with the files.
    """
    groups: dict[str | None, list] = {}
    found = _list(spark, pattern)
    with ThreadPoolExecutor(OPEN_FILES) as pool:
        for status, header in zip(found, pool.map(lambda s: header_of(spark, s), found), strict=True):
            groups.setdefault(header, []).append(status.getPath())
    frames, bad = [], []
    for header, paths in groups.items():
        frame = read_csv(spark, [p.toString() for p in paths], names, compat_na_tokens, with_source=True) if header and header.strip() else None
        if frame is None or not set(frame.columns) & set(names.values()):
            bad += [p.getName() for p in paths]
        else:
            frames.append(frame)
    return (union(frames) if frames else None), sorted(bad)


# A field of a CSV text and a record whose fields are all sound; line breaks may stand within quotes, which begin and end a field.
SOUND = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",\n]*+)'
RECORD = rf"{SOUND}(?:,{SOUND})*+"
#: A field behind its comma, in a record that may be unsound.
FIELD = r',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'


def fields(record: Column) -> Column:
    """The fields of a CSV record, quotes undone."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(FIELD), F.lit(1))
    return F.transform(raw, lambda x: F.when(F.startswith(x, F.lit('"')) & F.endswith(x, F.lit('"')) & (F.length(x) > 1), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def records(rows: DataFrame, names: dict[str, str] = STOCK_NAMES, compat_na_tokens: bool = False) -> DataFrame:
    """Every record of the CSV texts in ``content``, each text by its own header (T6), with the reason why it is rejected, null if it is
    not, in one pass over all of them.

    The other columns of ``rows`` stay, and go before columns of the same name in a text. ``line`` is the record's number in its text,
    from 1; columns of ``names`` that a text lacks are null, as are empty fields and missing ends of records; blank lines are no records.
    A record with a quote that neither begins nor ends a field is rejected as ``stray quote``; it ends with its line, and the records after it are read.
    A text without anything, or whose header has no known column, is one rejected record of line 0: ``no text``, ``no known column``. ``record`` is the text of a
    rejected record.
    """
    kept = [c for c in rows.columns if c != "content"]
    text = F.regexp_replace(F.regexp_replace(F.coalesce("content", F.lit("")), "^\ufeff", ""), r"\r\n?", "\n")
    whole = rows.select(*kept, F.filter(F.regexp_extract_all(text, F.lit(rf"{RECORD}(?=\n|\z)|[^\n]++"), F.lit(0)), lambda r: F.trim(r) != "").alias("_records"))
    heads = whole.withColumn("_top", F.get("_records", F.lit(0))).withColumn("_header", fields(F.coalesce("_top", F.lit(""))))
    known = F.arrays_overlap("_header", F.array(*[F.lit(n) for n in names])) & F.col("_top").rlike(rf"^{RECORD}\z")
    reason = F.when(F.col("_top").isNull(), "no text").when(~known, "no known column")
    body = F.when(reason.isNull(), F.slice("_records", 2, F.size("_records"))).otherwise(F.array(F.coalesce("_top", F.lit(""))))
    lines = heads.withColumn("_text_reason", reason).select(*kept, "_header", "_text_reason", F.posexplode(body).alias("_at", "record"))
    stray = F.contains("record", F.lit('"')) & ~F.col("record").rlike(rf"^{RECORD}\z")
    lines = lines.select(*kept, "_header", F.coalesce("_text_reason", F.when(stray, "stray quote")).alias("reason"), F.when(F.col("_text_reason").isNull(), F.col("_at") + 1).otherwise(0).alias("line"), "record")
    lines = lines.withColumn("_fields", F.when(F.col("reason").isNull(), fields(F.col("record"))))
    missing = NA_TOKENS if compat_na_tokens else ("",)

    def value(name: str) -> Column:
        found = F.get("_fields", (F.array_position("_header", name) - 1).cast("int"))
        return F.when(~found.isin(*missing), found)

    own = {name: mine for name, mine in names.items() if mine not in kept}
    shown = F.when(F.col("reason").isNotNull(), F.col("record")).alias("record")
    df = coerced(lines.select(*kept, "line", "reason", shown, *[value(name).alias(mine) for name, mine in own.items()]))
    return df if "date" in kept else df.withColumn("date", day(F.col("date")))


def parsed(rows: DataFrame, names: dict[str, str] = STOCK_NAMES, compat_na_tokens: bool = False) -> DataFrame:
    """The records that are not rejected, see ``records``."""
    return accepted(records(rows, names, compat_na_tokens))


def accepted(found: DataFrame) -> DataFrame:
    """Of ``records``, those that can be read."""
    return found.where("reason IS NULL").drop("reason", "record")


def rejected(found: DataFrame, *places: str) -> DataFrame:
    """Of ``records``, those that cannot be read: ``places`` (columns that say where they stand), line, reason, record."""
    return found.where("reason IS NOT NULL").select(*places, "line", "reason", "record")


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_list(spark, path))


def load_stocks(spark: SparkSession, folder: str, **how) -> DataFrame | None:
    """The stock history, else the older history, else the newest snapshot files, else None."""
    for name, label in (("rs_stocks_historical.csv", "stocks_historical"), ("rs_historical_all.csv", "historical_all")):
        if exists(spark, f"{folder}/{name}"):
            df = read_csv(spark, f"{folder}/{name}", **how)
            if "date" in df.columns:
                return df.withColumn("source_file", F.lit(label))
    return read_all(spark, f"{folder}/rs_stocks*.csv", **how)[0]


def load_industries(spark: SparkSession, folder: str, **how) -> DataFrame | None:
    """The newest snapshot of the industry history, else the current file, else None."""
    for name in ("rs_industries_historical.csv", "rs_industries.csv"):
        if exists(spark, f"{folder}/{name}"):
            df = read_csv(spark, f"{folder}/{name}", INDUSTRY_NAMES, **how)
            return latest_industries(df) if name.endswith("historical.csv") else df
    return None


def empty(df: DataFrame | None) -> bool:
    """Nothing was found, or it has no rows."""
    return df is None or df.isEmpty()


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, in any store that Spark writes."""
    where = _path(spark, path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def signature(spark: SparkSession, folder: str, pattern: str = "*.csv") -> str:
    """Names and modification seconds of the files, by name."""
    return "|".join(f"{s.getPath().getName()}:{s.getModificationTime() // 1000}" for s in _list(spark, f"{folder}/{pattern}"))


class Cache:
    """Loads kept in memory until the files' signature changes or they are cleared."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.held = spark, {}

    def get(self, folder: str, load) -> DataFrame | None:
        now = signature(self.spark, folder)
        had = self.held.get((folder, load))
        if had is None or had[0] != now:
            if had is not None and had[1] is not None:
                had[1].unpersist()
            df = load(self.spark, folder)
            had = self.held[folder, load] = (now, df.persist() if df is not None else None)
        return had[1]

    def clear(self) -> None:
        for (folder, _), (_, df) in self.held.items():
            if df is not None:
                df.unpersist()
            self.spark.catalog.refreshByPath(folder)
        self.held.clear()
