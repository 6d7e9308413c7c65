"""Column expressions: parsing, ranks, deltas, formats. All are built-in functions; there are no UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.schema import HORIZONS, NUMERIC

#: A plain decimal number, or inf; Spark's own cast also takes suffixes such as 1d.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|(?i:inf(inity)?))$"
#: Texts that some readers take for missing.
NA_TOKENS = ("", "NA", "N/A", "NULL", "null", "nan", "NaN", "None", "n/a", "<NA>", "#N/A", "-nan", "-NaN")


def number(column: Column) -> Column:
    """A number, or null where the text is none; NaN is null."""
    text = F.trim(column.cast("string"))
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def coerced(df: DataFrame, columns: tuple[str, ...] = NUMERIC) -> DataFrame:
    """The ``columns`` that ``df`` has, as numbers."""
    return df.withColumns({c: number(F.col(f"`{c}`")) for c in columns if c in df.columns})


def day(column: Column) -> Column:
    """The date that a text or timestamp begins with, or null."""
    return F.split(F.trim(column.cast("string")), r"[ T]")[0].try_cast("date")


def rank_of_percentile(percentile: Column) -> Column:
    """101 less the percentile, so 99 is rank 2."""
    return F.lit(101) - percentile


def with_ranks(df: DataFrame) -> DataFrame:
    """A rank for each percentile column that ``df`` has."""
    return df.withColumns({r: rank_of_percentile(F.col(p)).cast("double") for p, r in HORIZONS.items() if p in df.columns})


def whole(column: Column) -> Column:
    """The nearest integer, ties to even."""
    return F.bround(column.cast("double")).cast("bigint")


def delta_class(delta: Column) -> Column:
    """Green for better, red for worse, gray for the same, empty for null."""
    return F.when(delta.isNull(), "").when(delta > 0, "green").when(delta < 0, "red").otherwise("gray")


def billions(column: Column) -> Column:
    """Dollars in billions with two decimals; null as N/A."""
    return F.when(column.isNull(), "N/A").otherwise(F.concat(F.lit("$"), F.format_string("%.2f", column / F.lit(1e9)), F.lit("B")))


def metric(column: Column, decimals: int = 0, prefix: str = "") -> Column:
    """A number as text: ``decimals`` places, ties to even, after ``prefix``; a whole number with its thousands parted by commas. Null as N/A."""
    text = F.call_function("format_number", column.cast("double"), F.lit("0." + "0" * decimals)) if decimals else F.format_number(column, 0)
    return F.coalesce(F.concat(F.lit(prefix), text), F.lit("N/A"))


def group_label(name: Column, size: Column, strength: Column) -> Column:
    """What stands above a group's list: its name, how many tickers, its strength or N/A."""
    shown = F.coalesce(F.call_function("format_number", strength.cast("double"), F.lit("0.0#####")), F.lit("N/A"))
    return F.concat(name, F.lit(" ("), size.cast("string"), F.lit(" tickers) | RS: "), shown)


def or_na(column: Column) -> Column:
    """Text, with N/A for null."""
    return F.coalesce(column.cast("string"), F.lit("N/A"))


def first_listed(tickers: Column, n: int = 5) -> Column:
    """The first ``n`` names of a comma list, trimmed, empty ones dropped; null gives empty text."""
    names = F.transform(F.split(F.coalesce(tickers, F.lit("")), ","), lambda x: F.trim(x))  # F.trim itself would take the index too
    return F.array_join(F.slice(F.filter(names, lambda x: x != ""), 1, n), ", ")


def commit_fields(line: Column) -> Column:
    """Struct of hash, date, message; the message may hold more bars, and may be missing."""
    parts = F.split(line, r"\|", 3)
    return F.struct(F.get(parts, F.lit(0)).alias("hash"), day(F.get(parts, F.lit(1))).alias("date"), F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("message"))


def exact_mean(column: Column, scale: int = 2) -> Column:
    """Mean of numbers of ``scale`` decimals that does not depend on the order of the rows."""
    return F.sum(column.cast(f"decimal(18,{scale})")).cast("double") / F.count(column)


def file_label(name: Column) -> Column:
    """A name fit for a file."""
    return F.replace(name, F.lit(" "), F.lit("_"))


def joined(value: str, separator: str, *order: Column) -> Column:
    """An aggregate: the values of a group in ``order`` (then by themselves), in one text. Nulls are left out."""
    row = F.struct(*[x.alias(f"k{i}") for i, x in enumerate(order)], F.col(value).alias("value"))
    rows = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), row)))
    return F.array_join(F.transform(rows, lambda r: r["value"]), separator)


def descending(column: str) -> tuple[Column, Column]:
    """Two keys that sort a number from its greatest value down, nulls last."""
    return F.col(column).isNull(), -F.col(column)
