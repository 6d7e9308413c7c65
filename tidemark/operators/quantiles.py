"""Exact quantiles by distributed selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tidemark.operators.steps import BROADCAST_ROWS, table

#: Buckets that a round divides a bracket into, at most, and buckets of all brackets together.
BUCKETS, ALL_BUCKETS = 4096, 1 << 20
#: Values of a bracket that are sorted as one list instead of being divided further.
FEW = 1000


def quantiles(df: DataFrame, groups: list[str], columns: list[str], probs: dict[str, float], **more: Callable[[Column], Column]) -> DataFrame:
    """Exact quantiles, interpolated between neighbours, of each of ``columns`` in each group: a row (groups, metric, n, those of ``more``, which make an aggregate of a column,
    and a column for each of ``probs``) for each group and column that has a value. Nulls and NaN are no values; a null group is a group.

    All wanted ranks of all columns and groups are found together. A round counts the values in buckets between the bounds of each rank's bracket, with
    their least and greatest value; the bucket that the rank falls into is its next bracket. Buckets are of equal width where the bounds are within
    a factor of two, else of equal width on a scale of logarithms, so a few rounds suffice for any numbers. Bounds are values of the data and
    buckets of their own, so brackets always shrink; those whose bounds meet are done, and those of at most FEW values are sorted. A round is one
    pass over the columns that combines in the tasks before its shuffle, so no task holds the values of a column, however many they are.
    """
    narrow = df.select(*groups, *[F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(f"_x{i}") for i, c in enumerate(columns)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        key = [*groups, "metric"]
        own = [F.struct(F.lit(i).alias("metric"), F.count(f"_x{i}").alias("n"), F.min(f"_x{i}").alias("_lo"), F.max(f"_x{i}").alias("_hi"), *[v(F.col(f"_x{i}")).alias(k) for k, v in more.items()]) for i in range(len(columns))]
        sets = table(narrow.groupBy(*groups).agg(F.array(*own).alias("_sets")).select(*groups, F.inline("_sets")).where("n > 0"))
        rows = narrow.select(*groups, F.posexplode(F.array(*[F.col(f"_x{i}") for i in range(len(columns))])).alias("metric", "x")).where("x IS NOT NULL")
        found = table(_with_values(sets, _selected(rows, sets, key, probs), key, probs))
    finally:
        narrow.unpersist()
    return found.select(*groups, F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("metric") + 1).alias("metric"), "n", *more, *probs)


def _ranks(p: float) -> tuple[Column, Column]:
    at = (F.col("n") - 1) * F.lit(float(p))
    return F.floor(at).cast("bigint"), F.ceil(at).cast("bigint")




def _scaled(x: Column) -> Column:
    """A scale that never falls as ``x`` grows: logarithms are between -745 and 710."""
    return F.when(x > 0, 1000 + F.log(x)).when(x < 0, -1000 - F.log(-x)).otherwise(0.0)


def _within(rows: DataFrame, brackets: DataFrame, key: list[str], many: int) -> DataFrame:
    """The values in each of ``brackets`` (key, lo, hi), at most ``many``, which do not overlap."""
    there = brackets.select(*[F.col(k).alias(f"_{k}") for k in key], "lo", "hi").distinct()
    there = F.broadcast(there) if many <= BROADCAST_ROWS else there
    condition: Column = F.col("x").between(F.col("lo"), F.col("hi"))
    for k in key:
        condition &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(there, condition).select(*key, "lo", "hi", "x")


def _selected(rows: DataFrame, sets: DataFrame, key: list[str], probs: dict[str, float]) -> DataFrame:
    """(key, rank, value): the values at the ranks next to each quantile."""
    wanted = F.array_distinct(F.array(*[r for p in probs.values() for r in _ranks(p)]))
    found = table(sets.select(*key, F.explode(wanted).alias("rank"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("n").alias("size")).withColumn("at", F.col("rank")))
    wide = F.col("lo") < F.col("hi")
    while True:
        open_brackets, largest = found.where(wide).agg(F.count(F.lit(1)), F.max("size")).first()
        if not open_brackets or largest <= FEW:
            break
        dividing = wide & (F.col("size") > FEW)
        buckets = max(16, min(BUCKETS, ALL_BUCKETS // open_brackets))
        low, high = F.col("lo"), F.col("hi")
        close = (low != 0) & (F.signum(low) == F.signum(high)) & (F.greatest(F.abs(low), F.abs(high)) <= 2 * F.least(F.abs(low), F.abs(high)))
        on = lambda v: F.when(close, v).otherwise(_scaled(v))
        share = F.try_divide(on(F.col("x")) - on(low), on(high) - on(low))
        inner = F.least(F.coalesce(F.floor(F.when(~F.isnan(share), share) * buckets), F.lit(0)), F.lit(buckets - 1))
        bucket = F.when(F.col("x") == low, -1).when(F.col("x") == high, buckets).otherwise(inner).cast("int")
        counts = _within(rows, found.where(dividing), key, open_brackets).groupBy(*key, "lo", "hi", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("count"), F.min("x").alias("least"), F.max("x").alias("most"))
        order = Window.partitionBy(*key, "lo", "hi").orderBy("bucket")
        counts = counts.withColumn("before", F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, -1))).fillna({"before": 0}).alias("c")
        todo = found.where(dividing).alias("f")
        hit = (F.col("f.at") >= F.col("c.before")) & (F.col("f.at") < F.col("c.before") + F.col("c.count"))
        for k in [*key, "lo", "hi"]:
            hit &= F.col(f"f.{k}").eqNullSafe(F.col(f"c.{k}"))
        nearer = todo.join(counts, hit).select(*[f"f.{k}" for k in key], "f.rank", F.col("c.least").alias("lo"), F.col("c.most").alias("hi"), F.col("c.count").alias("size"), (F.col("f.at") - F.col("c.before")).alias("at"))
        found = table(found.where(~dividing).select(*key, "rank", "lo", "hi", "size", "at").unionByName(nearer))
    done = found.where(~wide).select(*key, "rank", F.col("lo").alias("value"))
    if not open_brackets:
        return done
    lists = _within(rows, found.where(wide), key, open_brackets).groupBy(*key, "lo", "hi").agg(F.array_sort(F.collect_list("x")).alias("xs")).alias("l")  # at most FEW each
    todo, same = found.where(wide).alias("f"), F.lit(True)
    for k in [*key, "lo", "hi"]:
        same &= F.col(f"f.{k}").eqNullSafe(F.col(f"l.{k}"))
    return done.unionByName(todo.join(lists, same).select(*[f"f.{k}" for k in key], "f.rank", F.get("l.xs", F.col("f.at").cast("int")).alias("value")))


def _with_values(sets: DataFrame, values: DataFrame, key: list[str], probs: dict[str, float]) -> DataFrame:
    known = values.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at")).withColumnsRenamed({k: f"_{k}" for k in key})
    condition: Column = F.lit(True)
    for k in key:
        condition &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = sets.join(known, condition)

    def value(p: float) -> Column:
        low, high = _ranks(p)
        part = (F.col("n") - 1) * F.lit(float(p)) - low
        return F.when(low == high, F.element_at("_at", low)).otherwise((1 - part) * F.element_at("_at", low) + part * F.element_at("_at", high))

    return joined.withColumns({name: value(p) for name, p in probs.items()})
