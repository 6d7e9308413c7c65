"""Sharding by k-d tree partitioning (operator 2). DataFrame functions only."""

from __future__ import annotations

import heapq
import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.cluster import cut, delete, kept, positions, small

#: Bits of a split key: a place along the split dimension, then a tie-break.
VALUE_BITS, TIE_BITS = 31, 32
KEY_BITS = VALUE_BITS + TIE_BITS
#: Bits of the medians that one pass over the rows fixes.
BITS = 12
#: A median is near enough if the cell it falls in has at most this part of its node's bytes.
FINE = 2.0**-13
#: A group is large, and gets its shard before the others, from this part of a shard's bytes or of all rows.
LARGE_BYTES, LARGE_ROWS = 1 / 64, 1 / 1024
#: Nodes whose splits are broadcast, and large groups and shards that are placed on the driver; more are placed in rounds.
NODES = 50_000


def number_place(value: Column) -> Column:
    """A number by its logarithm; null and negatives come before all."""
    return F.coalesce(F.when(value >= 0, F.log2(value.cast("double") + 1)), F.lit(-1.0))


def ranked(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the strings of a column replaced by their places among its distinct values; null comes before all."""
    values = positions(rows.select(F.col(name).alias("_value")).where("_value IS NOT NULL").distinct(), "_value", name="_place")
    both = rows.join(small(values), F.col(name) == F.col("_value"), "left")
    return both.withColumn(name, F.coalesce(F.col("_place").cast("double"), F.lit(-1.0))).drop("_value", "_place")


def _sent(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= NODES else table


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _key(n_dims: int) -> Column:
    place = F.get(F.array(*[F.col(f"d{i}") for i in range(n_dims)]), F.col("s_dim"))
    part = F.when(F.col("s_high") > F.col("s_low"), (place - F.col("s_low")) / (F.col("s_high") - F.col("s_low"))).otherwise(0.0)
    value = F.floor(part * float((1 << VALUE_BITS) - 1)).cast("bigint")
    return F.shiftleft(value, TIE_BITS) + F.col("tie")


def _medians(items: DataFrame, splits: DataFrame, n_splits: int, n_dims: int) -> DataFrame:
    """Rows (s, s_last): for each node of ``splits`` the greatest key of its first part, whose keys hold ``want`` of the bytes, by histograms refined
    where the median falls: each pass fixes BITS more bits of it and reads only the rows of the cell it is in. A node has at most 2^BITS cells in
    a pass, which are summed in the order of their keys by a window; what reaches the driver is how many nodes are open."""
    open_, left, known, found = splits.select("s", "s_dim", "s_low", "s_high", "bytes", "want", F.lit(0).cast("bigint").alias("prefix")), n_splits, 0, []
    while left:
        bits = min(BITS, KEY_BITS - known)
        rest = KEY_BITS - known - bits
        keyed = items.join(_sent(open_, left), F.col("shard") == F.col("s")).select("s", "size", "prefix", _key(n_dims).alias("key"))
        inside = keyed.where(F.shiftright("key", KEY_BITS - known) == F.col("prefix")) if known else keyed
        cell = F.shiftright("key", rest).bitwiseAND(F.lit((1 << bits) - 1))
        cells = inside.groupBy("s", cell.alias("cell")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("s").orderBy("cell")
        cells = cells.withColumns({"upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("cell").over(order)})
        at = cells.join(_sent(open_, left), "s").where((F.col("upto") >= F.col("want")) | F.col("next").isNull())
        fields = ["s_dim", "s_low", "s_high", "bytes", "want", "prefix", "size", "n", "upto"]
        at = at.groupBy("s").agg(F.min(F.struct("cell", *fields)).alias("x")).select("s", "x.*")
        at = at.withColumns({"prefix": F.shiftleft("prefix", bits).bitwiseOR(F.col("cell")), "want": F.col("want") - (F.col("upto") - F.col("size"))})
        done = (F.col("n") == 1) | (F.col("size") <= FINE * F.col("bytes")) | F.lit(rest == 0)
        at = cut(at.withColumn("done", done))
        last = F.shiftleft("prefix", rest) + F.when(F.col("want") * 2 > F.col("size"), F.lit((1 << rest) - 1)).otherwise(F.lit(-1))
        found.append(at.where("done").select("s", last.alias("s_last")))
        open_ = at.where(~F.col("done")).select(*open_.columns)
        left, known = open_.count(), known + bits
    return reduce(DataFrame.unionByName, found)


def _placed(large: list, leaves: int, room: float) -> tuple[dict[int, int], list[float]]:
    """Shards for large groups, (name, bytes) each, the largest first to the emptiest shard (-1: it fits into none and is
    cut), and the bytes left in each shard."""
    left = [(-room, s) for s in range(leaves)]
    heapq.heapify(left)
    found = {}
    for name, size in sorted(large, key=lambda x: (-x[1], x[0])):
        free, shard = left[0]
        found[name] = shard if size <= -free else -1
        if size <= -free:
            heapq.heapreplace(left, (free + size, shard))
    return found, [-free for free, _ in sorted(left, key=lambda x: x[1])]


def _placed_in_rounds(large: DataFrame, rooms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``_placed`` for any number of groups (group, size) and shards (leaf, room): rows (group, to) and (leaf, room).

    In a round the largest groups meet the emptiest shards, one each, by their places in two global orders. A group that fits stays; one that is
    larger than any room is cut (-1); others wait. The first group of each round is settled, and a shard takes at most one in a round, so
    rounds are about as many as large groups go into a shard. Rounds are kept as tables, and only counts and the greatest room reach the driver.
    """
    todo, done = large.select("group", "size"), []
    while not todo.isEmpty():
        most = rooms.agg(F.max("room")).first()[0]
        asked, given = positions(todo, F.col("size").desc(), "group"), positions(rooms, F.col("room").desc(), "leaf")
        to = F.when(F.col("size") > most, -1).when(F.col("size") <= F.col("room"), F.col("leaf"))
        state, _ = kept(asked.join(given, "position", "left").select("group", "size", to.cast("int").alias("to")))
        done.append(state.where("to IS NOT NULL").select("group", "to"))
        todo = state.where("to IS NULL").select("group", "size")
        taken = state.where("to >= 0").select(F.col("to").alias("leaf"), "size")
        rooms, _ = kept(rooms.join(taken, "leaf", "left").select("leaf", (F.col("room") - F.coalesce("size", F.lit(0))).alias("room")))
    return reduce(DataFrame.unionByName, done, large.limit(0).select("group", F.lit(0).alias("to"))), rooms


def _told(rows: DataFrame, given: DataFrame, large: DataFrame, n_large: int, n_rows: int) -> DataFrame:
    """``rows`` with the shard of their large group as ``to``, null for others. Beyond NODES groups those with over a thousandth of the rows
    are sent to their rows, which do not move, and only the other rows are shuffled by group."""
    if n_large <= NODES:
        return rows.join(F.broadcast(given), "group", "left")
    hot = cut(given.join(F.broadcast(cut(large.where(F.col("rows") > n_rows / 1000).select("group"))), "group", "left_semi"))
    told = rows.join(F.broadcast(hot), "group", "left")
    rest = told.where("to IS NULL").drop("to").join(given, "group", "left")
    return told.where("to IS NOT NULL").unionByName(rest)


def kd_shards(docs: DataFrame, size: Column, dims: dict[str, Column], id_col: str = "doc_id", shards: int | None = None, target_bytes: int | None = None, carry: tuple[str, ...] = (), group: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, the ``carry`` columns, size, shard, slot (place in its shard, gapless from 0).

    What is split are rows or, where ``group`` is given, groups of rows of equal values. They are split in two along the
    dimension that is widest in them (its spread against the whole table's), at a weighted median of bytes, and so on until
    each leaf has its target bytes: ``shards`` leaves, or as many as ``target_bytes`` asks for. A dimension is a
    number, or a string, which counts by its place among the distinct ones; a group has the least values of its
    rows. Medians are of (place, hash of the id or group), so that one value, however heavy, is itself split. Large groups
    (see LARGE_BYTES) get the emptiest shards first, and medians allow for what is taken there; a group
    that fits into no shard is cut into its rows. Only narrow rows are kept and read again. Nodes, histograms and, beyond NODES,
    large groups are tables, of which only counts reach the driver, so ``target_bytes`` may ask for any number of
    shards. Slots come from a range shuffle over all tasks, not from one task a shard.

    Nulls: a null number or string comes before all; a null id or group is hashed like any other.
    Repeated rows are spread apart by their place in the files, or are a group. Extra columns are ignored unless carried. An
    empty table gives an empty result. With fewer rows than shards some shards are empty.
    """
    n = len(dims)
    kept = [f"c{i}" for i in range(len(carry))]
    id_hash = F.shiftrightunsigned(F.xxhash64(F.col("id").cast("string")), 44)  # 20 bits, then 12 for rows that share an id
    tie = F.shiftleft(id_hash, 12) + F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 52)
    name = F.lit(None).cast("bigint") if group is None else F.xxhash64(group)
    base = docs.select(F.col(f"`{id_col}`").alias("id"), size.cast("bigint").alias("size"), *[c.alias(f"d{i}") for i, c in enumerate(dims.values())], *[F.col(f"`{c}`").alias(k) for c, k in zip(carry, kept, strict=True)], name.alias("group"))
    rows = cut(base.withColumns({"tie": tie, "row": F.monotonically_increasing_id()}))
    for i in range(n):
        text = rows.schema[f"d{i}"].dataType.typeName() == "string"
        rows = ranked(rows, f"d{i}") if text else rows.withColumn(f"d{i}", F.coalesce(F.col(f"d{i}").cast("double"), F.lit(-1.0)))
    ds = [f"d{i}" for i in range(n)]
    bounds = [f(d).alias(f"{what}{i}") for i, d in enumerate(ds) for f, what in ((F.min, "low"), (F.max, "high"))]
    whole = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), *bounds).first()
    total = whole["bytes"] or 0
    count = shards or max(1, math.ceil(total / target_bytes))
    spark = rows.sparkSession
    leaves = spark.range(count).select(F.col("id").cast("int").alias("leaf"), F.lit(total / count).alias("room"))
    if group is None:
        items = rows.select("row", "size", *ds, "tie")
    else:
        groups = cut(rows.groupBy("group").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"), *[F.min(d).alias(d) for d in ds]))
        large = groups.where((F.col("size") > LARGE_BYTES * total / count) | (F.col("rows") > LARGE_ROWS * whole["rows"])).where("rows > 1").select("group", "size", "rows")
        n_large = large.count()
        if max(n_large, count) <= NODES:
            taken, room = _placed([(r["group"], r["size"]) for r in large.collect()], count, total / count)
            given = _table(spark, [{"group": g, "to": x} for g, x in taken.items()], "group:bigint,to:int")
            leaves = _table(spark, [{"leaf": i, "room": x} for i, x in enumerate(room)], "leaf:int,room:double")
        else:
            given, leaves = _placed_in_rounds(large, leaves)
        own = F.shiftrightunsigned(F.col("group"), 64 - TIE_BITS)
        few = groups.join(_sent(given, n_large), "group", "left_anti").select(F.col("group").alias("row"), "size", *ds, own.alias("tie"))
        told = _told(rows, given, large, n_large, whole["rows"])
        rows = told.withColumn("row", F.when(F.col("to") == -1, F.xxhash64("group", "row")).when(F.col("to").isNull(), F.col("group")))
        items = few.unionByName(rows.where("to = -1").select("row", "size", *ds, "tie"))
    items = _split(items.withColumn("shard", F.lit(0)), whole, leaves, count, n)
    found = items.select(F.col("row").alias("item"), F.col("shard").alias("found"))
    kept_columns = ["id", "size", *kept, "tie"]
    sharded = rows.where("row IS NOT NULL").join(found, F.col("row") == F.col("item")).select(*kept_columns, F.col("found").alias("shard"))
    if group is not None:  # rows of large groups know their shard and meet no others
        sharded = sharded.unionByName(rows.where("row IS NULL").select(*kept_columns, F.col("to").alias("shard")))
    placed = positions(sharded, "shard", "id", "tie")
    starts = small(cut(placed.groupBy(F.col("shard").alias("s")).agg(F.min("position").alias("start"))))
    out = placed.join(starts, F.col("shard") == F.col("s"))
    return out.select(F.col("id").alias(id_col), *[F.col(k).alias(c) for c, k in zip(carry, kept, strict=True)], "size", "shard", (F.col("position") - F.col("start")).alias("slot"))


def _split(items: DataFrame, whole, leaves: DataFrame, count: int, n: int) -> DataFrame:
    """``items`` (row, size, d0.., tie, shard 0) with their leaves as ``shard``; leaves: (leaf, room), the bytes that each should get.

    A node is named by its first leaf and has k leaves, of which the first half go to one side. Items and leaves are kept as tables from one level to the
    next, for the estimates of the joins of many levels would multiply.
    """
    spark = items.sparkSession
    bounds = [f(f"d{i}").alias(f"{what}{i}") for i in range(n) for f, what in ((F.min, "low"), (F.max, "high"))]
    spreads = F.array(*[(F.col(f"high{i}") - F.col(f"low{i}")) / float((whole[f"high{i}"] or 0) - (whole[f"low{i}"] or 0) or 1) for i in range(n)])
    of = lambda what: F.get(F.array(*[F.col(f"{what}{i}") for i in range(n)]), F.col("s_dim"))
    half = F.floor(F.col("k") / 2).cast("int")
    items, items_at = kept(items)
    leaves, leaves_at = kept(leaves.withColumns({"node": F.lit(0), "k": F.lit(count)}))
    for _ in range((count - 1).bit_length() if whole["bytes"] else 0):
        first = F.col("leaf") < F.col("node") + half
        rooms = leaves.where("k > 1").groupBy("node", "k").agg(F.sum("room").alias("all"), F.sum(F.when(first, F.col("room")).otherwise(0.0)).alias("part"))
        nodes = items.groupBy("shard").agg(F.sum("size").alias("bytes"), *bounds).join(rooms, F.col("shard") == F.col("node"))
        share = F.when(F.col("all") > 0, F.col("part") / F.col("all")).otherwise(half / F.col("k"))
        nodes = nodes.withColumn("s_dim", (F.array_position(spreads, F.array_max(spreads)) - 1).cast("int"))
        splits = cut(nodes.select(F.col("node").alias("s"), "s_dim", of("low").alias("s_low"), of("high").alias("s_high"), "bytes", (F.col("bytes") * share).alias("want"), half.alias("s_add")))
        n_splits = splits.count()
        if not n_splits:
            break
        at = splits.join(_medians(items, splits, n_splits, n), "s")
        moved = items.join(_sent(at, n_splits), F.col("shard") == F.col("s"), "left")
        to = F.col("shard") + F.when(F.col("s").isNotNull() & (_key(n) > F.col("s_last")), F.col("s_add")).otherwise(0)
        deeper = leaves.select("leaf", "room", F.when(first, F.col("node")).otherwise(F.col("node") + half).alias("node"), F.when(first, half).otherwise(F.col("k") - half).alias("k"))
        before = items_at, leaves_at
        items, items_at = kept(moved.withColumn("shard", to).select(*items.columns))
        leaves, leaves_at = kept(deeper)
        for path in before:
            delete(spark, path)
    return items
