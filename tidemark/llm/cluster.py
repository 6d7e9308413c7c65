"""Helpers shared by the operators: checkpoints, size-checked broadcasts, global positions, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has at most this many (narrow) rows, else Spark picks a shuffle join.
BROADCAST_ROWS = 200_000
#: Narrow rows in a partition of the tables that many rounds go over.
PART_ROWS = 50_000
#: Bitmaps of 4 KB that may be broadcast.
BITMAPS = 8_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``. Where the session names none, a local
    session (driver and tasks in one process, as in tests) gets one of its own; on a cluster that is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return folder or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` now in the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as a table in the shared folder now, and where it is. Unlike a checkpoint it forgets the size that its plan was estimated to have: in
    rounds that join what the rounds before made, these estimates multiply, their digits double each round, and the driver's memory fills with them."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Removes what ``kept`` has written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already cut, so counting is cheap) with a broadcast hint if it is within ``rows``."""
    return F.broadcast(df) if df.count() <= rows else df


def _listed(rows: DataFrame, place: Column, maps: DataFrame) -> tuple[DataFrame, Column]:
    """``rows`` joined with ``maps`` (_n, _bits) by broadcast, and whether the number ``place`` (long, from 0) is in them."""
    both = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("_n"), "left")
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return both, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def _bitmaps(places: DataFrame) -> DataFrame:
    """(_n, _bits): bitmaps of the numbers in ``places`` (one column)."""
    number = F.col(places.columns[0])
    return cut(places.groupBy(F.bitmap_bucket_number(number).alias("_n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits")))


def perhaps_in(rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, Column]:
    """``rows`` (with columns _n and _bits more) and a condition that holds where ``key``, of any type, is among ``ids`` (one column, cut), and for some others: ids are
    looked up by hash in broadcast bitmaps of eight bits an id and more, up to BITMAPS of them, so no row moves."""
    bits = 1 << max(15, min((32_768 * BITMAPS).bit_length() - 1, max(20, (8 * ids.count()).bit_length())))
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(bits))
    return _listed(rows, place(key), _bitmaps(ids.select(place(ids.columns[0]).alias("_place"))))


def without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is not in ``gone`` (one column of distinct ids; a null id names null ids).

    Up to BROADCAST_ROWS ids are sent to the tasks as they are, more as bitmaps of 32,768 ids each if those have at
    most BITMAPS of them (integer ids that lie close). Other ids are looked up by hash in such bitmaps first, and only rows that may be gone
    are shuffled by id to be sure; so rows with their texts stay where they are unless most are to go.
    """
    gone = cut(gone.toDF("_id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_key"))
    if gone.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(gone), F.col("_key").eqNullSafe(F.col("_id")), "left_anti").select("_row.*")
    if gone.schema["_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        maps = _bitmaps(gone.where("_id IS NOT NULL"))
        if maps.count() <= BITMAPS:
            rows = rows if gone.where("_id IS NULL").isEmpty() else rows.where("_key IS NOT NULL")
            both, listed = _listed(rows, F.col("_key"), maps)
            return both.where(~listed).select("_row.*")
    both, perhaps = perhaps_in(rows, "_key", gone)
    doubtful = both.where(perhaps).join(gone, F.col("_key").eqNullSafe(F.col("_id")), "left_anti")
    return both.where(~perhaps).select("_row.*").union(doubtful.select("_row.*"))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def positions(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """``df`` with its rows' gapless 0-based place in ``order``, by two passes.

    A range shuffle sorts the rows over many tasks and numbers them within each; the totals of the
    tasks (one number each) give the offsets. No task sees more than its range, whatever the keys.
    Rows equal in ``order`` are numbered as they come, so ``order`` should be total.
    """
    local = F.monotonically_increasing_id()
    ranged = cut(df.repartitionByRange(tasks(df.sparkSession), *order).sortWithinPartitions(*order).withColumn(name, local))
    part = F.shiftright(name, 33).cast("int")
    totals = ranged.groupBy(part.alias("part")).count().collect()
    before, offsets = 0, {}
    for row in sorted(totals, key=lambda r: r["part"]):
        offsets[row["part"]] = before - (row["part"] << 33)
        before += row["count"]
    if not offsets:
        return ranged
    shift = F.create_map(*[F.lit(x) for pair in offsets.items() for x in (pair[0], pair[1])])
    return ranged.withColumn(name, F.col(name) + F.element_at(shift, part))


def parts_for(rows: int, spark: SparkSession) -> int:
    """Partitions for so many narrow rows, PART_ROWS in each, at most those of a shuffle."""
    return max(1, min(tasks(spark), -(-rows // PART_ROWS)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u long, v long): rows (node, label), label the least node reached.

    Least labels spread along the edges and each label is replaced by its own label (pointer jumping), so
    rounds grow with the logarithm of a component's width. A round is one aggregate and one join by label; its partitions
    are as many as the rows ask for, so that many rounds over few edges are few tasks. Between rounds labels are kept as tables, of which the
    last two stay. Only one flag of a round reaches the driver.
    """
    spark = edges.sparkSession
    both, _ = kept(edges.select("u", "v").union(edges.select("v", "u")).where("u != v").distinct())
    wide = parts_for(both.count(), spark)
    labels, at = kept(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")).coalesce(wide))
    few = labels.count() <= BROADCAST_ROWS
    while True:
        known = F.broadcast(labels) if few else labels
        met = both.join(known, both.v == labels.node).select(F.col("u").alias("node"), "label", F.lit(None).cast("bigint").alias("own"))
        own = labels.select("node", "label", F.col("label").alias("own"))
        seen = met.union(own).groupBy("node").agg(F.min("label").alias("to"), F.max("own").alias("old")).coalesce(wide)
        parents = known.select(F.col("node").alias("parent"), F.col("label").alias("up"))
        step = seen.join(parents, F.col("to") == F.col("parent"), "left").select("node", F.least("to", "up").alias("label"), "old")
        step, now = kept(step if few else step.coalesce(wide))
        delete(spark, at)
        if step.where("label != old").isEmpty():
            return step.select("node", "label")
        labels, at = step.select("node", "label"), now


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], hot: int = 1000) -> DataFrame:
    """``rows`` with the other columns of ``table``, which has each key once; rows whose key it lacks are left out.

    A small table is broadcast. Beyond that, the keys that have over one in ``hot`` of the rows (so fewer than ``hot`` keys) meet their rows
    by a broadcast, and only the rest is shuffled by key, so that no task gets more than its share. Both sides should be cut.
    """
    n = table.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = cut(counts.where(F.col("_n") > rows.count() / hot).drop("_n"))
    if large.isEmpty():
        return rows.join(table, keys)
    common = cut(table.join(F.broadcast(large), keys, "left_semi"))
    rest = rows.join(F.broadcast(large), keys, "left_anti").join(table, keys)
    return rows.join(F.broadcast(common), keys).unionByName(rest)
