"""Exact deduplication by progressive refinement (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.cluster import BROADCAST_ROWS, cut, perhaps_in, small, without


def normal(text: Column) -> Column:
    """The compared form of a text: each run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), prefix: int = 128) -> DataFrame:
    """One row per row of ``docs``: id, the ``carry`` columns, keep_id, group_size long,
    text_hash (SHA-256 of the normalised text, null where no refinement needed it), kept boolean.

    Refinement: rows are grouped by the length of their normalised text, then by length and the hash of its
    first ``prefix`` characters; only for groups that still have two rows are whole texts read again, normalised and
    hashed (SHA-256): the second pass leaves out rows whose id is in no such group before it looks at their texts. Up to BROADCAST_ROWS
    ids are sent to the tasks for that, more as bitmaps of their hashes, which let a few other rows through; no text is shuffled.
    Groups are counted by partial aggregates, so a group of any size is no task's burden; key tables are joined by
    broadcast if counted to be small, else by shuffle.

    Nulls: a null text counts as empty; a null id sorts after all others and is keep_id only where a group
    has no other. Repeated rows (same id and text): exactly one is kept. Extra columns, of any name, are ignored
    unless named in ``carry``. An empty table gives an empty result.
    """
    kept = [f"_c{i}" for i in range(len(carry))]
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), *[F.col(f"`{c}`").alias(k) for c, k in zip(carry, kept, strict=True)], F.col(f"`{text_col}`").alias("_raw"))

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_text", normal(F.col("_raw"))).withColumn("_n", F.length("_text")).withColumn("_p", F.xxhash64(F.substring("_text", 1, prefix)))

    narrow = cut(keyed(base).drop("_raw", "_text"))

    lengths = small(cut(narrow.groupBy("_n").count().where("count > 1").select("_n")))
    alike = narrow.join(lengths, "_n", "left_semi").groupBy("_n", "_p").count().where("count > 1").select("_n", "_p")
    alike = small(cut(alike))

    ids = cut(narrow.join(alike, ["_n", "_p"], "left_semi").select(F.col("_id").alias("_i")).distinct())
    if ids.count() <= BROADCAST_ROWS:
        left = base.join(F.broadcast(ids), F.col("_id").eqNullSafe(F.col("_i")), "left_semi")
    else:
        both, perhaps = perhaps_in(base, "_id", ids)
        left = both.where(perhaps).select(*base.columns)
    hashed = keyed(left).select("_id", *kept, "_n", "_p", F.sha2("_text", 256).alias("_hash"))
    whole = cut(hashed.join(alike, ["_n", "_p"], "left_semi").drop("_n", "_p").withColumn("_row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = small(cut(whole.groupBy("_hash").agg(first.alias("_first"), F.count(F.lit(1)).alias("group_size"))))
    several = whole.join(groups, "_hash").select("_id", *kept, F.col("_first.id").alias("keep_id"), "group_size", F.col("_hash").alias("text_hash"), (F.col("_row") == F.col("_first.row")).alias("kept"))
    single = narrow.join(alike, ["_n", "_p"], "left_anti").select("_id", *kept, F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(None).cast("string").alias("text_hash"), F.lit(True).alias("kept"))
    out = several.unionByName(single)
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "keep_id", "group_size", "text_hash", "kept")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns (of any types).

    Dropped rows are named by id. Ids that several rows of the groups share are the exception: their rows are named by id
    and text hash, and rows that repeat the id and text of the one that stays become one row, the first by its JSON form.
    """
    marked = cut(exact_dedup(docs, id_col, text_col).where("group_size > 1"))
    ids = marked.select(F.col(f"`{id_col}`").alias("_id"), F.col("text_hash").alias("_hash"), "keep_id", "kept")
    shared = cut(docs.select(F.col(f"`{id_col}`").alias("_id")).join(small(cut(ids.select(F.col("_id").alias("_i")).distinct())), F.col("_id").eqNullSafe(F.col("_i")), "left_semi").groupBy("_id").count().where("count > 1").select("_id"))
    same = F.col("_id").eqNullSafe(F.col("keep_id"))
    if shared.isEmpty():
        return without(docs, id_col, ids.where(~same).select("_id"))
    several = small(shared.withColumnRenamed("_id", "_s"))
    lone = ids.where(~same).join(several, F.col("_id").eqNullSafe(F.col("_s")), "left_anti").select("_id")
    left = without(docs, id_col, lone)
    rows = left.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_raw"))
    plain = rows.join(several, F.col("_id").eqNullSafe(F.col("_s")), "left_anti").select("_all")
    named = rows.join(several, F.col("_id").eqNullSafe(F.col("_s")), "left_semi").select("_all", "_id", F.sha2(normal(F.col("_raw")), 256).alias("_hash"))

    def without_keys(left: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h")).distinct()
        return left.join(small(cut(keys)), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), how)

    named = without_keys(named, ids.where(~same), "left_anti")
    repeated = ids.where(same).groupBy("_id", "_hash").count().where("count > 1")
    single = without_keys(named, repeated, "left_semi").groupBy("_id", "_hash").agg(F.min_by("_all", F.to_json("_all")).alias("_all")).select("_all")
    return plain.unionByName(without_keys(named, repeated, "left_anti").select("_all")).unionByName(single).select("_all.*")
