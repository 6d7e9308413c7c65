"""Mixing sources to target weights by entropy balancing (operator 10)."""

from __future__ import annotations

from itertools import cycle, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.cluster import cut, positions, small

#: Partitions of tables that have a row for each source.
SOURCE_PARTS = 8
#: Newton rounds at most, and the relative error of a source's words at which they end.
ROUNDS, TOLERANCE = 60, 1e-9


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``sources`` (source, place from 0, source_size) with ``target``: ``share`` of all sizes by weight, at most ``cap`` times a source's.

    What a capped source leaves is shared again by weight until none is above: the level (words for a weight
    of one) rises, round by round, to its fixed point. A round is one aggregate over the sources.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = cut(sources.withColumns({"weight": weight, "most": F.col("source_size") * F.lit(float(cap))}).coalesce(SOURCE_PARTS))
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level, held = 0.0, -1
    while True:
        full = F.col("weight") * level >= F.col("most")
        got = rows.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count(F.when(full, 1))).first()
        if got[2] == held or not got[1]:
            break
        held, level = got[2], (total - got[0]) / got[1]
    return rows.withColumn("target", F.least(F.col("most"), F.col("weight") * level))


def tilts(classes: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """(source_key, tilt): the dual variable of each source's word constraint.

    The rates nearest in entropy to one copy each, with at most ``cap`` copies, are min(cap, exp(tilt * x)) for
    documents of x = size / mean size. Newton steps on the convex dual, kept between bounds where a step would
    leave them, run over all sources at once; a round is one aggregate over the (source, size) classes.
    """
    x = F.col("size") / F.col("mean")
    rows = cut(classes.where("size > 0").join(small(sources.select("source_key", "source_size", "target", "n_docs")), "source_key").select("source_key", "size", "n", "target", "source_size", (F.col("source_size") / F.col("n_docs")).alias("mean")))
    state = cut(sources.select("source_key", F.lit(0.0).alias("tilt"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")).coalesce(SOURCE_PARTS))
    for _ in range(ROUNDS):
        rate = F.exp(F.least(F.col("tilt") * x, F.lit(float(np.log(cap)))))
        free = F.col("tilt") * x < float(np.log(cap))
        moved = rows.join(small(state.select("source_key", "tilt", "low", "high")), "source_key").groupBy("source_key").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("words"), F.sum(F.when(free, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"), F.first("target").alias("target"), F.first("tilt").alias("tilt"), F.first("low").alias("low"), F.first("high").alias("high"), F.max(float(cap) * F.col("source_size")).alias("most")
        )
        # a target at the cap needs no tilt but an endless one; the cap then holds for every document
        moved = moved.withColumn("off", F.when(F.col("target") >= F.col("most") * (1 - 1e-12), 0.0).otherwise((F.col("words") - F.col("target")) / F.greatest(F.col("target"), F.lit(1e-9))))
        moved = moved.withColumns({"low": F.when(F.col("off") < 0, F.greatest("low", "tilt")).otherwise(F.col("low")), "high": F.when(F.col("off") > 0, F.least("high", "tilt")).otherwise(F.col("high"))})
        step = F.col("tilt") - F.when(F.col("slope") > 0, (F.col("words") - F.col("target")) / F.col("slope"))
        inside = (step > F.col("low")) & (step < F.col("high")) & (F.abs(step - F.col("tilt")) <= 4)
        bounded = (F.col("low") > float("-inf")) & (F.col("high") < float("inf"))
        other = F.when(bounded, (F.col("low") + F.col("high")) / 2).when(F.col("off") < 0, F.col("tilt") * 2 + 1).otherwise(F.col("tilt") * 2 - 1)
        done = F.abs("off") <= TOLERANCE
        state = cut(moved.select("source_key", F.when(done, F.col("tilt")).when(inside, step).otherwise(other).alias("tilt"), "low", "high", "off", "most", "target").coalesce(SOURCE_PARTS))
        if not (state.agg(F.max(F.abs("off"))).first()[0] or 0) > TOLERANCE:
            break
    full = F.col("target") >= F.col("most") * (1 - 1e-12)
    return state.select("source_key", F.when(full, float("inf")).otherwise(F.round("tilt", 9)).alias("tilt"))


def rounded(classes: pd.DataFrame, cap: int) -> pd.DataFrame:
    """Whole copies for each size class of one source: from the largest size to the least, each class takes the
    copies nearest to its rates' sum plus what the larger ones left over, so the error ends below half the least size."""
    classes = classes.sort_values("size", ascending=False)
    left, copies = 0.0, []
    for size, n, rate in zip(classes["size"], classes["n"], classes["rate"], strict=True):
        want = n * rate * size + left
        got = min(max(int(np.floor(want / size + 0.5)), 0), cap * n) if size else n
        left = want - got * size
        copies.append(got)
    return classes.assign(copies=copies)[["source_key", "size", "n", "start", "copies"]]


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, the ``carry`` columns, source, size, source_size, target, rate double, copies long.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all words; a
    target stops at ``cap`` times its source. The dual of the entropy problem gives every document its rate;
    documents of one source and size share it, so rounding needs only the (source, size) classes: each class
    gets whole copies, and its documents get the quotient each and, in order of a hash of the id, the
    remainder one more. A class of any size is ranked by a range shuffle, not in one task; a source's classes
    are as many as its distinct sizes, bounded by the longest document.

    Nulls: a null source is a source; a null text has size 0; a null id sorts first. Repeated rows are documents of
    their own. Documents without words get one copy, which takes no words. An empty table gives an empty
    result. Equal input gives equal output.
    """
    kept = [f"_c{i}" for i in range(len(carry))]
    rows, plan = planned(docs, id_col, source_col, size if size is not None else size_of(F.col("text")), weights, share, cap, carry)
    out = rows.join(small(plan), ["source_key", "size"])
    copies = F.floor(F.col("copies") / F.col("n")) + (F.col("position") - F.col("start") < F.col("copies") % F.col("n")).cast("bigint")
    return out.select(F.col("_id").alias(id_col), *[F.col(k).alias(c) for c, k in zip(carry, kept, strict=True)], F.col("_source").alias(source_col), "size", "source_size", "target", "rate", copies.alias("copies"))


def source_key(source: Column) -> Column:
    """A string in the order of sources, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def planned(docs: DataFrame, id_col: str, source_col: str, count: Column, weights: tuple[float, ...], share: float, cap: int, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The narrow rows of ``docs`` with their positions in order of (source, size, hash of the id), and the plan of each (source_key, size) class: its
    rows n from ``start`` on, the copies that they get together, rate, source_size and target."""
    hashed = F.xxhash64(F.col("_id").cast("string"))
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("_source"), count.alias("size"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)])
    kept = [f"_c{i}" for i in range(len(carry))]
    rows = positions(base.withColumn("source_key", source_key(F.col("_source"))).withColumn("_hash", hashed), "source_key", "size", "_hash", "_id", *kept)

    classes = cut(rows.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("start")))
    totals = classes.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    sources = cut(targets(positions(totals, "source_key", name="place"), weights, share, cap))
    tilt = tilts(classes, sources, cap)

    per_source = sources.select("source_key", "source_size", "target", "n_docs").join(tilt, "source_key", "left")
    x = F.col("size") * F.col("n_docs") / F.col("source_size")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") <= 0, 0.0).when(F.col("tilt") == float("inf"), float(cap)).otherwise(F.exp(F.least(F.col("tilt") * x, F.lit(float(np.log(cap))))))
    rated = cut(classes.join(small(cut(per_source)), "source_key").withColumn("rate", rate))
    whole = cut(rated.select("source_key", "size", "n", "start", "rate").groupBy("source_key").applyInPandas(lambda pdf: rounded(pdf, cap), "source_key string, size bigint, n bigint, start bigint, copies bigint"))

    plan = rated.select("source_key", "size", "source_size", "target", "rate").join(whole, ["source_key", "size"])
    return rows, cut(plan)


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """``docs`` itself in the mix: each row as often as its copies say, none if zero.

    A row finds its copies by its source and size, whose class has a number for all and an edge: rows before it, in order of
    (hash of the id, id, hash of the text), get one more. So only classes are sent to the rows, texts stay where they are, and rows that share
    an id get copies each on its own. Rows equal in all of these that stand on an edge are told apart by their JSON form.
    """
    words = size_of(F.col(f"`{text_col}`"))
    order = F.struct("_hash", "_id", "_text_hash")
    keys = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("_source"), words.alias("size"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("_text_hash"))
    ranked, plan = planned(keys, "_id", "_source", F.col("size"), weights, share, cap, ("_text_hash",))
    ranked = ranked.join(small(plan), ["source_key", "size"]).withColumn("more", F.col("copies") % F.col("n")).withColumn("rank", F.col("position") - F.col("start")).withColumnRenamed("_c0", "_text_hash")
    edges = cut(ranked.where("more > 0 AND rank = more").select("source_key", "size", order.alias("edge")))
    upto = ranked.where("rank < more").join(small(edges), ["source_key", "size"]).where(order == F.col("edge")).groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("on_edge"))
    each = F.floor(F.col("copies") / F.col("n")).alias("each")
    table = cut(plan.select("source_key", "size", each).join(edges, ["source_key", "size"], "left").join(upto, ["source_key", "size"], "left"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), source_key(F.col(f"`{source_col}`")).alias("source_key"), words.alias("size"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("_text_hash"))
    rows = rows.withColumn("_hash", F.xxhash64(F.col("_id").cast("string"))).join(small(table), ["source_key", "size"])
    on_edge = F.col("on_edge").isNotNull() & (order == F.col("edge"))
    before = F.coalesce(order < F.col("edge"), F.lit(False)).cast("bigint")
    out = rows.where(~on_edge).select("_row", (F.col("each") + before).alias("copies"))
    if not table.where("on_edge IS NOT NULL").isEmpty():
        place = F.row_number().over(Window.partitionBy("source_key", "size").orderBy(F.to_json("_row")))
        out = out.unionByName(rows.where(on_edge).withColumn("place", place).select("_row", (F.col("each") + (F.col("place") <= F.col("on_edge")).cast("bigint")).alias("copies")))
    return out.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("_row.*")
