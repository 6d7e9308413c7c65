"""Prefix trie of conversations by prefix doubling (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.cluster import cut
from tidemark.llm.scans import scan

#: Conversation ids in one piece of a node's list.
PIECE = 4096


def turns_of(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, at, mark, n): each turn with its place from 0 in its conversation, the SHA-256 of its role and text, and the
    text's code points. Texts themselves are not moved.

    Turns go by ``turn``, null first, those of one number by their mark. Null roles and texts are empty; rows without a
    conversation id belong to no conversation and are left out. Repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    mark = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), mark.alias("mark"), F.length(text).cast("bigint").alias("n"))
    placed = scan(rows.where("conv IS NOT NULL"), ["conv"], ["turn", "mark"])
    return placed.select("conv", F.col("place").alias("at"), "mark", "n")


def spliced(turns: DataFrame, width: int = 100, most: int = 6) -> DataFrame:
    """Rows as ``turns_of`` gives them (and a row with ``at`` -1 for each conversation, so that turnless ones are known): each conversation c
    with the first h turns of conversation c - c % width (all if it has fewer, none if it is absent) and then its own after its first h, h
    being the unsigned CRC-32 of c's decimal digits modulo ``most``. A conversation lends to fewer than 2 * width others."""
    h = F.crc32(F.encode(F.col("conv").cast("string"), "utf-8")) % most
    convs = turns.where("at = 0").select("conv", (F.col("conv") - F.col("conv") % width).alias("base"), h.alias("h"))
    lent = turns.where((F.col("conv") % width == 0) & (F.col("at") < most)).select(F.col("conv").alias("base"), "at", "mark", "n")
    lent = convs.join(lent, "base").where("at < h").select("conv", F.lit(0).alias("source"), "at", "mark", "n")
    own = turns.where(F.col("at") >= h).select("conv", F.lit(1).alias("source"), "at", "mark", "n")
    tops = convs.select("conv", F.lit(-1).alias("source"), F.lit(-1).cast("bigint").alias("at"), F.lit(None).cast("binary").alias("mark"), F.lit(0).cast("bigint").alias("n"))
    return tops.union(lent).union(own)


def prefix_names(rows: DataFrame) -> DataFrame:
    """(conv, d, least) for rows (conv, d, mark): for each conversation and each d up to its length, the least conversation that begins with the same d turns.

    Blocks of 1, 2, 4 ... turns get dense names, each round pairing the names of the round before; a prefix is named from the
    name of the prefix without its last block of a power of two and that block's. So rounds grow with the logarithm of the longest conversation, and
    each prefix and block is named once. Names come from a sort, in which rows of a name stand by conversation, so the first is the least.
    """
    turns = rows.where("d > 0")
    named = scan(turns.select("conv", "d", "mark"), ["mark"], ["conv", "d"])
    blocks = [named.select("conv", (F.col("d") - 1).alias("j"), "name")]
    top = rows.agg(F.max("d"), F.min("conv")).first()
    for _ in range(1, max(top[0] or 0, 1).bit_length()):
        halves = [F.max(F.when(F.col("j") % 2 == i, F.col("name"))).alias(x) for i, x in enumerate("ab")]
        pairs = blocks[-1].groupBy("conv", F.shiftright("j", 1).alias("j")).agg(*halves).where("b IS NOT NULL")
        blocks.append(scan(pairs, ["a", "b"], ["conv", "j"]).select("conv", "j", "name"))
    known = rows.where("d = 0").select("conv", "d", F.lit(0).cast("bigint").alias("name"), F.lit(top[1]).cast("bigint").alias("least"))
    for k in reversed(range(len(blocks))):
        block = blocks[k].where("j % 2 = 0").select("conv", F.shiftleft("j", k).alias("d"), F.col("name").alias("b"))
        longer = known.join(block, ["conv", "d"]).select("conv", (F.col("d") + (1 << k)).alias("d"), F.col("name").alias("a"), "b")
        found = scan(longer, ["d", "a", "b"], ["conv"], firsts=["conv"])
        known = known.union(found.select("conv", "d", "name", F.col("first_conv").alias("least")))
    return known.select("conv", "d", "least")


def list_digests(rows: DataFrame) -> DataFrame:
    """(d, least, ends_sha256) for rows (d, least, conv): the SHA-256 of each node's conversations, ascending, as decimals with commas.

    A range shuffle splits the ids of a node of any size over tasks, which make sorted pieces of up to PIECE ids. A digest is sequential by
    nature, so the pieces of one node pass through one task, one after another; none is held longer than it is hashed.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            run: list[int] = []
            before = None
            for d, least, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if run and ((d, least) != before or len(run) == PIECE):
                    out.append((*before, run[0], ",".join(map(str, run))))
                    run = []
                before = (d, least)
                run.append(conv)
            if run:
                out.append((*before, run[0], ",".join(map(str, run))))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["d", "least", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for d, least, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (d, least) != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (d, least), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield rows_of(out)
        if key is not None:
            yield rows_of([(*key, digest.hexdigest())])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["d", "least", "ends_sha256"])

    sorted_ids = rows.select("d", "least", "conv").repartitionByRange("d", "least", "conv").sortWithinPartitions("d", "least", "conv")
    found = sorted_ids.mapInArrow(pieces, "d bigint, least bigint, first bigint, ids string")
    return found.repartition("d", "least").sortWithinPartitions("d", "least", "first").mapInArrow(digests, "d bigint, least bigint, ends_sha256 string")


def nodes(turns: DataFrame) -> DataFrame:
    """The trie of conversations given as rows (conv, source, at, mark, n), in order of source and at, each with a top row that is no turn and
    comes first: a row per node, with the columns of op11_prefix_trie.

    A node is named by its depth and its least member. A member owns its rows from the depth on from which it is the least; so what a
    subtree holds is the sum, over the members of its top, of what stands at and below that depth in their own rows: one scan from the
    ends of the conversations and one aggregate, with no step over ancestors. No join has a key of more than a row on either side.

    No conversations give no nodes. Repeated conversations are members of the same nodes.
    """
    placed = scan(turns, ["conv"], ["source", "at"])
    rows = placed.select("conv", F.col("place").alias("d"), "mark", "n", "ends")
    names = prefix_names(rows)
    rows = cut(rows.drop("mark").join(names, ["conv", "d"]))
    counts = rows.groupBy("d", "least").agg(F.count(F.lit(1)).alias("n_convs"), F.count_if("ends").alias("n_ends"))
    leaves = counts.where("n_ends = n_convs").select("d", F.col("least").alias("conv"), F.lit(1).cast("bigint").alias("leaf"))
    own = F.col("least") == F.col("conv")
    marked = rows.join(leaves, ["conv", "d"], "left").select("conv", "d", "least", (-F.col("d")).alias("up"), F.when(own, 0).otherwise(F.col("n")).cast("bigint").alias("saved"), F.coalesce("leaf", F.lit(0).cast("bigint")).alias("leaf"))
    below = scan(marked, ["conv"], ["up"], sums=["saved", "leaf"])
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    blank = {"n_convs": zero, "n_children": zero, "n_leaves": zero, "saved_tokens": zero, "parent_conv_id": none, "ends_sha256": F.lit(None).cast("string")}

    def part(df: DataFrame, d, least, **values) -> DataFrame:
        return df.select(d.alias("d"), least.alias("least"), *[values.get(k, v).alias(k) for k, v in blank.items()])

    d, one = F.col("d"), F.lit(1).cast("bigint")
    above = rows.select("conv", (d + 1).alias("d"), F.col("least").alias("parent"))
    children = cut(rows.where(own & (d > 0)).select("conv", "d").join(above, ["conv", "d"]))
    parts = part(below, d, F.col("least"), n_convs=one, n_leaves=F.col("before_leaf") + F.col("leaf"), saved_tokens=F.col("before_saved") + F.col("saved"))
    parts = parts.union(part(children, d, F.col("conv"), parent_conv_id=F.col("parent"))).union(part(children, d - 1, F.col("parent"), n_children=one))
    parts = parts.union(part(list_digests(rows.where("ends")), d, F.col("least"), ends_sha256=F.col("ends_sha256")))
    whole = parts.groupBy("d", "least").agg(*[(F.max if k in ("parent_conv_id", "ends_sha256") else F.sum)(k).alias(k) for k in blank])
    return whole.select(
        F.col("least").alias("conv_id"), d.alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
