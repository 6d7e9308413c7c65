"""SimHash near-duplicates by multi-index hashing (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.cluster import components, cut, small, tasks, without
from tidemark.llm.texts import bounded, slices, sums, words

#: Fingerprint bits, and those of one of the two segments: prints within 2 bits are within 1 bit in one of them.
BITS, SEGMENT = 64, 32
#: Fingerprints of one segment value up to which the table's entry is matched as it is; fuller ones are refined.
BUCKET = 64
#: Bytes of text whose shingles are unpacked to bits at once.
BATCH_BYTES = 1 << 20


def shingle_hashes(text: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 with seed 42 of each text's ``shingle``-word shingles, repeats included, and the number of each text."""
    flat, bounds = words(pc.ascii_lower(text))
    sizes = np.diff(bounds)
    data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), " ")[0].as_buffer().to_pybytes() if len(flat) else b""
    lengths = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    counts = np.where(sizes >= shingle, sizes - shingle + 1, np.minimum(sizes, 1))
    of = np.repeat(np.arange(len(sizes)), counts)
    at = np.concatenate(([0], np.cumsum(counts)))
    first = bounds[:-1][of] + np.arange(at[-1]) - at[:-1][of]
    last = first + np.minimum(sizes, shingle)[of] - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(data[s:e], 42) for s, e in zip(starts[first].tolist(), ends[last].tolist(), strict=True)], dtype=np.uint64)
    return hashes, counts


def fingerprints(text: pa.Array, shingle: int) -> np.ndarray:
    """The SimHash of each text as int64, over its ``shingle``-word shingles."""
    return majorities(*shingle_hashes(text, shingle))


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of each text's ``counts`` hashes, as int64."""
    at = np.concatenate(([0], np.cumsum(counts)))
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    result = np.zeros(len(counts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        ones = np.add.reduceat(bits, at[:-1][some], axis=0, dtype=np.int32)
        major = 2 * ones > counts[some][:, None]
        result[some] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return result.view(np.int64)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (id, fingerprint long), one per row of ``docs``."""
    narrow = bounded(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fingerprints(batch.column("text"), shingle))], ["id", "fingerprint"])

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, fingerprint bigint")


def flips(bits: int) -> list[int]:
    """0 and the numbers with one of ``bits`` bits, as signed 64-bit numbers."""
    return [0] + [1 << b if b < 63 else -(1 << 63) for b in range(bits)]


def segment(number: int) -> Column:
    """The value of a fingerprint's segment."""
    return F.shiftrightunsigned("fingerprint", SEGMENT * number).bitwiseAND(F.lit((1 << SEGMENT) - 1))


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) that connect exactly the distinct ``prints`` (fingerprint) within 2 differing bits of each other; with a ``radius`` of 3, which the balls
    of two segments cover too, also those within 3 bits, but for pairs that only meet in entries of more than BUCKET fingerprints.

    Each fingerprint stands in one table a segment, under its segment's value. Its ball of radius 1 in each
    segment is enumerated, the table's matches are fetched, and the complete distance of each is verified. Entries of
    more than BUCKET fingerprints are not fetched: a pair that only meets in such entries has both members
    in them, and these members meet in ``dense_links``.
    """
    table = prints.select("fingerprint", F.explode(F.array(*[F.struct(F.lit(n).alias("segment"), segment(n).alias("value")) for n in range(BITS // SEGMENT)])).alias("at")).select("fingerprint", "at.*")
    full = cut(table.groupBy("segment", "value").count().where(F.col("count") > BUCKET).select("segment", "value"))
    asked = table.select(F.col("fingerprint").alias("u"), "segment", F.explode(F.transform(F.array(*[F.lit(x) for x in flips(SEGMENT)]), lambda x: x.bitwiseXOR(F.col("value")))).alias("value"))
    entries = table.join(small(full), ["segment", "value"], "left_anti").withColumnRenamed("fingerprint", "v")
    met = asked.join(entries, ["segment", "value"]).select("u", "v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    if full.isEmpty():
        return met
    dense = table.join(small(full), ["segment", "value"], "left_semi").select("fingerprint").distinct()
    return met.union(dense_links(dense))


def dense_links(prints: DataFrame) -> DataFrame:
    """What ``links`` gives, for fingerprints of which thousands share a segment.

    The key is refined to both segments: each fingerprint stands under all values that its whole ball of radius 1
    has. Two are within 2 bits just if they meet under a key, so a key holds at most 65 of them however dense
    the data are, and its members, each compared with the one before it, are linked by a chain instead of all pairs.
    """
    table = prints.select("fingerprint", F.explode(F.array(*[F.col("fingerprint").bitwiseXOR(F.lit(x)) for x in flips(BITS)])).alias("key"))
    before = F.lag("fingerprint").over(Window.partitionBy("key").orderBy("fingerprint"))
    met = table.select(F.col("fingerprint").alias("u"), before.alias("v")).where("v is not null")
    return met.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint string (16 hex digits), component_id (the least id reachable).

    Equal fingerprints are one node, so copies cost nothing; only fingerprints with a partner enter the
    component rounds. Nulls: a null text is empty (fingerprint zero, linked like any other); a null id is
    ignored when the least is taken, and component_id is null if a component has only such ids. Repeated rows
    give repeated rows, extra columns are ignored, an empty table gives an empty result.
    """
    rows = cut(with_fingerprints(docs, id_col, text_col, shingle))
    prints = cut(rows.groupBy("fingerprint").agg(F.min("id").alias("least")).repartition(tasks(docs.sparkSession)))
    labels = components(links(prints.select("fingerprint")))
    linked = prints.join(labels, prints.fingerprint == labels.node).select("fingerprint", "label", "least")
    best = linked.groupBy("label").agg(F.min("least").alias("best"))
    moved = small(cut(linked.join(best, "label").select(F.col("fingerprint").alias("_f"), "best")))
    own = small(prints.select(F.col("fingerprint").alias("_g"), "least"))
    out = rows.join(own, F.col("fingerprint") == F.col("_g")).join(moved, F.col("fingerprint") == F.col("_f"), "left")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), F.when(F.col("_f").isNotNull(), F.col("best")).otherwise(F.col("least")).alias("component_id"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` with one document, that of the least id, left of each near-duplicate group.

    A row whose id is null stays only if its group has no other id. Rows that repeat one id stay together, and go if one of them goes.
    """
    groups = near_groups(docs, id_col, text_col, shingle).select(F.col(f"`{id_col}`").alias("_id"), F.col("component_id").alias("_best"))
    return without(docs, id_col, groups.where(~F.col("_id").eqNullSafe(F.col("_best"))).select("_id").distinct())
