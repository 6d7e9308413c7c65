"""Near-duplicates by SimHash, and complete for any Jaccard similarity of word shingles (the pipeline's near-dedup).

Each text has a 64-bit SimHash fingerprint of its shingles. Fingerprints within RADIUS bits are found by
multi-index hashing (``simhash.links``), their whole sets verify the similarity, and the components of these links
are the first groups. At similarity 0.8 fingerprints differ in about ten bits, and no index of segments finds
all such pairs without comparing a fixed share of all pairs. So an exact search follows between the groups: its candidates
come from prefixes of the shingle sets in one global order, which two sets of the wanted similarity must share. Parity bitmaps, whose Hamming
distance is never above the sets' difference, sort most of them out; whole sets verify the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.cluster import components, cut, small, without
from tidemark.llm.simhash import BATCH_BYTES, links, majorities, shingle_hashes
from tidemark.llm.texts import bounded, slices

#: Differing bits of two fingerprints that are looked for.
RADIUS = 3
#: One text in SAMPLE (by hash) shows which shingles are common: those in FREQUENT sampled texts, at most COMMON
#: of them. They only come last in the global order; any order gives the same groups.
SAMPLE, FREQUENT, COMMON = 32, 3, 100_000
#: Members of a key whose pairs one task looks at together; larger keys are split into pairs of such blocks.
BLOCK = 1024
#: Words of the bitmap that a row of a key has with it; pairs that stay are compared by whole bitmaps afterwards.
MARK = 8
#: Pairs held in arrays at once.
PAIRS = 1 << 16
#: Slack of comparisons with products of a threshold.
SLACK = 1e-9


def shingle_sets(text: pa.Array, shingle: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending, as int64."""
    return _sets(*shingle_hashes(text, shingle))


def _sets(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return [np.unique(x) for x in np.split(hashes.view(np.int64), np.cumsum(counts)[:-1])] if len(counts) else []


def parity(values: np.ndarray, most: int | None = None) -> np.ndarray:
    """A bitmap of about two bits for each element (of ``most`` words at most), a bit being the parity of the elements that fall on it, as int64 words.

    Half of the words, xored with the other half, is the bitmap of half the width.
    """
    words = 1 << max(0, math.ceil(math.log2(max(2 * len(values), 64) / 64)))
    words = min(words, most or words)
    odd = np.bincount(values & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _mapped(docs: DataFrame, id_col: str, text_col: str, schema: str, build) -> DataFrame:
    """Rows of ``build(ids, texts)``, arrays by name, over the batches of ``docs``."""
    narrow = bounded(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            got = build(batch.column("id"), batch.column("text"))
            yield pa.RecordBatch.from_arrays(list(got.values()), list(got))

    return narrow.mapInArrow(run, schema.format(id=narrow.schema["id"].dataType.simpleString()))


def _node(values: np.ndarray) -> int:
    """A set's name, equal for equal sets."""
    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


def _lists(values: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64()))


def common_shingles(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> np.ndarray:
    """Hashes of frequent shingles, the rarest first."""
    sampled = docs.where(F.pmod(F.xxhash64(F.col(f"`{text_col}`").cast("string")), F.lit(SAMPLE)) == 0)
    sets = _mapped(sampled, id_col, text_col, "shingle bigint", lambda ids, text: {"shingle": pa.array(np.concatenate([np.zeros(0, np.int64), *shingle_sets(text, shingle)]), pa.int64())})
    found = sets.groupBy("shingle").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "shingle").limit(COMMON)
    return found.toArrow()["shingle"].to_numpy()[::-1].copy()


def prefixes(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Rows (id, node, fingerprint, n, bits, mark, keys), one per row of ``docs``: the name of its set of shingles, its SimHash, the set's size, bitmaps and prefix.

    The order is by hash, frequent shingles last. Sets of similarity t share an element among the first
    n - ceil(t n) + 1 of each.
    """
    common = common_shingles(docs, id_col, text_col, shingle)
    by_hash = np.argsort(common)
    listed = common[by_hash]

    def prefix(values: np.ndarray) -> np.ndarray:
        length = len(values) - math.ceil(similarity * len(values) - SLACK) + 1 if len(values) else 0
        if not len(listed) or not length:
            return values[:length]
        at = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
        frequent = listed[at] == values
        rare = values[~frequent]
        if len(rare) >= length:
            return rare[:length]
        return np.concatenate((rare, common[np.sort(by_hash[at[frequent]])[: length - len(rare)]]))

    def build(ids: pa.Array, text: pa.Array) -> dict[str, pa.Array]:
        hashes, counts = shingle_hashes(text, shingle)
        sets = _sets(hashes, counts)
        return {"id": ids, "node": pa.array([_node(x) for x in sets], pa.int64()), "fingerprint": pa.array(majorities(hashes, counts), pa.int64()), "n": pa.array([len(x) for x in sets], pa.int32()), "bits": _lists([parity(x) for x in sets]), "mark": _lists([parity(x, MARK) for x in sets]), "keys": _lists([prefix(x) for x in sets])}

    return _mapped(docs, id_col, text_col, "id {id}, node bigint, fingerprint bigint, n int, bits array<bigint>, mark array<bigint>, keys array<bigint>", build)


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of ``nodes`` (node, fingerprint) by SimHash: each node with the least one of its fingerprint, and the least ones of fingerprints within RADIUS bits."""
    prints = cut(nodes.groupBy("fingerprint").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("nodes")))
    shared = small(cut(prints.where("nodes > 1").select(F.col("fingerprint").alias("_f"), "least")))
    equal = nodes.join(shared, F.col("fingerprint") == F.col("_f")).select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = small(cut(links(prints.select("fingerprint"), RADIUS).select(F.least("u", "v").alias("f"), F.greatest("u", "v").alias("g")).distinct()))
    for side, name in (("f", "a"), ("g", "b")):
        near = prints.select(F.col("fingerprint").alias(side), F.col("least").alias(name)).join(near, side)
    both = equal.union(near.select("a", "b")).where("a != b")
    return both.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of the ``pairs`` (u, v) that do not lie in one component of ``labels`` (node, label)."""
    for side in ("u", "v"):
        pairs = pairs.join(small(labels.select(F.col("node").alias(f"_{side}"), F.col("label").alias(f"label_{side}"))), F.col(side) == F.col(f"_{side}"), "left")
    return pairs.where("label_u IS NULL OR label_v IS NULL OR label_u != label_v").select("u", "v")


def _reachable(n_u, pos_u, n_v, pos_v, similarity: float, least):
    """Whether sets of sizes n_u and n_v whose first common elements are their pos_u-th and pos_v-th can be similar (columns or arrays)."""
    return least(n_u - pos_u, n_v - pos_v) * (1 + similarity) + SLACK >= (n_u + n_v) * similarity


def _near_bits(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of the ``pairs`` (u, v) whose bitmaps do not show too large a difference. nodes: (node, n, bits)."""
    for side in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)

    def to_width_of(own: str, other: str) -> Column:
        half = F.floor(F.size(own) / 2).cast("int")
        return F.when(F.size(own) > F.size(other), F.zip_with(F.slice(own, 1, half), F.slice(own, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(F.col(own))

    apart = F.zip_with(to_width_of("bits_u", "bits_v"), to_width_of("bits_v", "bits_u"), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    apart = F.aggregate(apart, F.lit(0), lambda total, x: total + x)
    return pairs.where(apart * (1 + similarity) <= (F.col("n_u") + F.col("n_v")) * (1 - similarity) + SLACK).select("u", "v")


def _verified(pairs: DataFrame, docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Those of the distinct ``pairs`` (u, v) whose whole sets have the similarity."""
    pairs = cut(pairs)
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = small(cut(ids.join(nodes, "node", "left_semi").select(F.col("id").alias("_wanted")).distinct()))
    read = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(wanted, F.col("_id").eqNullSafe(F.col("_wanted")), "left_semi")

    def build(ids: pa.Array, text: pa.Array) -> dict[str, pa.Array]:
        sets = shingle_sets(text, shingle)
        return {"node": pa.array([_node(x) for x in sets], pa.int64()), "set": _lists(sets)}

    sets = _mapped(read, "_id", "_text", "node bigint, set array<bigint>", build).dropDuplicates(["node"])
    sets = cut(sets.join(nodes, "node", "left_semi"))
    left, right = sets.select(F.col("node").alias("u"), F.col("set").alias("a")), sets.select(F.col("node").alias("v"), F.col("set").alias("b"))
    both = pairs.join(left, "u").join(right, "v").withColumn("common", F.size(F.array_intersect("a", "b")))
    alike = F.col("common") * (1 + similarity) + SLACK >= similarity * (F.size("a") + F.size("b"))
    return cut(both.where(alike).select("u", "v"))


def _within(rows: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of ``rows`` (sorted by key, lo, hi) that stand under one key, have other labels, and can be similar."""
    key, lo, hi, block, n, pos, label = (rows.column(c).to_numpy() for c in ("key", "lo", "hi", "block", "n", "pos", "label"))
    bits = rows.column("mark").combine_chunks()
    words, at, flat = np.diff(bits.offsets.to_numpy()), bits.offsets.to_numpy()[:-1], bits.values.to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
    later = np.repeat(np.append(starts[1:], len(key)), np.diff(np.append(starts, len(key)))) - np.arange(len(key)) - 1
    ends, first = np.cumsum(later), 0
    while first < len(key):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
        own = later[first:last]
        u = np.repeat(np.arange(first, last), own)
        v = u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(own) - own, own)
        first = last
        good = (label[u] != label[v]) & ((lo[u] == hi[u]) | (block[u] != block[v]))
        u, v = u[good], v[good]
        good = _reachable(n[u], pos[u], n[v], pos[v], similarity, np.minimum)
        u, v = u[good], v[good]
        near = np.zeros(len(u), dtype=bool)
        for w in np.unique(np.minimum(words[u], words[v])):
            some = np.flatnonzero(np.minimum(words[u], words[v]) == w)
            folded = []
            for side in (u[some], v[some]):
                twice = (words[side] > w)[:, None]
                place = at[side][:, None] + np.arange(w)
                folded.append(flat[place] ^ np.where(twice, flat[np.where(twice, place + w, place)], 0))
            apart = np.bitwise_count((folded[0] ^ folded[1]).view(np.uint64)).sum(axis=1, dtype=np.int64)  # of a negative number it would count the bits of the absolute value
            near[some] = apart * (1 + similarity) <= (n[u[some]] + n[v[some]]) * (1 - similarity) + SLACK
        yield u[near], v[near]


def _open_pairs(met: DataFrame, similarity: float) -> DataFrame:
    """Distinct candidate pairs (u, v) of ``met`` (key, node, n, pos, label, mark) whose labels differ, by blocks of each key."""
    own = Window.partitionBy("key")
    placed = met.withColumns({"block": F.floor((F.row_number().over(own.orderBy("node")) - 1) / BLOCK).cast("int"), "blocks": F.ceil(F.count(F.lit(1)).over(own) / BLOCK).cast("int")})
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    dealt = dealt.select("key", "lo", "hi", "block", "node", "n", "pos", "label", "mark").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in chain(batches, [None]):
            rows = held if batch is None else pa.concat_tables([*([held] if held else []), pa.Table.from_batches([batch])])
            if rows is None or not rows.num_rows:
                continue
            ends = rows.num_rows
            if batch is not None:  # the last key may go on in the next batch
                same = np.ones(ends, dtype=bool)
                for c in ("key", "lo", "hi"):
                    values = rows.column(c).to_numpy()
                    same &= values == values[-1]
                ends = int(np.argmax(same))
            held = rows.slice(ends)
            if ends:
                node = rows.column("node").to_numpy()
                for u, v in _within(rows.slice(0, ends), similarity):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[u], node[v])), pa.array(np.maximum(node[u], node[v]))], ["u", "v"])

    return dealt.mapInArrow(run, "u bigint, v bigint").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: id, component_id, the least id reachable over pairs of at least the similarity.

    Equal sets are one node. Nodes of near SimHash fingerprints are compared first; what they link needs no further pairs. Then the members of
    each key of the prefixes are compared with the one before them and with the
    first, in order of where the key stands in them, so that the least altered copy of a group of near copies
    gathers the others without pairs; then all pairs under a key that are still in different components and whose
    bitmaps are near are compared. No candidate is left out.
    Nulls: a null text is empty (empty texts are alike); a null id is ignored when the least is taken, and
    component_id is null if a component has only such ids. Repeated rows give repeated rows.
    """
    rows = cut(prefixes(docs, id_col, text_col, shingle, similarity).withColumn("row", F.monotonically_increasing_id()))
    ids = cut(rows.groupBy("node").agg(F.min("id").alias("id"), F.min("row").alias("first"), F.count(F.lit(1)).alias("copies")))
    several = small(cut(ids.where("copies > 1").select(F.col("node").alias("_s"), "first")))
    nodes = rows.join(several, F.col("node") == F.col("_s"), "left").where("first IS NULL OR first = row").select("node", "fingerprint", "n", "bits", "mark", "keys")
    check = (docs, ids, id_col, text_col, shingle, similarity)
    by_print = _verified(fingerprint_pairs(nodes), *check)
    grouped = components(by_print)

    table = nodes.select("node", "n", F.posexplode("keys").alias("pos", "key"))
    met = cut(table.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("members > 1").drop("members"))

    order = Window.partitionBy("key").orderBy("pos", "n", "node")
    one = F.struct("node", "n", "pos")
    chained = met.withColumns({"leader": F.first(one).over(order), "before": F.lag(one).over(order)})
    chained = chained.select("node", "n", "pos", F.explode(F.array_distinct(F.array("leader", "before"))).alias("a")).where(F.col("a.node") != F.col("node"))
    first = chained.where(_reachable(F.col("a.n"), F.col("a.pos"), F.col("n"), F.col("pos"), similarity, F.least))
    first = cut(_between(first.select(F.least("a.node", "node").alias("u"), F.greatest("a.node", "node").alias("v")).distinct(), grouped))
    bits = cut(nodes.select("node", "n", "bits", "mark").join(met.select("node").distinct(), "node", "left_semi"))
    linked = by_print.union(_verified(_near_bits(first, bits, similarity), *check))
    labels = components(linked)
    marked = met.join(small(labels).withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("key", "node", "n", "pos", F.coalesce("label", "node").alias("label"))
    mixed = marked.groupBy(F.col("key").alias("_k")).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("_k")
    marked = marked.join(mixed, F.col("key") == F.col("_k"), "left_semi").join(bits.select(F.col("node").alias("_b"), "mark"), F.col("node") == F.col("_b")).drop("_b")
    rest = cut(_open_pairs(marked, similarity).join(first, ["u", "v"], "left_anti"))
    labels = components(linked.union(_verified(_near_bits(rest, bits, similarity), *check)))
    named = cut(ids.join(labels, "node").select("node", "id", "label"))
    best = named.groupBy("label").agg(F.min("id").alias("best"))
    moved = small(cut(named.join(best, "label").select(F.col("node").alias("_m"), "best")))
    copies = ids.select(F.col("node").alias("_c"), F.col("id").alias("least"))
    out = rows.select("id", "node").join(small(copies), F.col("node") == F.col("_c")).join(moved, F.col("node") == F.col("_m"), "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("_m").isNotNull(), F.col("best")).otherwise(F.col("least")).alias("component_id"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one document, that of the least id, left of each group of near-duplicates.

    A row whose id is null stays only if its group has no other id. Rows that repeat one id stay together, and go if one of them goes.
    """
    found = groups(docs, id_col, text_col, shingle, similarity).select(F.col(f"`{id_col}`").alias("_id"), F.col("component_id").alias("_best"))
    return without(docs, id_col, found.where(~F.col("_id").eqNullSafe(F.col("_best"))).select("_id").distinct())
