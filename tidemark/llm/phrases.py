"""Phrase collocations from depth-limited count tries (operator 13)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.cluster import cut, lookup, tasks
from tidemark.llm.texts import bounded, slices

#: Words of the longest phrases: the depth of the tries.
DEPTH = 3
#: Words that a task gathers into one trie, and nodes that a merge holds before it sums up what it has.
SHARD_WORDS, MERGE_NODES = 1_000_000, 1_500_000
#: Prefix ranges, each merged by a task, for each task of a shuffle by default.
RANGES = 3
#: Bytes of serialised blocks in a batch, about.
BLOCK_BYTES = 1 << 20
#: Texts that show where the prefix ranges should be cut (a sample: it only balances the tasks), and most keys from 4 MB of them.
SAMPLE_TEXTS, SAMPLE_KEYS = 4000, 2000

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


class Trie(NamedTuple):
    """Levels of a count trie in the order of a walk from the root, words and languages as places in sorted lists. A node below
    level one names its parent by place; -1 is the parent that a prefix range begins under."""

    langs: pa.Array
    words: pa.Array
    lang: np.ndarray
    word: tuple[np.ndarray, ...]
    up: tuple[np.ndarray, ...]
    count: tuple[np.ndarray, ...]


def tokens(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts, A-Z in lower case; the text of each; and whether the next word follows in the same piece."""
    ended = pc.binary_join_element_wise(pc.ascii_lower(text), "", "\n")
    bounds = np.frombuffer(ended.buffers()[1], np.int32)[ended.offset : ended.offset + len(ended) + 1].astype(np.int64)
    data = np.frombuffer(ended.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if len(ended) else np.zeros(0, np.uint8)
    kind = _KIND[data]
    inside = np.concatenate(([False], kind == 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[kind == 0]))
    breaks = np.cumsum(kind == 2)
    follows = np.append(breaks[ends[:-1] - 1] == breaks[starts[1:]], False) if len(starts) else np.zeros(0, bool)
    return words, np.searchsorted(bounds - bounds[0], starts, side="right") - 1, follows


def summed(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes ascending, the sum of their counts (or how often they stand), and the place of each given code among them."""
    order = np.argsort(codes, kind="stable")  # merges runs that are sorted already
    sorted_codes = codes[order]
    new = np.append(True, sorted_codes[1:] != sorted_codes[:-1]) if len(codes) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    total = np.diff(np.append(first, len(codes))) if counts is None else np.add.reduceat(counts[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    place = np.empty(len(codes), np.int64)
    place[order] = np.cumsum(new) - 1
    return sorted_codes[first], total.astype(np.int64), place


def ranked(chunks: list[pa.DictionaryArray]) -> tuple[pa.Array, list[np.ndarray]]:
    """All values of the chunks once, in byte order, and each chunk as places among them."""
    whole = pa.chunked_array(chunks).unify_dictionaries()
    values = whole.chunk(0).dictionary
    order = pc.sort_indices(values.cast(pa.binary())).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return values.take(pa.array(order)), [rank[c.indices.to_numpy(zero_copy_only=False)] for c in whole.chunks]


def counted(chunks: list[tuple[pa.DictionaryArray, pa.DictionaryArray, np.ndarray]]) -> Trie:
    """The trie of a shard, from its words, their languages, and whether the next follows."""
    words, ids = ranked([c[0] for c in chunks])
    langs, of = ranked([c[1] for c in chunks])
    word, lang, follows = np.concatenate(ids), np.concatenate(of), np.concatenate([c[2] for c in chunks])
    size = len(words)
    codes, count, node = summed(lang * size + word)
    tops, levels, ups, counts, at = codes // size, [codes % size], [np.full(len(codes), -1)], [count], np.arange(len(word))
    for depth in range(1, DEPTH):
        on = follows[at + depth - 1]
        at, node = at[on], node[on]
        codes, count, node = summed(node * size + word[at + depth])
        levels, ups, counts = [*levels, codes % size], [*ups, codes // size], [*counts, count]
    return Trie(langs, words, tops, tuple(levels), tuple(ups), tuple(counts))


def merged(tries: list[Trie]) -> Trie:
    """One trie of the sums of several."""
    words, ids = ranked([t.words.dictionary_encode() for t in tries])
    langs, of = ranked([t.langs.dictionary_encode() for t in tries])
    size = max(len(words), 1)
    codes, count, node = summed(np.concatenate([of[i][t.lang] * size + ids[i][t.word[0]] for i, t in enumerate(tries)]), np.concatenate([t.count[0] for t in tries]))
    lang, levels, ups, counts = codes // size, [codes % size], [np.full(len(codes), -1)], [count]
    for depth in range(1, DEPTH):
        places = np.split(node, np.cumsum([len(t.word[depth - 1]) for t in tries])[:-1])
        up = [np.where(t.up[depth] >= 0, np.append(places[i], -1)[t.up[depth]], -1) for i, t in enumerate(tries)]
        codes, count, node = summed(np.concatenate([(up[i] + 1) * size + ids[i][t.word[depth]] for i, t in enumerate(tries)]), np.concatenate([t.count[depth] for t in tries]))
        levels, ups, counts = [*levels, codes % size], [*ups, codes // size - 1], [*counts, count]
    return Trie(langs, words, lang, tuple(levels), tuple(ups), tuple(counts))


def cuts(trie: Trie, bounds: list[tuple]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Where each bound (language and up to DEPTH words, the rest None) cuts each level of a trie, and the counts of the bound's own parents."""
    words, langs = trie.words.to_pylist(), trie.langs.to_pylist()
    wide = 2 * len(words) + 3

    def spot(values: list[str], value: str | None) -> int:  # odd among the values, even between them
        if value is None:
            return -1
        at = bisect_left(values, value)
        return 2 * at + (at < len(values) and values[at] == value)

    found = np.array([[spot(langs, b[0]), *[spot(words, w) for w in b[1:]]] for b in bounds], np.int64).reshape(-1, DEPTH + 1)
    above, places, parents = found[:, 0], [], []
    nodes = 2 * trie.lang + 1
    for depth in range(DEPTH):
        keys, bound = nodes * wide + 2 * trie.word[depth] + 2, above * wide + found[:, depth + 1] + 1
        low, high = np.searchsorted(keys, bound), np.searchsorted(keys, bound, side="right")
        deeper = found[:, depth + 2] >= 0 if depth + 1 < DEPTH else np.zeros(len(bounds), bool)
        same = (high > low) & deeper
        places.append(np.where(same, high, low))
        parents.append(np.where(same, np.append(trie.count[depth], 0)[np.where(same, low, -1)], 0))
        above = 2 * low + same
        nodes = 2 * trie.up[depth + 1] + 1 if depth + 1 < DEPTH else nodes
    return places, parents


def packed(trie: Trie, bounds: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The trie as serialised blocks, one for each prefix range that it has nodes of, or counts of the parents that the range begins under."""
    places, parents = cuts(trie, bounds)
    edges = [np.concatenate(([0], p, [len(trie.word[d])])) for d, p in enumerate(places)]
    rows, held = [], 0
    for r in range(len(bounds) + 1):
        begin = [int(parents[d][r - 1]) if r else 0 for d in range(DEPTH - 1)]
        spans = [slice(int(e[r]), int(e[r + 1])) for e in edges]
        if not any(begin) and all(s.start == s.stop for s in spans):
            continue
        used, ids = np.unique(np.concatenate([trie.word[d][s] for d, s in enumerate(spans)]), return_inverse=True)
        ids = np.split(ids.astype(np.int32), np.cumsum([s.stop - s.start for s in spans])[:-1])
        ups = [np.diff(np.maximum(trie.up[d][s] - spans[d - 1].start, -1), prepend=0).astype(np.int32) for d, s in enumerate(spans) if d]
        lang, known = np.unique(trie.lang[spans[0]], return_inverse=True)
        counts = [trie.count[d][s].astype(np.int32) for d, s in enumerate(spans)]  # a shard has fewer words than that
        rows.append((r, trie.langs.take(pa.array(lang)).to_pylist(), trie.words.take(pa.array(used)), [known.astype(np.int32).tobytes(), *[x.tobytes() for x in [*ids, *ups, *counts]]], begin))
        held += rows[-1][2].nbytes + sum(map(len, rows[-1][3]))
        if held > BLOCK_BYTES:
            yield block_rows(rows)
            rows, held = [], 0
    if rows:
        yield block_rows(rows)


def block_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.list_(pa.string())),
            pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x[2]) for x in rows]))), pa.int32()), pa.concat_arrays([x[2] for x in rows])),
            pa.array([x[3] for x in rows], pa.list_(pa.binary())), pa.array([x[4] for x in rows], pa.list_(pa.int64())),
        ], ["range", "langs", "words", "arrays", "begin"],
    )


BLOCK = "range int, langs array<string>, words array<string>, arrays array<binary>, begin array<bigint>"


def unpacked(batch: pa.RecordBatch, i: int) -> Trie:
    """The block in row ``i``."""
    arrays = batch.column(3)[i].values
    ints = [np.frombuffer(arrays[k].as_buffer(), np.int32) for k in range(3 * DEPTH)]
    ups = [np.full(len(ints[1]), -1, np.int32), *[np.cumsum(x, dtype=np.int32) for x in ints[DEPTH + 1 : 2 * DEPTH]]]
    return Trie(batch.column(1)[i].values, batch.column(2)[i].values, ints[0], tuple(ints[1 : DEPTH + 1]), tuple(ups), tuple(ints[2 * DEPTH :]))


def shards(texts: DataFrame, bounds: list[tuple]) -> DataFrame:
    """Pass one: each task's tries of (lang, text), SHARD_WORDS words each, in serialised sorted blocks by prefix range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, n = [], 0
        for batch in slices(batches, "text"):
            words, text, follows = tokens(batch.column("text"))
            lang = batch.column("lang").dictionary_encode()
            of = pa.DictionaryArray.from_arrays(lang.indices.take(pa.array(text)), lang.dictionary)
            chunks.append((words.dictionary_encode(), of, follows))
            n += len(words)
            if n >= SHARD_WORDS:
                yield from packed(counted(chunks), bounds)
                chunks, n = [], 0
        if n:
            yield from packed(counted(chunks), bounds)

    return texts.mapInArrow(run, BLOCK)


def range_bounds(texts: DataFrame, ranges: int) -> list[tuple]:
    """Keys that cut the order of all phrases into about equal prefix ranges: quantiles of keys from a bounded sample of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, text, follows = tokens(batch.column("text"))
            n = len(words)
            at = np.unique(np.linspace(0, n - 1, min(SAMPLE_KEYS, max(64, n // 16))).astype(np.int64)) if n else np.zeros(0, np.int64)
            two = follows[at]
            three = two & np.append(follows, False)[at + 1]
            columns = [batch.column("lang").take(pa.array(text[at])), words.take(pa.array(at))]
            columns += [words.take(pa.array(np.where(on, np.minimum(at + k, n - 1), 0), mask=~on)) for k, on in ((1, two), (2, three))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "w1", "w2", "w3"])

    rows = texts.count()
    sample = texts.sample(min(1.0, SAMPLE_TEXTS / rows), seed=7) if rows > SAMPLE_TEXTS else texts
    keys = {tuple(r) for r in sample.mapInArrow(run, "lang string, w1 string, w2 string, w3 string").collect()}
    ordered = sorted(keys, key=lambda k: tuple((x is not None, x or "") for x in k))
    return sorted({ordered[len(ordered) * i // ranges] for i in range(1, ranges)} if ordered else set(), key=lambda k: tuple((x is not None, x or "") for x in k))


def merge(blocks: DataFrame, bounds: list[tuple], least: int) -> DataFrame:
    """Pass two: each prefix range's blocks merged, and its trie walked: rows (lang, w1, w2, w3, a, l1, l2) of the nodes with a count ``a`` of ``least`` or
    more, with the counts of their parents of one and of two words; and a row for each language with all words counted so far as ``a``, without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, nodes, most, begin = None, [], 0, MERGE_NODES, np.zeros(DEPTH - 1, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.column(0)[i].as_py()
                held.append(unpacked(batch, i))
                begin = begin + np.array(batch.column(4)[i].as_py(), np.int64)
                nodes += sum(len(x) for x in held[-1].count)
                if nodes > most and len(held) > 1:
                    held = [merged(held)]
                    nodes, most = 0, max(MERGE_NODES, sum(len(x) for x in held[0].count))
        if held:
            yield walk(merged(held), r, begin)

    def walk(trie: Trie, r: int, begin: np.ndarray) -> pa.RecordBatch:
        bound = bounds[r - 1] if r else (None,) * (DEPTH + 1)
        langs, words = trie.langs.to_pylist(), trie.words
        columns: list[list[pa.Array]] = [[] for _ in range(7)]

        def put(lang: pa.Array, ws: list[pa.Array], a: np.ndarray, left: list[np.ndarray]) -> None:
            none, zero = pa.nulls(len(a), pa.string()), pa.nulls(len(a), pa.int64())
            got = [lang, *ws, *[none] * (DEPTH - len(ws)), pa.array(a), *[pa.array(x) for x in left], *[zero] * (DEPTH - 1 - len(left))]
            for c, x in zip(columns, got, strict=True):
                c.append(x)

        each = np.bincount(trie.lang, trie.count[0], len(langs)) if len(trie.lang) and trie.count[0].sum() < 1 << 53 else np.array([trie.count[0][trie.lang == i].sum() for i in range(len(langs))])
        put(pa.array(langs, pa.string()), [], each.astype(np.int64), [])
        tail = lambda x, v: pa.concat_arrays([x, pa.array([v], pa.string())])
        lang, path, left, place = pa.array([], pa.string()), [], [], np.zeros(0, np.int64)
        for depth in range(DEPTH):  # parents of what is kept are kept, or are the range's own, which stand last
            kept = np.flatnonzero(trie.count[depth] >= least)
            own, count = words.take(pa.array(trie.word[depth][kept])), trie.count[depth][kept]
            if depth == 0:
                lang, path = pa.array(langs, pa.string()).take(pa.array(trie.lang[kept])), [own]
            else:
                up = np.append(place, len(lang) - 1)[trie.up[depth][kept]]
                lang, path, left = lang.take(pa.array(up)), [*[x.take(pa.array(up)) for x in path], own], [x[up] for x in left]
            put(lang, path, count, left)
            place = np.full(len(trie.count[depth]), -1)
            place[kept] = np.arange(len(kept))
            left = [np.append(x, int(begin[d])) for d, x in enumerate([*left, count])] if depth + 1 < DEPTH else left
            lang, path = tail(lang, bound[0]), [tail(x, bound[d + 1]) for d, x in enumerate(path)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["lang", "w1", "w2", "w3", "a", "l1", "l2"])

    ranges = len(bounds) + 1  # a task each
    return blocks.repartitionById(ranges, F.col("range")).mapInArrow(run, "lang string, w1 string, w2 string, w3 string, a bigint, l1 bigint, l2 bigint")


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts of up to 10**15."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", wide(F.lit(1_000_000)) * wide(a) * wide(a), wide(left) * wide(right))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, covered: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of 2 to 3 words of each language: lang, rank, phrase, a (occurrences), l and r (those of its parts at the lowest-scoring
    cut), n (words of the language), score.

    Every task counts its texts in tries of depth three, serialised sorted and cut at the bounds of prefix ranges; each range's blocks are merged by one
    task, whatever words they hold. A merged node's left parts are its parents in the walk of the trie; its right parts are the nodes that its suffix
    links name, which joins resolve one level after the other. Phrases found ``least`` times or more are candidates; one within a longer candidate that has
    at least ``covered`` per cent of its count is dropped. Words are parted by spaces and tabs, pieces by ``.,;:!?`` and line ends; A-Z count as a-z.

    Null texts are empty, null languages ``und``; repeated rows count each; ties go by count and phrase. Texts are read whole. Extra columns
    are ignored. Languages without candidates, and empty tables, give no rows.
    """
    texts = bounded(docs).select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    bounds = range_bounds(texts, RANGES * tasks(docs.sparkSession))
    nodes = cut(merge(shards(texts, bounds), bounds, least))
    totals = nodes.where("w1 IS NULL").groupBy("lang").agg(F.sum("a").alias("n"))
    one = nodes.where("w1 IS NOT NULL AND w2 IS NULL").select("lang", F.col("w1").alias("x"), F.col("a").alias("right1"))
    two = nodes.where("w2 IS NOT NULL AND w3 IS NULL").select("lang", "w1", "w2", "a", "l1")
    two = cut(lookup(two, one.withColumnRenamed("x", "w2"), ["lang", "w2"]))
    three = nodes.where("w3 IS NOT NULL").select("lang", "w1", "w2", "w3", "a", "l1", "l2")
    suffix = two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("right2"), "right1")
    three = cut(lookup(three, suffix, ["lang", "w2", "w3"]))
    inside = three.select("lang", "w1", "w2", "a").union(three.select("lang", "w2", "w3", "a")).groupBy("lang", "w1", "w2").agg(F.max("a").alias("longest"))
    two = two.join(inside, ["lang", "w1", "w2"], "left").where(f"longest IS NULL OR 100 * CAST(longest AS DECIMAL(38,0)) < {int(covered)} * CAST(a AS DECIMAL(38,0))")
    early, late = cut_score(F.col("a"), F.col("l1"), F.col("right2")), cut_score(F.col("a"), F.col("l2"), F.col("right1"))
    first = F.col("early") <= F.col("late")
    three = three.withColumns({"early": early, "late": late}).select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(first, F.col("right2")).otherwise(F.col("right1")).alias("r"), F.least("early", "late").alias("score")
    )
    scored = three.union(two.select("lang", F.concat_ws(" ", "w1", "w2"), "a", "l1", "right1", cut_score(F.col("a"), F.col("l1"), F.col("right1"))))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
