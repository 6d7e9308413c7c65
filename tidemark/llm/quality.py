"""Quality rules by distribution divergence (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.cluster import cut, small, without
from tidemark.llm.texts import bounded, codes, slices, sums, words

# Common words of each language, by language code.
COMMON = {
    "de": "als am auch auf aus bei bis das dass dem den der des die durch ein eine einen er es für hat ich im in ist mit nach nicht noch sein sich sie sind so um und vom von war was werden wie wird zu zum zur über",
    "en": "a all an and are as at be been but by can for from had has have he her his i if in is it its no not of on one or she so that the their they this to was we were when which will with would you",
    "es": "a al como con de del donde el ella en entre era es esta este fue ha hasta la las lo los más me muy no o para pero por que se ser si sin sobre son su sus también todo un una y ya",
    "fr": "a au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous à été être",
}
# Characters of the counted classes; letters and all else are the last class.
CLASSES = (r"\p{Lu}", r"\p{Nd}", r"[#*$%&|<>]", r"[.,;:!?'\"()\-]")
SYMBOLS = 2
#: Words in a repeated window.
WINDOW = 5


@dataclass(frozen=True)
class Limits:
    """Base limits (words, percent of words in repeated windows) and those of the divergence verdict.

    A document is compared only if it has ``guard_words`` words and its language has ``guard_docs`` documents that are not near copies.
    It fails if a Jensen-Shannon distance (0 to 1) exceeds its limit plus its noise factor times what
    sampling so few characters or words from the reference would give.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    guard_words: int = 40
    guard_docs: int = 20
    char_distance: float = 0.12
    char_noise: float = 3.0
    word_distance: float = 0.06
    word_noise: float = 1.5
    trims: int = 2


def repeated(word: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which words stand in a window of WINDOW words found again in the same text. word: codes; of: each word's text."""
    n = len(word) - WINDOW + 1
    covered = np.zeros(len(word) + 1, dtype=np.int64)
    if n <= 0:
        return covered[:-1].astype(bool)
    at = np.flatnonzero(of[:n] == of[WINDOW - 1 :])
    key = of[at]
    for k in range(WINDOW):  # windows still met twice go on, each time compared by one more word
        key = pd.factorize(key * (int(word.max()) + 1) + word[at + k])[0]
        again = np.bincount(key, minlength=1)[key] > 1
        at, key = at[again], key[again]
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return np.cumsum(covered[:-1]) > 0


def sketches(word: np.ndarray, of: np.ndarray, distinct: pa.Array, n: int) -> np.ndarray:
    """The least hash of each text's windows of WINDOW words, mostly the same for near copies; 0 for shorter texts."""
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([digest(x) for x in distinct.cast(pa.binary()).to_pylist()], dtype=np.uint64)
    least = np.zeros(n, dtype=np.uint64)
    starts = len(word) - WINDOW + 1
    at = np.flatnonzero(of[:starts] == of[WINDOW - 1 :]) if starts > 0 else np.zeros(0, dtype=np.int64)
    if len(at):
        mixed = np.zeros(len(at), dtype=np.uint64)
        for k in range(WINDOW):
            mixed = (mixed ^ hashes[word[at + k]]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        first = np.flatnonzero(np.diff(of[at], prepend=-1))
        least[of[at[first]]] = np.minimum.reduceat(mixed, first)
    return least.view(np.int64)


def features(text: pa.Array, lang: list[str | None]) -> dict[str, np.ndarray | list]:
    """Counters and histograms of each text."""
    n = len(text)
    flat, bounds = words(text)
    word, distinct = codes(flat)
    of = np.repeat(np.arange(n), np.diff(bounds))
    chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    classes = [pc.count_substring_regex(distinct, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in CLASSES]
    classes.append(chars - sum(classes))
    per_class = np.stack([sums(c[word], bounds) for c in classes], axis=1)

    bare = pc.utf8_trim(pc.utf8_lower(distinct), ".,;:!?'\"()")
    width = max(len(v.split()) for v in COMMON.values()) + 1
    common = np.zeros((n, width), dtype=np.int64)
    languages = np.array([x if x in COMMON else "" for x in lang], dtype=object)
    for name, listed in COMMON.items():
        place = pc.fill_null(pc.index_in(bare, pa.array(listed.split())), width - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        mine = (languages == name)[of] if n else np.zeros(0, dtype=bool)
        common += np.bincount(of[mine] * width + place[word[mine]], minlength=n * width)[: n * width].reshape(n, width)

    lines = pc.split_pattern(text, "\n")
    line, kinds = codes(lines.flatten())
    full = pc.match_substring_regex(kinds, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False).astype(bool)
    in_text = np.repeat(np.arange(n), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    line, in_text = line[full[line]], in_text[full[line]]
    firsts = np.unique(in_text * (len(kinds) + 1) + line) // (len(kinds) + 1)
    dup = np.bincount(in_text, minlength=n) - np.bincount(firsts, minlength=n)

    return {
        "n_words": np.diff(bounds), "word_chars": sums(chars[word], bounds), "n_symbols": per_class[:, SYMBOLS], "n_dup_lines": dup[:n],
        "n_repeat_words": sums(repeated(word, of), bounds), "chars": per_class.tolist(), "common": common.tolist(),
        "sketch": sketches(word, of, distinct, n), "digest": [xxhash.xxh3_128_digest(x) for x in text.cast(pa.binary()).to_pylist()],
    }


COUNTERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, id_col: str, text_col: str, lang_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    narrow = bounded(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"c_{c}") for c in carry])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = features(batch.column("text"), batch.column("lang").to_pylist())
            arrays = [batch.column("id"), batch.column("lang"), *[batch.column(f"c_{c}") for c in carry], *[pa.array(got[c], pa.int64()) for c in COUNTERS], *[pa.array(got[c], pa.list_(pa.int64())) for c in ("chars", "common")], pa.array(got["sketch"], pa.int64()), pa.array(got["digest"], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "lang", *[f"c_{c}" for c in carry], *COUNTERS, "chars", "common", "sketch", "digest"])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name != "text"]
    return narrow.mapInArrow(run, ", ".join([*kept, *[f"{c} bigint" for c in COUNTERS], "chars array<bigint>", "common array<bigint>", "sketch bigint", "digest binary"]))


def shares(histogram: str) -> Column:
    total = F.aggregate(histogram, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.transform(histogram, lambda x: x / F.greatest(total, F.lit(1)))


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits) of two arrays of shares."""

    def side(a: str) -> Column:
        terms = F.zip_with(p, q, lambda x, y: (lambda own: F.when(own > 0, own * F.log2(2 * own / (x + y))).otherwise(0.0))(x if a == p else y))
        return F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)

    return F.sqrt(F.greatest(F.lit(0.0), (side(p) + side(q)) / 2))


def distinct_texts(rows: DataFrame, limits: Limits) -> DataFrame:
    """What ``references`` and the verdict need of each distinct text of a language that may stand in its reference."""
    usable = rows.where(~F.col("base_failed") & (F.col("n_words") >= limits.guard_words))
    same = [F.first(c).alias(c) for c in ("n_words", "word_chars", "base_failed", "chars", "common", "sketch")]
    return usable.groupBy("lang", "digest").agg(*same).drop("digest")


def references(texts: DataFrame) -> DataFrame:
    """For each language the mean shares over its groups of near copies: (ref_lang, ref_docs, ref_chars, ref_common), a row a language.

    Distinct texts of one sketch are a group and weigh as one document, so neither copies nor near copies vouch for themselves.
    """
    width = {"chars": len(CLASSES) + 1, "common": max(len(v.split()) for v in COMMON.values()) + 1}

    def means(names: dict[str, list[Column]]) -> list[Column]:
        return [F.array(*[F.avg(x) for x in values]).alias(name) for name, values in names.items()]

    groups = texts.groupBy("lang", "sketch").agg(*means({h: [F.col(h)[i] for i in range(n)] for h, n in width.items()}))
    return groups.groupBy(F.col("lang").alias("ref_lang")).agg(F.count(F.lit(1)).alias("ref_docs"), *means({f"ref_{h}": [F.col(h)[i] for i in range(n)] for h, n in width.items()}))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits(), carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, the ``carry`` columns, the counters, base_failed, char_distance, word_distance, kept.

    A first pass counts every whole text. The character classes and common words of the distinct documents of
    each language that pass the base rules give its reference, near copies together weighing as one; then documents beyond the limits leave the
    reference and it is taken again, ``trims`` times, so that junk does not vouch for itself. Words are
    compared only in languages with a list of common words.

    Nulls: a null text is empty and fails the base rules; a null language is one of its own. Documents or
    languages too small to compare are judged by the base rules alone. Repeated rows are judged alike, each
    on its own; extra columns are ignored unless carried; an empty table gives an empty result.
    """
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    measured = measure(docs, id_col, text_col, lang_col, carry)
    rows = cut(measured.withColumns({"base_failed": failed, "chars": shares("chars"), "common": shares("common")}))
    listed = F.col("lang").isin(*COMMON)

    def compared(rows: DataFrame, reference: DataFrame) -> DataFrame:
        both = rows.join(small(reference, 2000), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
        enough = (F.col("n_words") >= limits.guard_words) & (F.col("ref_docs") >= limits.guard_docs)
        both = both.withColumn("char_distance", F.when(enough, distance("chars", "ref_chars")))
        both = both.withColumn("word_distance", F.when(enough & listed, distance("common", "ref_common")))

        def noise(factor: float, histogram: str, n: str) -> Column:
            bins = F.size(F.filter(f"ref_{histogram}", lambda x: x > 0.001))
            return factor * F.sqrt(bins / (8 * F.log(F.lit(2.0)) * F.col(n)))

        far = (F.col("char_distance") > limits.char_distance + noise(limits.char_noise, "chars", "word_chars")) | (F.col("word_distance") > limits.word_distance + noise(limits.word_noise, "common", "n_words"))
        return both.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))

    texts = cut(distinct_texts(rows, limits))
    reference = cut(references(texts))
    for _ in range(limits.trims):
        reference = cut(references(compared(texts, reference).where("kept").select(*texts.columns)))
    out = compared(rows, reference)
    return out.select(F.col("id").alias(id_col), *[F.col(f"c_{c}").alias(c) for c in carry], *COUNTERS, "base_failed", "char_distance", "word_distance", "kept")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Rejected rows are named by id. Rows that share an id are rejected one by one, by their text and language.
    """
    key = F.col(f"`{id_col}`").alias("_id")
    shared = cut(docs.groupBy(key).count().where("count > 1").select("_id"))
    if shared.isEmpty():
        bad = judge(docs, id_col, text_col, lang_col, limits).where("NOT kept").select(id_col)
        return without(docs, id_col, bad)
    digest = F.sha2(F.concat_ws("\n", F.coalesce(F.col("_lang").cast("string"), F.lit("")), F.col("_text").cast("string")), 256)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key, F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").alias("_lang"))
    many = F.col("_id").eqNullSafe(F.col("_s"))
    several = small(shared.withColumnRenamed("_id", "_s"))
    named = keyed.join(several.withColumn("_many", F.lit(True)), many, "left").withColumn("_digest", F.when(F.col("_many"), digest))
    bad = cut(judge(named, "_id", "_text", "_lang", limits, carry=("_digest",)).where("NOT kept").select(F.col("_id").alias("_k"), F.col("_digest").alias("_d")).distinct())
    lone = without(named.where("_many IS NULL").select("_id", "_row"), "_id", bad.where("_d IS NULL").select("_k")).select("_row.*")
    rest = named.where("_many").join(small(bad.where("_d IS NOT NULL")), F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_digest") == F.col("_d")), "left_anti").select("_row.*")
    return lone.unionByName(rest)
