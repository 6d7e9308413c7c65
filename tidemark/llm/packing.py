"""Packing token ids into fixed windows by concatenation and cutting (operator 4)."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.cluster import cut
from tidemark.llm.texts import bounded, codes, slices, sums, words

#: Words whose ids a worker remembers, over all its tasks; beyond that it starts anew.
CACHE_WORDS = 400_000
#: Words that go to the library as one text.
TOGETHER = 500
#: Bytes of text tokenised at once.
BATCH_BYTES = 4 << 20
#: Letters that are their own canonical composition and whose lower case is one letter, and marks (no apostrophe) behind them.
SIMPLE = r"^(?P<head>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"
# What of a tokenizer file the short way of plain words stands on: how it normalises and splits, and the mark of a word's end.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
END = "</w>"


def byte_letters() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes: printable ones as they are, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Token ids of words by a ``tokenizers`` file, remembered word by word.

    The vocabulary splits words at white space, so a text's ids are those of its words in turn. A word of
    plain letters and marks behind them is two pre-tokens; the letters, in lower case, go straight to the merges. All other words
    go through the file's whole pipeline. A file of another make is refused.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        made = json.loads(self.whole.to_str())
        steps = [x["type"] for x in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if made["normalizer"] != {"type": "Sequence", "normalizers": NORMALIZERS} or steps != ["Split", "ByteLevel"] or made["model"]["end_of_word_suffix"] != END:
            raise ValueError("only vocabularies of lower-case words with marked ends are supported")
        self.merges = Tokenizer(self.whole.model)  # the same merges in memory, without what splits and normalises
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = {k: v for k, v in byte_letters().items() if k != ord(" ")}
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.whole.get_vocab_size(), dtype=bool)
        self.ends[[i for x, i in self.whole.get_vocab().items() if x.endswith(END)]] = True
        self.known: dict[str, np.ndarray] = {}
        self.heads, self.bounds, self.ids = pa.array([], pa.string()), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=self.dtype)

    def _flat(self, found: list) -> np.ndarray:
        return np.fromiter(chain.from_iterable(x.ids for x in found), dtype=self.dtype)

    def _merged(self, heads: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain lower-case words in a row, and where each word's begin (one more entry ends them)."""
        texts = [" ".join(heads[i : i + TOGETHER]) for i in range(0, len(heads), TOGETHER)]
        texts = [x if x.isascii() else x.encode().decode("latin-1").translate(self.letters) for x in texts]
        ids = self._flat(self.merges.encode_batch_fast(texts, add_special_tokens=False))
        return ids, np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1))

    def _of_heads(self, heads: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct ``heads`` begin and end in ``self.ids``."""
        if len(self.heads) > CACHE_WORDS:
            self.heads, self.bounds, self.ids = self.heads[:0], self.bounds[:1], self.ids[:0]
        at = pc.fill_null(pc.index_in(heads, value_set=self.heads), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = heads.take(pa.array(new))
            ids, bounds = self._merged(fresh.to_pylist())
            at[new] = len(self.heads) + np.arange(len(new))
            self.heads = pa.concat_arrays([self.heads, fresh])
            self.bounds, self.ids = np.concatenate((self.bounds, self.bounds[-1] + bounds[1:])), np.concatenate((self.ids, ids))
        return self.bounds[at], self.bounds[at + 1]

    def _of_others(self, others: list[str]) -> list[np.ndarray]:
        """The ids of each of ``others`` by the whole pipeline."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        fresh = [x for x in others if x not in self.known]
        self.known |= {x: np.array(got.ids, dtype=self.dtype) for x, got in zip(fresh, self.whole.encode_batch_fast(fresh, add_special_tokens=False), strict=True)}
        return [self.known[x] for x in others]

    def of(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``distinct`` words in a row, and how many each has."""
        split = pc.extract_regex(distinct, SIMPLE)
        plain = np.flatnonzero(split.is_valid().to_numpy(zero_copy_only=False))
        rest = np.flatnonzero(split.is_null().to_numpy(zero_copy_only=False))
        split = split.take(pa.array(plain))
        head, heads = codes(pc.utf8_lower(split.field("head")))
        tail, tails = codes(split.field("tail"))
        begin, end = self._of_heads(heads)
        others = self._of_others([*tails.to_pylist(), *distinct.take(pa.array(rest)).to_pylist()])
        sizes = np.array([len(x) for x in others], dtype=np.int64)
        places = len(self.ids) + np.cumsum(sizes) - sizes
        starts, lengths = np.zeros((2, len(distinct)), dtype=np.int64), np.zeros((2, len(distinct)), dtype=np.int64)
        starts[0, plain], lengths[0, plain] = begin[head], (end - begin)[head]
        starts[1, plain], lengths[1, plain] = places[tail], sizes[tail]
        starts[0, rest], lengths[0, rest] = places[len(tails) :], sizes[len(tails) :]
        return gathered(np.concatenate([self.ids, *others]), starts.T.ravel(), lengths.T.ravel()), lengths.sum(axis=0)


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces values[starts[i]:starts[i] + lengths[i]] in a row."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return values[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]


_WORDS: dict[str, WordIds] = {}


def ids_of(path: str) -> WordIds:
    """This worker's tokenizer for ``path``."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(text: pa.Array, tokenizer: WordIds, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, each text's followed by ``end_id``, and each text's number of ids."""
    flat, bounds = words(text)
    word, distinct = codes(flat)
    found, lengths = tokenizer.of(distinct)
    lengths = np.append(lengths, 1)
    word = np.insert(word, bounds[1:], len(distinct))
    sizes = lengths[word]
    ids = gathered(np.append(found, np.array([end_id], dtype=tokenizer.dtype)), (np.cumsum(lengths) - lengths)[word], sizes)
    return ids, sums(sizes, bounds + np.arange(len(bounds)))


def tokenised(docs: DataFrame, id_col: str, text_col: str, path: str | None, end_id: int) -> DataFrame:
    """Rows (id, ids binary, n long, part int, before long): ``before`` counts the ids of the rows before it in its task."""
    narrow = bounded(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, before, part = ids_of(path or default_path()), 0, TaskContext.get().partitionId()
        for batch in slices(batches, "text", BATCH_BYTES):
            ids, n = encode(batch.column("text"), tokenizer, end_id)
            ends = np.cumsum(n)
            offsets = np.concatenate(([0], ends * ids.itemsize)).astype(np.int32)
            data = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), data, pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(before + ends - n)], ["id", "ids", "n", "part", "before"])
            before += int(ends[-1]) if len(ends) else 0

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, ids binary, n bigint, part int, before bigint")


def pieces(ids: pa.Array, n: np.ndarray, place: np.ndarray, window: int) -> dict[str, np.ndarray | list[bytes]]:
    """The parts of texts at global places ``place`` that lie in one window each."""
    first, last = place // window, (place + n - 1) // window
    count = last - first + 1
    of = np.repeat(np.arange(len(n)), count)
    sequence = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = np.maximum(sequence * window - place[of], 0)
    length = np.minimum((sequence + 1) * window - place[of], n[of]) - start
    blobs = ids.to_pylist()
    width = [len(x) // k for x, k in zip(blobs, n.tolist(), strict=True)]
    wide = [np.frombuffer(x, dtype=f"<u{w}").astype("<u4").tobytes() for x, w in zip(blobs, width, strict=True)]
    cuts = [wide[i][4 * s : 4 * (s + k)] for i, s, k in zip(of.tolist(), start.tolist(), length.tolist(), strict=True)]
    return {"of": of, "start": start, "length": length, "ids": cuts, "sequence_id": sequence, "offset": place[of] + start - sequence * window}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Pieces of documents in windows of ``window`` ids: id, start, length, ids binary (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset.

    Pass one tokenises every whole text once, into a checkpoint, and sums the ids of each task; a prefix sum
    over the tasks' totals (one number each) gives every document its global place. Pass two cuts the one
    long row of ids at multiples of ``window``: only the last window is short. A document over a boundary has a
    piece on each side, and the pieces' starts and offsets are the boundary records.

    Nulls: a null text is empty and holds only ``end_id``; a null id stays null. Repeated rows are each packed,
    extra columns are ignored, an empty table gives no pieces. Sequences are numbered from 0 without gaps.
    """
    rows = cut(tokenised(docs, id_col, text_col, path, end_id))
    base, total = {}, 0
    for row in sorted(rows.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["part"]):
        base[row["part"]] = total
        total += row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                n, before = (some.column(c).to_numpy(zero_copy_only=False) for c in ("n", "before"))
                place = before + np.array([base[p] for p in some.column("part").to_pylist()], dtype=np.int64)
                got = pieces(some.column("ids"), n, place, window)
                of = pa.array(got["of"])
                yield pa.RecordBatch.from_arrays([some.column("id").take(of), pa.array(got["start"]), pa.array(got["length"]), pa.array(got["ids"], pa.binary()), some.column("n").take(of), pa.array(got["sequence_id"]), pa.array(got["offset"])], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col)
