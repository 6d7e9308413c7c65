"""Token counts by rank-synchronous array merging (operator 9)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import bounded, codes, slices, sums

#: The mark that stands for a space.
SPACE = "▁"
#: No merge.
NEVER = np.iinfo(np.int32).max
#: Symbols from which a sequence is merged by itself.
LONG = 4096
#: Bytes of text counted at once.
BATCH_BYTES = 8 << 20


class Merges:
    """The merge table of a SentencePiece BPE model, as arrays.

    Symbols are the pieces and the characters that occur in pieces. A pair merges if its concatenation is a
    piece, the pieces of higher score first. ``single`` marks pieces after whose merge a better pair may appear;
    of those, one occurrence at a time may be merged. ``beside`` are the pairs of characters that stand side by
    side in a piece: nothing ever merges over others, so that sequences part there, however long they are.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        plain = {}
        for i in range(model.get_piece_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
                plain[model.id_to_piece(i)] = model.get_score(i)
        if any(SPACE in x.lstrip(SPACE) for x in plain) or any("\n" in x for x in plain):
            raise ValueError("pieces that go over white space are not supported")
        ordered = sorted(plain, key=lambda x: -plain[x])
        place = {x: i for i, x in enumerate(ordered)}
        symbols = {x: i for i, x in enumerate([*ordered, *sorted({c for x in ordered for c in x} - set(ordered))])}
        self.n_symbols = len(symbols) + 1
        self.pieces = len(ordered)
        self.of_char = np.full(0x110000, len(symbols), dtype=np.int32)  # the last symbol: any other character
        for x, i in symbols.items():
            if len(x) == 1:
                self.of_char[ord(x)] = i
        pairs, self.single = {}, np.zeros(self.n_symbols, dtype=bool)
        for x in ordered:
            for k in range(1, len(x)):
                a, b = symbols.get(x[:k]), symbols.get(x[k:])
                if a is not None and b is not None:
                    pairs[a * self.n_symbols + b] = place[x]
                    self.single[[s for s in (a, b) if s < self.pieces and s > place[x]]] = True
        beside = {(symbols[a], symbols[b]) for x in ordered for a, b in zip(x, x[1:])}
        self.beside = np.array(sorted(a * self.n_symbols + b for a, b in beside), dtype=np.int64)
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)

    @cached_property
    def rank_of(self) -> dict[int, int]:
        """The rank of each pair by its key, made once for all long sequences of a worker."""
        return dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def count(self, chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence chars[bounds[i]:bounds[i + 1]] (code points, none empty); a character
        that is no piece counts its UTF-8 bytes."""
        symbol = self.of_char[chars]
        width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
        if not len(symbol):
            return np.zeros(len(bounds) - 1, dtype=np.int64)
        whole = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        key = symbol[:-1].astype(np.int64) * self.n_symbols + symbol[1:]
        joined = self.beside[np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)] == key
        parts = np.concatenate(([True], (whole[1:] != whole[:-1]) | ~joined))
        seq, owner = np.cumsum(parts) - 1, whole[parts]
        total = np.zeros(len(owner), dtype=np.int64)
        sizes = np.bincount(seq, minlength=len(owner))
        if sizes.max() > LONG:
            for i in np.flatnonzero(sizes > LONG).tolist():
                some = slice(*np.searchsorted(seq, (i, i + 1)).tolist())
                total[i] = self.count_long(symbol[some].tolist(), width[some].tolist())
            short = sizes[seq] <= LONG
            symbol, width, seq = symbol[short], width[short], seq[short]
        rank = np.full(len(symbol), NEVER, dtype=np.int32)
        inside = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inside] = self.rank(symbol[inside], symbol[inside + 1])
        while len(symbol):
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            sizes = np.diff(np.append(starts, len(seq)))
            least = np.minimum.reduceat(rank, starts)
            going = np.repeat(least < NEVER, sizes)
            if not going.all():  # sequences without a pair are done
                ended = ~going
                total += np.bincount(seq[ended], weights=np.where(symbol[ended] < self.pieces, 1, width[ended]), minlength=len(total)).astype(np.int64)
                symbol, width, seq, rank = symbol[going], width[going], seq[going], rank[going]
                sizes, least = sizes[least < NEVER], least[least < NEVER]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            joined = rank[hit]
            # of pairs that overlap (a run of places one apart) every other merges, from the left
            run = np.cumsum(np.concatenate(([True], np.diff(hit) > 1))) - 1
            head = hit[np.searchsorted(run, np.arange(run[-1] + 1))]
            take = (hit - head[run]) % 2 == 0
            first = np.concatenate(([True], seq[hit][1:] != seq[hit][:-1]))
            take &= first | ~self.single[joined]
            hit, joined = hit[take], joined[take]
            symbol[hit] = joined
            keep = np.ones(len(symbol), dtype=bool)
            keep[hit + 1] = False
            fresh = np.zeros(len(symbol), dtype=bool)
            fresh[hit] = True
            before = hit[hit > 0] - 1
            fresh[before - (~keep[before])] = True
            symbol, width, seq, rank, fresh = symbol[keep], width[keep], seq[keep], rank[keep], np.flatnonzero(fresh[keep])
            rank[fresh] = NEVER
            fresh = fresh[fresh + 1 < len(seq)]
            fresh = fresh[seq[fresh] == seq[fresh + 1]]
            rank[fresh] = self.rank(symbol[fresh], symbol[fresh + 1])
        return np.bincount(owner, weights=total, minlength=len(bounds) - 1).astype(np.int64)


    def count_long(self, symbol: list[int], width: list[int]) -> int:
        """``count`` for one long sequence, where a round for each rank would read it too often: the pairs wait in a heap."""
        ranks, n = self.rank_of, self.n_symbols
        after, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbol, symbol[1:])) if (r := ranks.get(a * n + b)) is not None]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            k = after[i]
            if symbol[i] != a or k >= len(symbol) or symbol[k] != b:
                continue  # one of them has merged meanwhile
            symbol[i], symbol[k] = rank, -1
            after[i] = after[k]
            if after[k] < len(symbol):
                before[after[k]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(symbol) and (r := ranks.get(symbol[left] * n + symbol[right])) is not None:
                    heapq.heappush(heap, (r, left, symbol[left], symbol[right]))
        return sum(1 if 0 <= x < self.pieces else w for x, w in zip(symbol, width, strict=True) if x >= 0)


_MERGES: dict[str, Merges] = {}


def merges_of(path: str) -> Merges:
    if path not in _MERGES:
        _MERGES[path] = Merges(path)
    return _MERGES[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def counts(text: pa.Array, merges: Merges) -> np.ndarray:
    """Tokens of each text. Words with the spaces before them merge apart, as no piece goes over a word's end."""
    lines = pc.split_pattern(pc.replace_substring(text, SPACE, " "), "\n")
    per_text = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    first_line = np.cumsum(per_text) - per_text
    parts = pc.split_pattern(lines.flatten(), " ")
    per_line = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(per_line)
    starts = ends - per_line
    word, distinct = codes(parts.flatten())
    line = np.repeat(np.arange(len(per_line)), per_line)
    spaces = np.ones(len(word), dtype=np.int64)
    spaces[starts] = 0
    filled = pc.greater(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    spaces[starts[first_line[filled]]] = 1  # the space that is put before a text
    full = (pc.binary_length(distinct).to_numpy(zero_copy_only=False) > 0)[word] if len(distinct) else np.zeros(0, dtype=bool)
    full[ends - 1] |= True  # a line's last part closes the spaces before it, empty or not
    at = np.flatnonzero(full)
    upto = np.cumsum(spaces)
    previous = np.concatenate(([0], upto[at][:-1]))
    run = upto[at] - previous  # spaces since the last filled part; each line ends with one, so none come from another line
    word, line = word[at], line[at]

    pair, kinds = np.unique(run * (len(distinct) + 1) + word, return_inverse=True)
    run, word = pair // (len(distinct) + 1), pair % (len(distinct) + 1)
    listed = distinct.take(pa.array(word))
    lengths = pc.utf8_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.frombuffer("".join(listed.to_pylist()).encode("utf-32-le"), dtype="<u4")
    sizes = run + lengths
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    spelled = np.full(bounds[-1], ord(SPACE), dtype=np.uint32)
    spelled[np.repeat(bounds[:-1] + run - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(chars))] = chars
    some = np.flatnonzero(sizes)
    each = np.zeros(len(sizes), dtype=np.int64)
    each[some] = merges.count(spelled, np.append(bounds[:-1][some], bounds[-1]))
    per_line_tokens = np.bincount(line, weights=each[kinds], minlength=len(per_line)).astype(np.int64)
    return sums(per_line_tokens, np.append(first_line, len(per_line))) + np.maximum(per_text - 1, 0)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    Batches of whole texts become ragged arrays of their distinct words; in each round every word merges its
    lowest-ranked pair at once, until none has one. Nothing is shuffled. Nulls: a null text is empty and
    has no tokens; a null id stays. Repeated rows are counted each; extra columns are ignored; an empty table
    gives an empty result. Control strings in a text are ordinary text, as in the library.
    """
    narrow = bounded(docs).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(path or default_path())
        for batch in slices(batches, "text", BATCH_BYTES):
            text = batch.column("text")
            tokens = counts(text, merges)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pc.binary_length(text).cast(pa.int64()), pa.array(tokens), pa.array(tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
