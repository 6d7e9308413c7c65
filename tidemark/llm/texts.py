"""Arrow helpers for tasks that work on whole texts: batches of bounded size, words, lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that a task holds in working arrays at once; a longer single text is a batch of its own.
BATCH_BYTES = 4 << 20

#: Bytes of rows that Spark sends to a Python worker at once, in the session of every operator that uses Arrow.
ARROW_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches limited to ARROW_BYTES where they could be larger."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > ARROW_BYTES:
        conf.set(name, str(ARROW_BYTES))
    return df


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``limit`` bytes of ``column``; nulls there become empty texts."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(at).cast(pa.string()), "")
        batch = batch.set_column(at, column, text)
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All maximal runs of ``[^\\x20\\x09-\\x0D]`` in order, and where each text's words begin (one more entry ends them)."""
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))))
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        kept = np.concatenate(([0], np.cumsum(full)))
        flat, bounds = flat.filter(pa.array(full)), kept[bounds]
    return flat, bounds


def codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Integer codes of ``values`` and the distinct values that they stand for."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each [bounds[i], bounds[i + 1])."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]
