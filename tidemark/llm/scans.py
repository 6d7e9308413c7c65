"""Scans over sorted rows by two passes: names, places, running sums and first values of equal keys, without joins by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from tidemark.llm.cluster import cut
from tidemark.llm.texts import bounded


def changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; null is a value."""
    now, before = column.slice(1), column.slice(0, len(column) - 1)
    other = pc.fill_null(pc.not_equal(now, before), False).to_numpy(zero_copy_only=False)
    return other | (now.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False)) if column.null_count else other


def scan(df: DataFrame, keys: list[str], order: list[str] = (), sums: list[str] = (), firsts: list[str] = (), totals: list[str] = ()) -> DataFrame:
    """``df`` with, for rows sorted by ``keys`` and then by ``order`` (nulls first): ``name``, the keys' dense number from 0 in that
    order; ``place``, the row's place from 0 among the rows of its key; ``ends``, whether it is the last of them; ``before_x``, the sum of
    each x of ``sums`` (long) over the earlier rows of its key; ``first_x``, each x of ``firsts`` in the key's first row; ``above_x``, the sum of each x of
    ``totals`` over all earlier rows, whatever their key.

    A range shuffle by keys and order splits a key of any size over many tasks. Each task numbers and sums what it has;
    two rows of each task, its first and its last, reach the driver, which makes of them what every task must add. Without
    keys all rows are of one key. The rows are cut (checkpointed), so every later use reads the same numbers.
    """
    by = [*keys, *order]
    fields = [T.StructField("_part", T.IntegerType()), T.StructField("_edge", T.IntegerType()), T.StructField("name", T.LongType()), T.StructField("place", T.LongType()), T.StructField("ends", T.BooleanType())]
    fields += [T.StructField(f"before_{s}", T.LongType()) for s in sums] + [T.StructField(f"first_{f}", df.schema[f].dataType) for f in firsts]
    fields += [T.StructField(f"above_{s}", T.LongType()) for s in totals]
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, last = TaskContext.get().partitionId(), None, None
        name, place, so_far, known, above = -1, 0, dict.fromkeys(sums, 0), dict.fromkeys(firsts), dict.fromkeys(totals, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            new = np.zeros(n, bool)
            for c in columns:
                new[1:] |= changes(c)
            new[0] = last is None or [c[0].as_py() for c in columns] != last
            if held is not None:
                yield finished(held, bool(new[0]), 0)
            last = [c[-1].as_py() for c in columns]
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))
            old = start < 0
            out = {"name": name + np.cumsum(new), "place": np.where(old, at + place, at - start)}
            for s in sums:
                values = batch.column(batch.schema.get_field_index(s)).to_numpy(zero_copy_only=False).astype(np.int64)
                before = np.cumsum(values) - values
                out[f"before_{s}"] = np.where(old, before + so_far[s], before - before[np.maximum(start, 0)])
                so_far[s] = int(out[f"before_{s}"][-1] + values[-1])
            for f in firsts:
                column = batch.column(batch.schema.get_field_index(f))
                here = column.take(pa.array(np.maximum(start, 0)))
                out[f"first_{f}"] = pc.if_else(pa.array(old), pa.scalar(known[f], column.type), here) if old.any() else here
                known[f] = out[f"first_{f}"][-1].as_py()
            for s in totals:
                values = np.cumsum(batch.column(batch.schema.get_field_index(s)).to_numpy(zero_copy_only=False).astype(np.int64))
                out[f"above_{s}"] = above[s] + np.append(0, values[:-1])
                above[s] += int(values[-1])
            name, place = int(out["name"][-1]), int(out["place"][-1]) + 1
            held = (batch, part, held is None, np.append(new[1:], False), out)
        if held is not None:
            yield finished(held, None, 2)

    def finished(held: tuple, ended: bool | None, edge: int) -> pa.RecordBatch:
        batch, part, first, ends, out = held
        edges = np.zeros(batch.num_rows, np.int32)
        edges[0] += first
        edges[-1] += edge
        flags = pa.array(ends.tolist()[:-1] + [ended], pa.bool_())
        more = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(edges), pa.array(out["name"]), pa.array(out["place"]), flags]
        more += [x if isinstance(x, pa.Array) else pa.array(x) for k, x in out.items() if k not in ("name", "place")]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *[f.name for f in fields]])

    ranged = bounded(df).repartitionByRange(*by).sortWithinPartitions(*by) if by else df.coalesce(1)
    rows = cut(ranged.mapInArrow(run, schema))
    wanted = list(dict.fromkeys([*keys, *sums, *totals, *[f.name for f in fields]]))
    edges: dict[int, dict] = {}
    for r in rows.where("_edge > 0").select(*wanted).collect():  # two rows a task at most
        edges.setdefault(r["_part"], {}).update({bit: r for bit in (1, 2) if r["_edge"] & bit})
    added, state, all_before = [], None, dict.fromkeys(totals, 0)
    for part in sorted(edges):
        first, last = edges[part][1], edges[part][2]
        same = state is not None and [first[k] for k in keys] == state["key"]
        if state is not None and not same:
            added[-1][2] = True
        offset = 0 if state is None else state["name"] + (not same)
        carry = {"place": state["count"] if same else 0} | {s: state["sums"][s] if same else 0 for s in sums} | {f"first_{f}": state["firsts"][f] if same else None for f in firsts}
        added.append([part, offset, False, same, carry["place"], *[carry[s] for s in sums], *[carry[f"first_{f}"] for f in firsts], *all_before.values()])
        all_before = {s: v + last[f"above_{s}"] + last[s] for s, v in all_before.items()}
        on = same and last["name"] == 0  # the whole part is of the key that came in
        state = {
            "key": [last[k] for k in keys], "name": offset + last["name"], "count": last["place"] + 1 + (carry["place"] if on else 0),
            "sums": {s: last[f"before_{s}"] + last[s] + (carry[s] if on else 0) for s in sums}, "firsts": {f: carry[f"first_{f}"] if on else last[f"first_{f}"] for f in firsts},
        }
    if added:
        added[-1][2] = True
    kinds = ["_p int", "_offset long", "_ended boolean", "_same boolean", "_place long", *[f"_before_{s} long" for s in sums], *[f"_first_{f} {df.schema[f].dataType.simpleString()}" for f in firsts], *[f"_above_{s} long" for s in totals]]
    carried = df.sparkSession.createDataFrame([tuple(x) for x in added], ", ".join(kinds))
    joined = rows.join(F.broadcast(carried), F.col("_part") == F.col("_p"))
    old = F.col("_same") & (F.col("name") == 0)
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("name") + F.col("_offset")).alias("name"), (F.col("place") + F.when(old, F.col("_place")).otherwise(0)).alias("place"),
        F.coalesce("ends", "_ended").alias("ends"), *[(F.col(f"before_{s}") + F.when(old, F.col(f"_before_{s}")).otherwise(0)).alias(f"before_{s}") for s in sums],
        *[F.when(old, F.col(f"_first_{f}")).otherwise(F.col(f"first_{f}")).alias(f"first_{f}") for f in firsts],
        *[(F.col(f"above_{s}") + F.col(f"_above_{s}")).alias(f"above_{s}") for s in totals],
    )
