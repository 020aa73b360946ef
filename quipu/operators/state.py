"""Keyed folds over ordered rows: change-only history with a heartbeat, request windows that start at the first request.

A key's rows are first cut, by window functions that spill, where the fold's state is known to start anew; such stretches are dealt out,
not keys.  Spark sorts them and a task reads them as a stream of batches with one state, so memory doesn't grow with a stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _stretches(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_starts", F.coalesce(starts, F.lit(True)))
    return marked.withColumn("_stretch", F.sum(F.col("_starts").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def folded(df: DataFrame, by: Sequence[str], order: Sequence[str], reads: Sequence[str], step: Callable[..., tuple[Any, tuple]], outputs: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """df and the outputs of step(state, *reads) -> (state, values), taken in order; the state is None where `by` changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in by], strict=True)
            rows = zip(*[batch.column(c).to_pylist() for c in reads], strict=True)
            out = []
            for key, row in zip(keys, rows, strict=True):
                if key != last:
                    last, state = key, None
                state, values = step(state, *row)
                out.append(values)
            columns = [pa.array([v[i] for v in out], kind) for i, (_, kind) in enumerate(outputs.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *outputs])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], *[f"`{c}` {kind}" for c, (kind, _) in outputs.items()]])
    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def change_history(df: DataFrame, keys: Sequence[str], ts: str, value: str, tie: str, heartbeat_seconds: int | None = None) -> DataFrame:
    """Rows that are stored: the value differs from the last row's, or the last stored row is `heartbeat_seconds` old."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(tie).over(w).isNull()
    if heartbeat_seconds is None:
        return df.withColumn("_c", changed).filter("_c").drop("_c")
    runs = _stretches(df.withColumn("_first", changed), keys, [ts, tie], F.col("_first"))
    run = Window.partitionBy(*keys, "_stretch")
    runs = runs.withColumn("_long", F.max(ts).over(run) >= F.min(ts).over(run) + F.expr(f"INTERVAL {heartbeat_seconds} SECONDS"))
    short = runs.filter("NOT _long AND _first").select(df.columns)  # a run shorter than the heartbeat stores its first row alone
    beat = timedelta(seconds=heartbeat_seconds)

    def step(kept, at):
        due = kept is None or at - kept >= beat
        return (at if due else kept), (due,)

    long_ = folded(runs.filter("_long"), [*keys, "_stretch"], [ts, tie], [ts], step, {"_keep": ("boolean", pa.bool_())})
    return short.unionByName(long_.filter("_keep").select(df.columns))


def request_windows(df: DataFrame, keys: Sequence[str], ts: str, tie: str, seconds: int, limit: int) -> DataFrame:
    """`nth` request of its window and whether it is over the limit.  A window starts at its first request and lasts `seconds`."""
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    far = F.col(ts) - F.lag(ts).over(w) >= F.expr(f"INTERVAL {seconds} SECONDS")
    parts, most = _stretches(df, keys, [ts, tie], far), timedelta(seconds=seconds)

    def step(state, at):
        start, n = state or (at, 0)
        state = (at, 1) if at - start >= most else (start, n + 1)
        return state, (state[1], state[1] > limit)

    return folded(parts, [*keys, "_stretch"], [ts, tie], [ts], step, {"nth": ("long", pa.int64()), "refused": ("boolean", pa.bool_())}).drop("_stretch")


def lock_outs(df: DataFrame, keys: Sequence[str], ts: str, tie: str, failed: Column, most: int = 5, seconds: int = 900) -> DataFrame:
    """Sign-in attempts with `outcome` (in, failed, locked) and `failures` counted after each.

    From `most` failures on, each failure locks the account for `seconds`; an attempt while it is locked changes nothing; a success
    that is let in sets the count to 0.  A row with an unknown result (null) counts as a failure.
    """
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    bad = df.withColumn("_failed", F.coalesce(failed, F.lit(True)))
    last = F.max(F.when(F.col("_failed"), F.col(ts))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    free = ~F.col("_failed") & (last.isNull() | (F.col(ts) - last >= F.expr(f"INTERVAL {seconds} SECONDS")))  # a success that no lock can meet
    parts, span = _stretches(bad.withColumn("_free", free), keys, [ts, tie], F.lag("_free").over(w)), timedelta(seconds=seconds)

    def step(state, at, is_failed):
        count, until = state or (0, None)
        if until is not None and at < until:
            return (count, until), ("locked", count)
        if not is_failed:
            return (0, None), ("in", 0)
        count += 1
        return (count, at + span if count >= most else None), ("failed", count)

    out = folded(parts, [*keys, "_stretch"], [ts, tie], [ts, "_failed"], step, {"outcome": ("string", pa.string()), "failures": ("long", pa.int64())})
    return out.drop("_stretch", "_free", "_failed")
