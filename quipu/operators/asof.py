"""As-of and interval joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BUCKET_DAYS, STRETCH_DAYS = 32, 128


def _asof(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], values: Sequence[str], forward: bool, tolerance_days: int | None, strict: bool) -> DataFrame:
    """Both sides in one sorted pass per key and stretch of BUCKET_DAYS: one shuffle of the rows, no pairs, no key in one task.

    What a stretch can't find inside comes from the nearest stretch of the key that has a right row; those edges are one row for each
    key and stretch.
    """
    names = [c for c in left.columns if c not in (on, *by)]
    left_first = forward != strict  # at one instant, who comes first in the scan
    bucket = F.floor(F.datediff(F.col("_at"), F.lit("1970-01-01").cast("date")) / BUCKET_DAYS).alias("_bucket")
    l = left.select(*by, F.col(on).alias("_at"), F.lit(0 if left_first else 1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(right.select(F.struct(F.col(on).alias("at"), *values)).schema[0].dataType).alias("_value"))
    r = right.select(*by, F.col(on).alias("_at"), F.lit(1 if left_first else 0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.struct(F.col(on).alias("at"), *values).alias("_value"))
    # Forward matches scan from the end: a frame that grows from the start costs a step per row, one that ends at the end costs its length.
    turn = F.desc if forward else F.asc
    inside = Window.partitionBy(*by, "_bucket").orderBy(turn("_at"), turn("_side")).rowsBetween(Window.unboundedPreceding, 0)
    out = l.unionByName(r).select("*", bucket).withColumn("_found", F.last("_value", True).over(inside)).filter("_row IS NOT NULL")

    nearest = F.min_by("_value", "_at") if forward else F.max_by("_value", "_at")
    edges = r.select(*by, "_at", "_value", bucket).groupBy(*by, "_bucket").agg(nearest.alias("_value"))
    edges = edges.unionByName(l.select(*by, bucket).distinct().withColumn("_value", F.lit(None).cast(r.schema["_value"].dataType))).groupBy(*by, "_bucket").agg(F.first("_value", True).alias("_value"))
    before = F.last("_value", True).over(Window.partitionBy(*by).orderBy(turn("_bucket")).rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_bucket").alias("_b"), before.alias("_edge")).filter("_edge IS NOT NULL")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    out = out.join(edges, reduce(and_, same, F.col("_bucket") == F.col("_b")), "left").withColumn("_found", F.coalesce("_found", "_edge"))
    if tolerance_days is not None:
        near = F.abs(F.datediff(F.col("_found.at"), F.col("_at"))) <= tolerance_days
        out = out.withColumn("_found", F.when(near, F.col("_found")))
    return out.select(*by, F.col("_at").alias(on), "_row.*", F.col("_found.at").alias("matched_at"), *[F.col(f"_found.{v}").alias(v) for v in values])


def asof_forward(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], values: Sequence[str], tolerance_days: int | None = None, strict: bool = False) -> DataFrame:
    """Each left row with the first right row at or after it (after it alone if strict); nulls where none is near enough.

    right has one row per (by, on).
    """
    return _asof(left, right, on, by, values, True, tolerance_days, strict)


def asof_backward(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], values: Sequence[str], tolerance_days: int | None = None, strict: bool = False) -> DataFrame:
    """Each left row with the last right row at or before it (before it alone if strict)."""
    return _asof(left, right, on, by, values, False, tolerance_days, strict)


def in_force(at: Column, since: Column, until: Column) -> Column:
    """Closed interval, open end where until is null."""
    return (since <= at) & (until.isNull() | (until >= at))


def join_in_force(facts: DataFrame, at: str, periods: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Facts (a date or time `at`) with the periods (since, until, ...) of their key that hold at their time.

    An equi-join on the key and stretches of STRETCH_DAYS, never a nested loop: a period stands in each stretch that it touches, from the
    first to the last one that has facts of any key, and a fact in its own.
    """
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    stretch = lambda c: F.floor(day(c) / STRETCH_DAYS)
    ends = facts.agg(F.min(stretch(F.col(at))).alias("_low"), F.max(stretch(F.col(at))).alias("_high"))
    first, last = F.greatest(stretch(F.col("since")), F.col("_low")), F.least(F.coalesce(stretch(F.col("until")), F.col("_high")), F.col("_high"))
    touched = periods.crossJoin(F.broadcast(ends)).filter(first <= last).withColumn("_stretch", F.explode(F.sequence(first, last))).drop("_low", "_high")
    held = touched.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = reduce(and_, [F.col(c) == F.col(f"_by_{c}") for c in by], stretch(F.col(at)) == F.col("_stretch"))
    return facts.join(held, same & in_force(F.col(at), F.col("since"), F.col("until"))).drop("_stretch", *(f"_by_{c}" for c in by))
