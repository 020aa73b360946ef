"""One record of several sources: the first value that says something, the later period, and how often sources disagree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _said(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def consolidated(rows: DataFrame, key: str, order: Sequence[str], first: Sequence[str] = (), latest: Sequence[str] = (), source: str = "source") -> DataFrame:
    """One row a key: of the `first` fields the first value that is not empty, of the `latest` ones the greatest, the sources, and the conflicts.

    rows come in the order of the columns `order`; a conflict is a value that differs from the one held when it arrives: the first one for
    `first` fields, the greatest so far for `latest` ones.  `<field>_conflicts` counts them.  All fields are text; null and empty say nothing.
    A key's rows are folded as one sorted array, a field at a time; they are bounded by the sources that list a key.
    """
    fields = [*first, *latest]
    held = F.sort_array(F.collect_list(F.struct(*order, *[_said(F.col(f)).alias(f) for f in fields])))
    grouped = rows.groupBy(key).agg(held.alias("rows"), F.array_sort(F.collect_set(source)).alias("sources"))

    def fold(field: str) -> Column:
        values = F.filter(F.transform("rows", lambda r: r[field]), lambda v: v.isNotNull())
        start = F.struct(F.lit(None).cast("string").alias("value"), F.lit(0).alias("conflicts"))
        keep = (lambda s, v: F.greatest(s["value"], v)) if field in latest else (lambda s, v: F.coalesce(s["value"], v))
        return F.aggregate(values, start, lambda s, v: F.struct(keep(s, v).alias("value"), (s["conflicts"] + F.when(s["value"] != v, 1).otherwise(0)).alias("conflicts")))

    folded = grouped.select(key, "sources", *[fold(f).alias(f"_{f}") for f in fields])
    return folded.select(key, *[F.col(f"_{f}.value").alias(f) for f in fields], *[F.col(f"_{f}.conflicts").alias(f"{f}_conflicts") for f in fields], "sources")


def conflict_report(table: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, conflicts, keys): conflicts of each field over all keys, and how many keys have one."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_conflicts").alias("n")) for f in fields])
    return table.select(F.explode(each).alias("c")).groupBy("c.field").agg(F.sum("c.n").alias("conflicts"), F.count_if(F.col("c.n") > 0).alias("keys"))


def breakdown(rows: DataFrame, key: str, part: str, amount: str) -> tuple[DataFrame, DataFrame]:
    """(totals, parts): (key, amount, parts) with the number of different parts, and (key, part, amount, repeated), repeats of a part summed
    and counted.  Two levels of one shuffle: totals are sums of parts."""
    parts = rows.groupBy(key, part).agg(F.sum(amount).alias(amount), (F.count(F.lit(1)) - 1).alias("repeated"))
    return parts.groupBy(key).agg(F.sum(amount).alias(amount), F.count(F.lit(1)).alias("parts")), parts
