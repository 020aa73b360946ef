"""Rules over texts and doubtful prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_rules(items: DataFrame, key: str, text: Column, rules: Sequence[tuple[str, str, int]]) -> DataFrame:
    """Items with the rules (name, pattern, priority) that rank first: highest priority, then leftmost match; ties stay together.

    The patterns are part of the expression, so the items are read once and never multiplied by the rules.
    """
    hits = F.array(*[F.when(text.rlike(p), F.struct(F.lit(name).alias("rule"), F.lit(q).alias("priority"), F.regexp_instr(text, F.lit(p)).alias("at"))) for name, p, q in rules])
    found = F.filter(hits, lambda h: h.isNotNull())
    top = F.array_min(F.transform(found, lambda h: F.struct((-h["priority"]).alias("p"), h["at"].alias("at"))))
    best = F.filter(found, lambda h: (h["priority"] == -top["p"]) & (h["at"] == top["at"]))
    return items.withColumn("_best", best).select(*items.columns, F.explode("_best").alias("_b")).select(*items.columns, "_b.rule", "_b.priority")


def doubtful(offers: DataFrame, group: Sequence[str], price: str) -> Column:
    """From three offers on: below 0.4 or above 2.5 times the median of positive prices; of two, both if one is over 4 times the other.
    Prices of 0 or less are not compared with."""
    w = Window.partitionBy(*group)
    real = F.when(F.col(price) > 0, F.col(price))
    n, middle = F.count(F.lit(1)).over(w), F.median(real).over(w)
    ratio = F.coalesce(F.max(real).over(w) > 4 * F.min(real).over(w), F.lit(False))
    return F.when(n >= 3, (F.col(price) < 0.4 * middle) | (F.col(price) > 2.5 * middle)).when(n == 2, ratio).otherwise(F.lit(False))
