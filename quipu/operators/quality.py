"""Data-quality rules as rows: one labelled count of violations per rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows for which a rule is false (null passes), all rules in one scan."""
    counts = df.agg(*[F.count_if(r == F.lit(False)).alias(name) for name, r in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("r")).select("r.*")


def orphans(name: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    lost = child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
    return lost.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("violations"))


def repeated(name: str, df: DataFrame, *keys: str) -> DataFrame:
    """Keys (nulls equal) with more than one row."""
    return df.groupBy(*keys).count().filter("count > 1").agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("violations"))


def report(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require(result: DataFrame) -> None:
    """Raises with the rules that are violated; a report has a row per rule."""
    bad = result.filter("violations > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r.rule}: {r.violations}" for r in bad))


def found(rule: str, violations: DataFrame) -> DataFrame:
    """(rule, violations, first): the violating keys (one column) counted, and the least of them as text for the message."""
    key = F.col(violations.columns[0]).cast("string")
    return violations.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("violations"), F.min(key).alias("first"))


def unordered(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value is above that of the row before it, where a falling order was promised."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_last", F.lag(value).over(w)).filter(F.col(value) > F.col("_last")).drop("_last")
