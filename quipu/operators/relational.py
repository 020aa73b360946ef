"""Ranking, prefix joins, trees, paging, comparison of tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quipu.sources.shared import materialized


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key.  Spark limits each partition to n rows per key before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def most_complete(df: DataFrame, keys: Sequence[str], fields: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of rows with one key the one with most fields filled; ties by `order`."""
    filled = sum((F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), 1).otherwise(0) for f in fields), F.lit(0))
    return latest_per_key(df, keys, [filled.desc(), *order])


def prefixes(code: Column, lengths: Sequence[int]) -> Column:
    """The prefixes of the code of the given lengths."""
    return F.array_distinct(F.array(*[F.substring(code, 1, n) for n in lengths]))


def longest_prefix(codes: DataFrame, code: str, rules: DataFrame, prefix: str, lengths: Sequence[int]) -> DataFrame:
    """Codes with the rule of their longest known prefix (nulls where none fits): an equi-join on exploded prefixes, no nested loop."""
    columns = [c for c in rules.columns if c != prefix]
    candidates = codes.select(code).distinct().select(code, F.explode(prefixes(F.col(code), lengths)).alias(prefix))
    best = candidates.join(rules, prefix).groupBy(code).agg(F.max_by(F.struct(prefix, *columns), F.length(prefix)).alias("_r")).select(code, "_r.*")
    return codes.join(best, code, "left")


def rank_total(df: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """rank() over the whole table by falling value without a single-task sort: the distinct values are ranged and counted before."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(parts, F.col(value).desc()).withColumn("_part", F.spark_partition_id())
    counts = materialized(counts, "ranges")  # the ranges are sampled, so both uses must read the same ones
    sums = counts.groupBy("_part").agg(F.sum("_n").alias("_s"))
    before = sums.alias("a").join(sums.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy(F.col("a._part").alias("_part")).agg(F.coalesce(F.sum("b._s"), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(before), "_part")
    return df.join(ranked.select(value, (F.col("_before") + F.col("_inside") + 1).alias("rank")), value)


def tree_paths(nodes: DataFrame, code: str, parent: str, name: str, separator: str) -> DataFrame:
    """(code, path, depth) of all nodes under the roots: one join a level, each level stored, so neither rows nor depth are limited.

    A node that its parents lead back to hangs under no root and has no path.
    """
    nodes = nodes.select(F.col(code).alias("code"), F.col(parent).alias("parent"), F.col(name).alias("name"))
    level = materialized(nodes.filter("parent IS NULL").select("code", F.col("name").alias("path"), F.lit(1).alias("depth")), "level")
    found = [level]
    while True:
        below = nodes.alias("n").join(level.alias("p"), F.col("n.parent") == F.col("p.code"))
        level = materialized(below.select("n.code", F.concat("p.path", F.lit(separator), "n.name").alias("path"), (F.col("p.depth") + 1).alias("depth")), "level")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(level)


def common_prefix(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys and the longest common beginning of the texts of each: that of the least and the greatest one."""
    ends = df.filter(F.col(text).isNotNull()).groupBy(*keys).agg(F.min(text).alias("_a"), F.max(text).alias("_z"))
    places = F.sequence(F.lit(0), F.least(F.length("_a"), F.length("_z")))
    fits = F.filter(places, lambda n: F.substring("_a", F.lit(1), n) == F.substring("_z", F.lit(1), n))
    return ends.select(*keys, F.substring("_a", F.lit(1), F.array_max(fits)).alias("prefix"))


def page(df: DataFrame, order: Sequence[Column], size: int, number: int) -> DataFrame:
    """Page `number` (from 1) with the total of rows beside each."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(size * (number - 1)).limit(size).crossJoin(F.broadcast(total))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table alone, with the side that has them (distinct, as EXCEPT)."""
    return a.subtract(b).withColumn("side", F.lit("a")).unionByName(b.subtract(a).withColumn("side", F.lit("b")))


def zero_filled(spine: DataFrame, facts: DataFrame, on: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return spine.join(facts, list(on), "left").fillna(0, list(measures))
