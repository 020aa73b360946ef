"""Code trees: the parent of each code by prefix, checked against the parent by indentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: rows of a partition.
ROWS = 100_000


def effective(code: Column, stem: int) -> Column:
    """The code without its trailing zeros, but at least its first `stem` signs."""
    short = F.regexp_replace(code, "0+$", "")
    return F.when(F.length(short) >= stem, short).otherwise(F.left(code, F.lit(stem)))


def code_tree(nodes: DataFrame, stem: int, levels: int) -> DataFrame:
    """(seq, code, level) -> seq, code, heading, parent, by_indent, terminal, agrees.

    parent: of the rows before, in the same heading (first `stem` signs), that with the longest effective code that this code begins with;
    the earliest of equals.  by_indent: the last row before with a lower level.  terminal: nobody's parent.  Prefixes are exploded to an
    equi-join, so the work grows with the length of codes, not with pairs; levels are counted from 1 to `levels`.  The number of partitions
    grows with the rows, so that a task's share does not.
    """
    n = nodes.count() // ROWS + 1
    rows = nodes.withColumn("heading", F.left("code", F.lit(stem))).repartition(n, "heading")
    above = rows.select("heading", effective(F.col("code"), stem).alias("prefix"), F.col("seq").alias("at"), F.col("code").alias("other")).repartition(n, "heading", "prefix")
    lengths = F.sequence(F.lit(stem), F.greatest(F.length("code"), F.lit(stem)))
    begins = rows.select("seq", "code", "heading", F.explode(F.transform(lengths, lambda z: F.left(F.col("code"), z))).alias("prefix")).repartition(n, "heading", "prefix")
    met = begins.join(above, ["heading", "prefix"]).filter((F.col("at") < F.col("seq")) & (F.col("other") != F.col("code")))
    found = met.repartition(n, "seq").groupBy("seq").agg(F.max_by("other", F.struct(F.length("prefix"), -F.col("at"))).alias("parent"))
    before = Window.partitionBy("heading").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    lasts = F.array(*[F.when(F.col("level") > n, F.last(F.when(F.col("level") == n, F.struct("seq", "code")), ignorenulls=True).over(before)) for n in range(1, levels)])
    indented = rows.withColumn("by_indent", F.array_max(lasts)["code"])
    parents = found.select(F.col("parent").alias("code")).distinct().withColumn("has", F.lit(True))
    out = indented.join(found, "seq", "left").join(parents, "code", "left")
    return out.select("seq", "code", "heading", "parent", "by_indent", F.col("has").isNull().alias("terminal"), F.col("parent").eqNullSafe(F.col("by_indent")).alias("agrees"))
