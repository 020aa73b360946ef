"""Merging batches into tables as DataFrames: what a table is after the batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.operators.relational import latest_per_key


def insert_absent(table: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of the batch whose key is new are added; of several with one key the first by `order`."""
    return table.unionByName(latest_per_key(batch, keys, order).join(table.select(*keys), list(keys), "left_anti").select(table.columns))


def upsert(table: DataFrame, batch: DataFrame, keys: Sequence[str], keep_old: Sequence[str] = ()) -> DataFrame:
    """Batch values win, those in keep_old only where the table has null.  `change`: new, updated, same or kept."""
    values = [c for c in table.columns if c not in keys]
    t = table.select(*keys, F.struct(*values).alias("_old"))
    b = batch.select(*keys, F.struct(*values).alias("_new"))
    joined = t.join(b, list(keys), "full_outer")
    has_old, has_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    same = F.col("_old").eqNullSafe(F.col("_new"))
    change = F.when(~has_old, "new").when(~has_new, "kept").when(same, "same").otherwise("updated")

    def value(c: str) -> Column:
        old, new = F.col(f"_old.{c}"), F.col(f"_new.{c}")
        return (F.coalesce(old, new) if c in keep_old else F.when(has_new, new).otherwise(old)).alias(c)

    return joined.select(*keys, *[value(c) for c in values], change.alias("change"))


def additive(table: DataFrame, batch: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    return table.unionByName(batch).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def soft_delete(table: DataFrame, present: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """`flag` says whether the batch has the key; keys that only the batch has are added."""
    seen = present.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return table.join(seen, list(keys), "full_outer").withColumn(flag, F.coalesce("_seen", F.lit(False))).drop("_seen")


def retained(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    return df.filter(F.col(ts) >= F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS"))


def change_log(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per field that differs between two versions of a table: key, field, before, after (as text)."""
    cast = lambda side: F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{side}.{f}").cast("string").alias("value")) for f in fields])
    joined = before.alias("o").join(after.alias("n"), F.col("o." + key) == F.col("n." + key), "full_outer")
    zipped = F.zip_with(cast("o"), cast("n"), lambda o, n: F.struct(o["field"].alias("field"), o["value"].alias("before"), n["value"].alias("after")))
    rows = joined.select(F.coalesce("o." + key, "n." + key).alias(key), F.explode(zipped).alias("c")).select(key, "c.*")
    return rows.filter(~F.col("before").eqNullSafe(F.col("after")))


def new_versions(history: DataFrame, table: DataFrame, key: str, catalogue: str) -> DataFrame:
    """Rows to append to a history (key, version, before, after, catalogue): one for each key whose content differs from its last version.

    Content is the row's JSON with its fields in the order of the table; nulls count as content.  A first version has no `before`.
    """
    content = F.to_json(F.struct(*[c for c in table.columns if c != key]), {"ignoreNullFields": "false"})
    last = history.groupBy(key).agg(F.max("version").alias("_v"), F.max_by("after", "version").alias("before"))
    joined = table.select(key, content.alias("after")).join(last, key, "left").filter(~F.col("before").eqNullSafe(F.col("after")))
    return joined.select(key, (F.coalesce("_v", F.lit(0)) + 1).alias("version"), "before", "after", F.lit(catalogue).alias("catalogue"))


def edited(history: DataFrame, edit: DataFrame, key: str, catalogue: str) -> DataFrame:
    """As new_versions, for edits by hand: each names its own catalogue, the base release and `+e<key>v<version>`."""
    base = catalogue.partition("+")[0]
    rows = new_versions(history, edit, key, base)
    return rows.withColumn("catalogue", F.concat(F.lit(f"{base}+e"), F.col(key).cast("string"), F.lit("v"), F.col("version").cast("string")))


def replace_part(table: DataFrame, batch: DataFrame, part: Column) -> DataFrame:
    """The rows of the table for which `part` is true give way to the batch; the others stay (also where it is null)."""
    return table.filter(~F.coalesce(part, F.lit(False))).unionByName(batch)


def replace_children(table: DataFrame, batch: DataFrame, parent: Sequence[str]) -> DataFrame:
    """All rows of the parents that the batch names give way to the batch's."""
    return table.join(batch.select(*parent).distinct(), list(parent), "left_anti").unionByName(batch)


def update_first(table: DataFrame, part: Column, order: Sequence[Column], n: int, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """New values for the first n rows of a part of the table; the n keys are small, so their flag is broadcast."""
    chosen = table.filter(part).orderBy(*order).limit(n).select(*keys, F.lit(True).alias("_hit"))
    flagged = table.join(F.broadcast(chosen), list(keys), "left")
    return flagged.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in values.items()}).drop("_hit")
