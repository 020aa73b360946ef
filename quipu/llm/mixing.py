"""Operator 4: mixing sources to target weights by pivotal dependent rounding.

A document's expected copies are target / source size.  The whole part is taken; the fraction is settled by pairing documents of
a source and moving words between them at random until one of the two is integral.  Groups of bounded size do this in parallel;
the one document that each leaves open goes up a level, until one is left per source, which takes the nearer integer.
Words are preserved by every pairing, so a source misses its target by at most half of one document.

Null texts have size 0, null sources form one source, the last.  Documents without words take the whole part of their copies.  A long text
is one unit, however long.  Rows that repeat are units of their own, equal ones in any order, so ties change no result; rows with a null
id are told apart by source and size only.  Without documents there are no rows.  Of clashing columns only `copy` is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quipu.llm.common import SPACES, read, small, stored

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
GROUP, CHUNK, SALTS = 2048, 1_000_000, 1024
UNIT = "doc_id long, source string, size long, source_size long, target double, nth long, whole int, part double"


def source_targets(sized: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source: its size and target.  Water filling in closed form: in order of cap / weight, sources are capped while the level is above that."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")).cast("double")
    caps = totals.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    up = Window.orderBy("level", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    water = (share * F.sum("source_size").over(whole) - before) / rest
    found = caps.withColumn("water", water)
    level = F.min_by("water", F.when(F.col("water") <= F.col("level"), F.col("level"))).over(whole)
    found = found.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))))
    return found.select("source", "source_size", "target")


def settle(sizes: np.ndarray, parts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Pivotal rounding in the given order; all but one of the returned parts are 0 or 1, and sizes @ parts is unchanged."""
    parts, draws, held = parts.copy(), rng.random(len(parts)), 0
    for i in range(1, len(parts)):
        a, b, sa, sb = parts[held], parts[i], sizes[held], sizes[i]
        gain, loss = min((1 - a) * sa, b * sb), min(a * sa, (1 - b) * sb)
        moved = gain if draws[i] * (gain + loss) < loss else -loss
        a, b = a + moved / sa, b - moved / sb
        a, b = (0.0 if a < 1e-9 else 1.0 if a > 1 - 1e-9 else a), (0.0 if b < 1e-9 else 1.0 if b > 1 - 1e-9 else b)
        parts[held], parts[i] = a, b
        held = i if a in (0.0, 1.0) else held
    return parts


def _settle_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "salt", "doc_id", "nth"], ascending=[False, True, True, True], kind="stable")
    parts = settle(pdf["size"].to_numpy(float), pdf["part"].to_numpy(float), np.random.default_rng(int(pdf["seed"].iloc[0]) & 0xFFFFFFFF))
    if bool(pdf["last"].iloc[0]):
        parts = np.floor(parts + 0.5)
    return pdf.assign(part=parts)[[c.split()[0] for c in UNIT.split(", ")]]


def numbered(sized: DataFrame) -> DataFrame:
    """sized with `nth`, from 1 among equal rows.  Equal rows are counted, not gathered: many are spelled out in chunks, by many tasks."""
    equal = stored(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")), "sizes")
    chunks = equal.filter(F.col("m") > CHUNK).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / CHUNK) - 1)))
    chunks = chunks.repartition("doc_id", "source", "size", "chunk").withColumn("to", F.least("m", (F.col("chunk") + 1) * CHUNK))
    many = chunks.select("doc_id", "source", "size", F.explode(F.sequence(F.col("chunk") * CHUNK + 1, "to")).alias("nth"))
    few = equal.filter(F.col("m") <= CHUNK).select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("nth"))
    return few.unionByName(many)


def mix(sized: DataFrame, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """sized: doc_id, source, size.  Returns each with source_size, target, copies, taken; the same rows and seed give the same copies."""
    sized = stored(numbered(sized), "units")
    targets = small(source_targets(sized, share, most).withColumnRenamed("source", "of"), 100_000)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("e", expected)
    units = units.withColumn("whole", F.floor(F.col("e") + 1e-9).cast("int")).withColumn("part", F.greatest(F.col("e") - F.col("whole"), F.lit(0.0))).drop("e")
    units = units.withColumn("part", F.when((F.col("part") < 1e-9) | (F.col("size") == 0), F.lit(0.0)).otherwise(F.col("part")))
    open_ = (F.col("part") > 0) & (F.col("part") < 1)
    columns = [c.split()[0] for c in UNIT.split(", ")]
    done, level, at = [units.filter(~open_).select(columns)], units.filter(open_).select(columns), 0
    while True:
        counts = level.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "of")
        most_groups = counts.agg(F.max(F.ceil(F.col("n") / GROUP))).first()[0] or 0
        salted = level.join(small(counts, 100_000), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        salted = salted.withColumn("salt", F.xxhash64(F.lit(seed + at), "doc_id", "size", "nth")).withColumn("group", F.pmod("salt", F.ceil(F.col("n") / GROUP)))
        salted = salted.withColumn("seed", F.xxhash64(F.lit(seed), F.lit(at), "source", "group")).withColumn("last", F.lit(most_groups <= 1))
        settled = salted.groupBy("source", "group").applyInPandas(_settle_group, UNIT)
        if most_groups <= 1:
            done.append(settled)
            break
        settled = stored(settled, f"level{at}")
        done.append(settled.filter(~open_))
        level, at = settled.filter(open_), at + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("part")).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with a row per copy taken (`copy` from 1, in place of a column of that name); a document of which none is taken has no row.

    Rows of equal id, source and size differ in copies only where they repeat; those few are ranked by their text's hash, in salted parts.
    """
    columns = [c for c in docs.columns if c.lower() != "copy"]
    whole = docs.select(F.struct(*columns).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("h"))
    over = [F.count_if(F.col("copies") > k).alias(f"over{k}") for k in range(2)]
    tally = mix(whole.select("doc_id", "source", "size"), **options).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m"), *over)
    tally = stored(tally, "tally")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("doc_id", "source", "size")]
    joined = whole.alias("d").join(tally.hint("shuffle_hash").alias("t"), same[0] & same[1] & same[2]).select("d.row", "d.doc_id", "d.source", "d.size", "d.h", "t.m", "t.over0", "t.over1")
    even = F.col("over0").isin(0, F.col("m")) & F.col("over1").isin(0, F.col("m"))
    plain = joined.filter(even).select("row", ((F.col("over0") > 0).cast("int") + (F.col("over1") > 0).cast("int")).alias("copies"))
    if not tally.filter(~even).isEmpty():
        key = ["doc_id", "source", "size"]
        uneven = joined.filter(~even).withColumn("part", F.pmod("h", F.lit(SALTS)))
        parts = uneven.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"))
        parts = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        match = [F.col(f"u.{c}").eqNullSafe(F.col(f"p.{c}")) for c in (*key, "part")]
        ranked = uneven.alias("u").join(parts.alias("p"), match[0] & match[1] & match[2] & match[3]).select("u.*", "p.before")
        nth = F.col("before") + F.row_number().over(Window.partitionBy(*key, "part").orderBy("h"))
        plain = plain.unionByName(ranked.withColumn("nth", nth).select("row", ((F.col("nth") <= F.col("over0")).cast("int") + (F.col("nth") <= F.col("over1")).cast("int")).alias("copies")))
    kept = plain.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return kept.select("row.*", "copy")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
