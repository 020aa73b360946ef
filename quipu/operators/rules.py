"""Rule classification of items: weighted signals, options with conditions, combination of several rules, state and confidence.

Signals come as rows (item, rule, origin, weight), so each origin is a join of its own; nothing is folded outside Spark's aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much a signal of each origin weighs.
WEIGHTS = {"code": 0.95, "book": 0.95, "category": 0.85, "product": 0.70, "name": 0.75}


def rule_weights(signals: DataFrame, rules: DataFrame) -> DataFrame:
    """(item, rule, priority, weight, place): each rule's best weight; place 1 is the rule that leads."""
    best = signals.groupBy("item", "rule").agg(F.max("weight").alias("weight")).join(F.broadcast(rules.select("rule", "priority")), "rule")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("weight"), F.desc("priority"), "rule")))


def met(op: Column, limit: Column, value: Column) -> Column:
    """Does the value meet the condition?  Null where the condition or the value is missing."""
    return F.when(op == "<", value < limit).when(op == "<=", value <= limit).when(op == ">", value > limit).when(op == ">=", value >= limit).when(op == "=", value == limit).when(op == "!=", value != limit)


def live_options(weighted: DataFrame, options: DataFrame, context: DataFrame) -> DataFrame:
    """(item, rule, place, weight, category, condition, tested): options that are not false; all where every one of the rule is false.

    options: rule, category, condition, op, limit.  context: item, value.
    """
    all_ = weighted.join(F.broadcast(options), "rule").join(context, "item", "left").withColumn("holds", met(F.col("op"), F.col("limit"), F.col("value")))
    some = F.max(F.coalesce(F.col("holds"), F.lit(True))).over(Window.partitionBy("item", "rule"))
    kept = all_.withColumn("_some", some).filter(F.coalesce("holds", F.lit(True)) | ~F.col("_some"))
    return kept.select("item", "rule", "place", "weight", "category", "condition", F.col("op").isNotNull().alias("tested"))


def suspended(category: Column, legal_base: Column, operation: Column, exempt_prefix: str) -> Column:
    """On imports, exemptions whose legal base begins so fall back to the general rate."""
    return F.when((operation == "import") & (category == "exempt") & legal_base.startswith(exempt_prefix), "general").otherwise(category)


def suspended_base(legal_base: Column, changed: Column, decree: list[str]) -> Column:
    """Where the exemption is suspended, the decree's articles stand before the legal base (an array)."""
    return F.when(changed, F.concat(F.array(*map(F.lit, decree)), legal_base)).otherwise(legal_base)


def narrowing_rule(answers: DataFrame) -> DataFrame:
    """(item, rule, place, weight, evaluates, categories: array) -> item, n, common, leader.

    Of several rules that agree in some categories, the leader has just these; one that evaluates conditions goes before, then the weightier,
    then the earlier place.  Null where no rule has just these, or where the item has one rule.
    """
    sets = answers.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.collect_list("categories").alias("sets"), F.collect_list(F.struct("evaluates", "weight", (-F.col("place")).alias("place"), "rule", F.size("categories").alias("size"))).alias("all"))
    common = F.array_sort(F.aggregate(F.slice("sets", F.lit(2), F.size("sets")), F.col("sets")[0], lambda acc, x: F.array_intersect(acc, x)))
    best = F.array_max(F.filter("all", lambda r: r["size"] == F.size("common")))["rule"]
    agreed = sets.withColumn("common", common)
    return agreed.select("item", "n", "common", F.when((F.col("n") > 1) & (F.size("common") > 0), best).alias("leader"))


def combined(live: DataFrame) -> DataFrame:
    """One row per item: categories (sorted), rules, state, confidence.

    Several rules: categories common to all narrow the answer (to those of the rule that has just them, if there is one); without any,
    all categories stay and the confidence falls.  One category decides; several are conditional.
    """
    per_rule = live.groupBy("item", "rule", "place", "weight").agg(F.array_sort(F.collect_set("category")).alias("c"))
    sets = per_rule.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("base"), F.collect_list("c").alias("sets"), F.array_sort(F.collect_set("rule")).alias("rules"))
    common = F.array_sort(F.aggregate(F.slice("sets", F.lit(2), F.size("sets")), F.col("sets")[0], lambda acc, x: F.array_intersect(acc, x)))
    union = F.array_sort(F.array_distinct(F.flatten("sets")))
    agree = (F.col("n") > 1) & (F.size("common") > 0)
    out = sets.withColumn("common", common).withColumn("categories", F.when(F.size("common") > 0, F.col("common")).otherwise(union))
    decided = F.size("categories") == 1
    factor = F.when(F.col("n") == 1, 1.0).when(agree, 1.05).otherwise(0.8)
    confidence = F.least(F.lit(0.99), F.floor(F.col("base") * F.when(decided, 1.0).otherwise(0.8) * factor * 100 + 0.5) / 100)
    return out.select("item", "categories", "rules", F.when(decided, "decided").otherwise("conditional").alias("state"), confidence.alias("confidence"))


def broken_cases(cases: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Golden cases that an edited rule set answers otherwise: key, expected, got (both as JSON).  An edit is accepted when none is left."""
    fields = [c for c in cases.columns if c != key]
    joined = cases.select(key, F.struct(*fields).alias("_e")).join(answers.select(key, F.struct(*fields).alias("_g")), key, "left")
    return joined.filter(~F.col("_e").eqNullSafe(F.col("_g"))).select(key, F.to_json("_e").alias("expected"), F.to_json("_g").alias("got"))


def merged_options(options: DataFrame) -> DataFrame:
    """Options (item, rule, category, condition) of one category become one: their rules, and the condition only where all have the same."""
    grouped = options.groupBy("item", "category").agg(F.array_sort(F.collect_set("rule")).alias("rules"), F.min("condition").alias("_low"), F.max("condition").alias("_high"), F.count_if(F.col("condition").isNull()).alias("_none"))
    return grouped.select("item", "category", "rules", F.when((F.col("_low") == F.col("_high")) & (F.col("_none") == 0), F.col("_low")).alias("condition"))


def tagged_rules(items: DataFrame, tags: str, rules: DataFrame) -> DataFrame:
    """Rules (tag, rule, priority) that an item's tags name, those of the highest priority alone."""
    key = [c for c in items.columns if c != tags]
    met = items.select(*key, F.explode(tags).alias("tag")).join(rules, "tag").select(*key, "rule", "priority").distinct()
    return met.withColumn("_r", F.rank().over(Window.partitionBy(*key).orderBy(F.desc("priority")))).filter("_r = 1").drop("_r")


def residual(codes: DataFrame, classified: DataFrame, key: str, percent: int) -> DataFrame:
    """Codes that no rule knows fall to the general rate, conditionally; the others keep their rule.  A code may stand on several rows of both."""
    joined = codes.join(classified.dropDuplicates([key]), key, "left")
    return joined.withColumns({"percent": F.when(F.col("rule").isNull(), percent), "state": F.when(F.col("rule").isNull(), "conditional")})
