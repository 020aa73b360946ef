"""The classifier as one engine: signals of five origins, conditions, suspended exemptions, the leading rule, options, state and confidence.

A catalogue is data: an edited one is another set of the same tables, so two of them can answer the same items and be compared.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quipu.operators.matching import best_rules
from quipu.operators.relational import longest_prefix
from quipu.operators.rules import WEIGHTS, met, tagged_rules

#: The categories that a suspended exemption changes from and to.
EXEMPT, GENERAL = "exempt", "general"
#: Factors of the confidence (several options, rules that agree, rules that don't) and its limit.
SEVERAL, AGREE, DISAGREE, MOST = 0.8, 1.05, 0.8, 0.99


@dataclass(frozen=True)
class Catalogue:
    """rules: rule, priority.  patterns: (rule, pattern, priority) of names.  prefixes: prefix, rule.  publications: kind, rule.
    categories: tag, rule, priority.  options: rule, place, category, legal_base (array), condition, field, op, limit.
    decrees: article (prefix of a legal base), since, until, bases (array): exemptions that are suspended for imports."""

    rules: DataFrame
    patterns: tuple[tuple[str, str, int], ...]
    prefixes: DataFrame
    publications: DataFrame
    categories: DataFrame
    options: DataFrame
    decrees: DataFrame

    def with_priority(self, rule: str, priority: int) -> Catalogue:
        """The catalogue after an edit of one rule's priority, in its patterns and its tags too."""
        to = lambda df: df.withColumn("priority", F.when(F.col("rule") == rule, priority).otherwise(F.col("priority")))
        patterns = tuple((r, p, priority if r == rule else q) for r, p, q in self.patterns)
        return replace(self, rules=to(self.rules), categories=to(self.categories), patterns=patterns)


def signals(items: DataFrame, catalogue: Catalogue) -> DataFrame:
    """items: item, code, publication, tags (array), product, name -> (item, rule, origin).

    A code names the rule of its longest prefix, a publication those of its kind, tags those of the highest priority, a product's name and
    the name that was given the pattern rules that rank first.  A null says nothing.
    """
    lengths = sorted({len(r[0]) for r in catalogue.prefixes.select("prefix").distinct().collect()}) or [1]  # a few rules' prefixes
    coded = longest_prefix(items.filter("code IS NOT NULL").select("item", "code"), "code", catalogue.prefixes, "prefix", range(lengths[0], lengths[-1] + 1))
    tagged = items.filter(F.size("tags") > 0).select("item", "tags")
    named = lambda c: best_rules(items.filter(F.col(c).isNotNull()).select("item", c), "item", F.col(c), catalogue.patterns)
    found = {
        "code": coded.filter("rule IS NOT NULL"), "book": items.join(catalogue.publications, F.col("publication") == F.col("kind")), "category": tagged_rules(tagged, "tags", catalogue.categories),
        "product": named("product"), "name": named("name"),
    }
    out = None
    for origin, rows in found.items():
        rows = rows.select("item", "rule", F.lit(origin).alias("origin"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _suspended(options: DataFrame, decrees: DataFrame) -> DataFrame:
    """Options of imports whose exemption a decree suspends on their day: the general rate, the decree's articles first.  Of several decrees
    the one that began first counts; decrees are few and stand in one row."""
    held = decrees.agg(F.array_sort(F.collect_list(F.struct("since", "article", "until", "bases"))).alias("decrees"))
    applies = lambda d: (d["since"] <= F.col("day")) & (d["until"].isNull() | (d["until"] >= F.col("day"))) & F.exists("legal_base", lambda b: b.startswith(d["article"]))
    found = F.when((F.col("operation") == "import") & (F.col("category") == EXEMPT), F.try_element_at(F.filter("decrees", applies), F.lit(1)))
    hit = options.crossJoin(held).withColumn("decree", found)
    gone = F.col("decree").isNotNull()
    rest = [c for c in options.columns if c not in ("category", "legal_base")]
    return hit.select(*rest, F.when(gone, GENERAL).otherwise(F.col("category")).alias("category"), F.when(gone, F.concat("decree.bases", "legal_base")).otherwise(F.col("legal_base")).alias("legal_base"), gone.alias("suspended"))


def answers_by_rule(items: DataFrame, catalogue: Catalogue) -> DataFrame:
    """(item, by_rule): an array of (place, rule, weight, evaluates, options) in the rules' order: weight, priority, name.

    An option whose condition is not met is left out, unless no option of its rule remains; without the datum it stays.
    """
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("origin"))
    best = signals(items, catalogue).groupBy("item", "rule").agg(F.max(weight).alias("weight")).join(catalogue.rules.select("rule", "priority"), "rule")
    placed = best.withColumn("rule_place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("weight"), F.desc("priority"), "rule"))).drop("priority")
    context = items.select("item", "operation", "day", "context")
    options = placed.join(catalogue.options, "rule").join(context, "item").withColumn("holds", met(F.col("op"), F.col("limit"), F.try_element_at("context", F.col("field"))))
    some = F.max(F.coalesce("holds", F.lit(True))).over(Window.partitionBy("item", "rule"))
    evaluates = F.max(F.col("op").isNotNull()).over(Window.partitionBy("item", "rule"))
    live = options.withColumn("some", some).withColumn("evaluates", evaluates).filter(F.coalesce("holds", F.lit(True)) | ~F.col("some"))
    live = _suspended(live.select("item", "rule", "weight", "rule_place", "evaluates", "place", "category", "legal_base", "condition", "operation", "day"), catalogue.decrees)
    each = live.groupBy("item", "rule_place", "rule", "weight", "evaluates").agg(F.array_sort(F.collect_list(F.struct("place", "category", "legal_base", "condition", "suspended"))).alias("options"))
    return each.groupBy("item").agg(F.array_sort(F.collect_list(F.struct(F.col("rule_place").alias("place"), "rule", "weight", "evaluates", "options"))).alias("by_rule"))


def _options_of(r: Column, rules: Column) -> Column:
    return F.transform(r["options"], lambda o: F.struct(o["category"].alias("category"), o["legal_base"].alias("legal_base"), o["condition"].alias("condition"), rules.alias("rules"), o["suspended"].alias("suspended")))


def classified(items: DataFrame, catalogue: Catalogue) -> DataFrame:
    """items: item, code, publication, tags, product, name, operation, day, context (map of numbers) -> a row for each item:
    state (decided, conditional, undetermined), confidence, rules, conflict, suspended, options (category, legal_base, condition, rules).

    Several rules that have categories in common: the leader's options stand, of the rules with just these categories the one that evaluates
    conditions, then the weightiest, then the first; without such a rule, each common category's first option.  Without common categories
    all options stand (a conflict).  Options of one category become one, with all their bases and rules; a condition stays where all have it.
    """
    answers = answers_by_rule(items, catalogue)
    categories = lambda r: F.array_distinct(F.transform(r["options"], lambda o: o["category"]))
    sets = answers.withColumn("sets", F.transform("by_rule", categories)).withColumn("rules", F.transform("by_rule", lambda r: r["rule"]))
    sets = sets.withColumn("common", F.aggregate("sets", F.col("sets")[0], lambda acc, x: F.array_intersect(acc, x)))
    exact = F.filter("by_rule", lambda r: F.size(categories(r)) == F.size("common"))
    ranked = F.transform(exact, lambda r: F.struct(r["evaluates"].cast("int").alias("evaluates"), r["weight"].alias("weight"), (-r["place"]).alias("place"), r["options"].alias("options")))
    first = lambda a, b: F.when(a["evaluates"] != b["evaluates"], b["evaluates"] - a["evaluates"]).when(a["weight"] > b["weight"], -1).when(a["weight"] < b["weight"], 1).otherwise(b["place"] - a["place"])
    lead = sets.withColumn("leader", F.try_element_at(F.array_sort(ranked, first), F.lit(1)))
    every = F.flatten(F.transform("by_rule", lambda r: _options_of(r, F.array(r["rule"]))))
    of_leader = F.transform("leader.options", lambda o: F.struct(o["category"].alias("category"), o["legal_base"].alias("legal_base"), o["condition"].alias("condition"), F.col("rules").alias("rules"), o["suspended"].alias("suspended")))
    lead = lead.withColumn("every", every)
    firsts = F.transform("common", lambda c: F.try_element_at(F.filter("every", lambda o: o["category"] == c), F.lit(1)))
    several, agree = F.size("by_rule") > 1, F.size("common") > 0
    chosen = lead.withColumn("chosen", F.when(several & agree & F.col("leader").isNotNull(), of_leader).when(several & agree, firsts).otherwise(F.col("every")))
    chosen = chosen.withColumn("names", F.array_distinct(F.transform("chosen", lambda o: o["category"])))

    def merged(name: Column) -> Column:
        same = F.filter("chosen", lambda o: o["category"] == name)
        one = F.forall(same, lambda o: o["condition"].eqNullSafe(same[0]["condition"]))
        union = lambda field: F.array_distinct(F.flatten(F.transform(same, lambda o: o[field])))
        return F.struct(name.alias("category"), union("legal_base").alias("legal_base"), F.when(one, same[0]["condition"]).alias("condition"), union("rules").alias("rules"))

    options = F.transform("names", merged)
    decided = F.size("names") == 1
    factor = F.when(~several, 1.0).when(agree, AGREE).otherwise(DISAGREE)
    confidence = F.least(F.lit(MOST), F.floor(F.col("by_rule")[0]["weight"] * F.when(decided, 1.0).otherwise(SEVERAL) * factor * 100 + 0.5) / 100)
    out = chosen.select("item", F.when(decided, "decided").otherwise("conditional").alias("state"), confidence.alias("confidence"), "rules", (several & ~agree).alias("conflict"), F.exists("chosen", lambda o: o["suspended"]).alias("suspended"), options.alias("options"))
    kinds = {f.name: f.dataType for f in out.schema}
    every_item = items.select("item").join(out, "item", "left")
    unknown = {"state": F.lit("undetermined"), "confidence": F.lit(0.0), "rules": F.array(), "conflict": F.lit(False), "suspended": F.lit(False), "options": F.array()}
    return every_item.select("item", *[F.coalesce(c, v.cast(kinds[c])).alias(c) for c, v in unknown.items()])
