"""Which tariff codes a product's description may mean: a dictionary of trade names, product categories, full-text search as a last resort.

Every step is a join of all descriptions at once.  The dictionary joins on a term's first word before a pattern is tried; codes under a
prefix come from an equi-join on exploded prefixes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quipu.functions.text import normal
from quipu.operators import search
from quipu.operators.relational import prefixes, top_per_key

#: Confidence that a source of candidates starts with.
NAMED, BY_CATEGORY = 0.85, 0.80


def _pattern(term: Column) -> Column:
    """A term as whole words with an optional plural; ` ... ` allows up to three words between."""
    return F.concat(F.lit("(?<![a-z0-9])"), F.replace(term, F.lit(" ... "), F.lit("(?: [a-z0-9]+){0,3} ")), F.lit("(?:s|es)?(?![a-z0-9])"))


def dictionary_matches(queries: DataFrame, groups: DataFrame) -> DataFrame:
    """queries: query, text.  groups: group, terms, excluded, prefixes, priority -> (query, text, group, term, n_groups).

    Of the groups that fit, those of the highest priority and then of the leftmost term stay, ties together; words of `excluded` bar a group
    where they begin a word.  Within a group the leftmost and then the longest term counts.
    """
    text = queries.select("query", normal(F.col("text")).alias("text")).filter("text <> ''")
    words = F.array_distinct(F.split("text", " "))
    forms = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, F.regexp_replace(w, "s$", ""), F.regexp_replace(w, "es$", "")))))
    opened = groups.select("group", "priority", F.concat(F.lit("(?<![a-z0-9])(?:"), F.array_join("excluded", "|"), F.lit(")")).alias("bar"), (F.size("excluded") > 0).alias("bars"), F.explode("terms").alias("term"))
    opened = opened.withColumn("word", F.split("term", " ")[0]).withColumn("pattern", _pattern(F.col("term")))
    met = text.select("query", "text", F.explode(forms).alias("word")).join(opened, "word").withColumn("at", F.regexp_instr("text", F.col("pattern")))
    met = met.filter((F.col("at") > 0) & ~(F.col("bars") & F.regexp_like("text", F.col("bar"))))
    first = top_per_key(met, ["query", "group"], [F.col("at"), F.length("term").desc(), F.col("term")], 1)
    ranked = first.withColumn("_r", F.rank().over(Window.partitionBy("query").orderBy(F.desc("priority"), "at"))).filter("_r = 1")
    return ranked.withColumn("n_groups", F.count(F.lit(1)).over(Window.partitionBy("query"))).select("query", "text", "group", "term", "n_groups")


def remaining(text: Column, term: Column, vocabulary: Mapping[str, str]) -> Column:
    """The words that refine the search: not those of the term, but those with an official equivalent, which is added."""
    of_term = F.flatten(F.transform(F.split(F.replace(term, F.lit(" ... "), F.lit(" ")), " "), lambda w: F.array(w, F.concat(w, F.lit("s")), F.concat(w, F.lit("es")))))
    words, known = F.split(text, " "), list(vocabulary)
    kept = F.filter(words, lambda w: ~F.array_contains(of_term, w) | w.isin(known)) if known else F.array_except(words, of_term)
    official = [F.when(F.array_contains(kept, F.lit(k)), F.lit(v)) for k, v in sorted(vocabulary.items())]
    return F.array_join(F.concat(kept, F.array_compact(F.array(*official))) if official else kept, " ")


def group_candidates(asked: DataFrame, groups: DataFrame, postings: DataFrame, codes: DataFrame, lengths: Sequence[int], language: str | None) -> DataFrame:
    """asked: query, group, rest, base -> (query, code, confidence, reason).

    A group of one code is almost certain; where the rest of the text tells one code from the next it leads and up to three follow;
    else up to eight equal codes are offered.  A group of several prefixes is never certain.
    """
    under = codes.select("code", F.explode(prefixes(F.col("code"), lengths)).alias("prefix"))
    leaves = groups.select("group", F.size("prefixes").alias("n_prefixes"), F.explode("prefixes").alias("prefix")).join(under, "prefix").select("group", "n_prefixes", "code").distinct()
    words = search.terms(asked, ["query", "group"], F.col("rest"), language)
    scored = search.scores(words, ["query", "group"], postings.join(leaves.select("group", "code"), "code"), "code", within=["group"])
    rows = asked.select("query", "group", "base").join(leaves, "group").join(scored.select("query", "group", "code", "coverage", "in_b", "rank"), ["query", "group", "code"], "left").fillna(0, ["coverage", "in_b", "rank"])
    by = Window.partitionBy("query", "group")
    order = by.orderBy(F.desc("coverage"), F.desc("in_b"), F.desc("rank"), "code")
    key = F.struct("coverage", "in_b")
    rows = rows.withColumns({"place": F.row_number().over(order), "n": F.count(F.lit(1)).over(by), "first": F.first(key).over(order), "mine": key})
    rows = rows.withColumn("tied", F.count_if(F.col("mine") == F.col("first")).over(by))
    top = F.when(F.col("n_prefixes") > 1, F.least("base", F.lit(0.6))).otherwise(F.col("base"))
    told = F.col("tied") == 1
    leading = F.when(F.col("place") == 1, top - 0.05).otherwise(F.least(F.lit(0.45), top - 0.3))
    confidence = F.when(F.col("n") == 1, F.least(F.lit(0.95), top + 0.05)).when(told, leading).otherwise(F.least(F.lit(0.55), top))
    kept = rows.filter((F.col("n") == 1) | (told & (F.col("place") <= 4)) | (~told & (F.col("mine") == F.col("first")) & (F.col("place") <= 8)))
    return kept.select("query", "code", F.round(confidence, 2).alias("confidence"), F.col("group").alias("reason"))


def detect(queries: DataFrame, groups: DataFrame, postings: DataFrame, codes: DataFrame, lengths: Sequence[int], vocabulary: Mapping[str, str] | None = None,
           by_category: DataFrame | None = None, special: Sequence[str] = (), limit: int = 5, language: str | None = None) -> DataFrame:
    """queries: query, text -> (query, place, code, confidence, reasons, state); queries without a candidate have no row.

    by_category (query, group) adds groups that a product's categories name.  A code of several sources keeps its highest confidence.
    Full text answers only queries that neither source knows: half of the words, one of them in field A; codes that begin with a prefix of `special` are left out.
    """
    named = dictionary_matches(queries, groups)
    base = F.when(F.col("n_groups") > 1, F.lit(NAMED * 0.75)).otherwise(F.lit(NAMED))
    asked = named.select("query", "group", remaining(F.col("text"), F.col("term"), vocabulary or {}).alias("rest"), base.alias("base"))
    if by_category is not None:
        more = by_category.select("query", "group").distinct().join(named.select("query", "group"), ["query", "group"], "left_anti").join(queries.select("query", normal(F.col("text")).alias("text")), "query")
        asked = asked.unionByName(more.select("query", "group", remaining(F.col("text"), F.lit(""), vocabulary or {}).alias("rest"), F.lit(BY_CATEGORY).alias("base")))
    found = group_candidates(asked, groups, postings, codes, lengths, language)
    open_ = queries.join(found.select("query").distinct(), "query", "left_anti")
    general = postings.filter(~F.greatest(*[F.col("code").startswith(s) for s in special], F.lit(False))) if special else postings
    scored = search.best(search.scores(search.terms(open_, ["query"], F.col("text"), language), ["query"], general, "code"), ["query"], "code", 8)
    useful = scored.filter((F.col("coverage") >= 0.5) & ((F.col("in_a") > 0) | F.col("phrase")))
    by_text = useful.select("query", "code", F.round(0.2 + 0.35 * F.col("coverage"), 2).alias("confidence"), F.lit("text").alias("reason"))
    merged = found.unionByName(by_text).groupBy("query", "code").agg(F.max("confidence").alias("confidence"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    order = Window.partitionBy("query").orderBy(F.desc("confidence"), "code")
    ranked = merged.withColumns({"place": F.row_number().over(order), "second": F.lead("confidence").over(order)}).filter(F.col("place") <= limit)
    sure = (F.col("confidence") >= 0.8) & (F.col("second").isNull() | (F.col("second") <= F.col("confidence") - 0.25))
    state = F.first(F.when(sure, "decided").otherwise("conditional")).over(order)
    return ranked.select("query", "place", "code", "confidence", "reasons", state.alias("state"))
