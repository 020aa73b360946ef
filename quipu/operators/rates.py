"""Tax rates by the day: components in force, totals of categories, and all that belongs to an option of a classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.functions import numbers as N


def in_force(day: Column, since: Column, until: Column) -> Column:
    """A period has its first and its last day; an open end holds on."""
    return (since <= day) & (until.isNull() | (until >= day))


def component_totals(days: DataFrame, categories: DataFrame, components: DataFrame) -> DataFrame:
    """days: day; categories: category, components (codes); components: component, percent, since, until, instrument ->
    (day, category, parts, percent, missing): parts has each code with its percent and instrument, in the category's order.

    `percent` sums what is in force that day, 0 for a category without components; `missing` lists codes of which none is in force.  Of
    several periods in force the one that began last counts.  Days and periods meet once a component, not once an option.
    """
    wanted = days.select("day").distinct().join(categories.select(F.posexplode("components").alias("place", "component"), "category"), how="cross")
    d, c = wanted.alias("d"), components.alias("c")
    met = d.join(c, (F.col("d.component") == F.col("c.component")) & in_force(F.col("d.day"), F.col("c.since"), F.col("c.until")), "left")
    best = met.groupBy("d.day", "d.category", "d.place", "d.component").agg(F.max_by(F.struct("c.percent", "c.instrument"), "c.since").alias("p"))
    part = F.struct("place", "component", F.col("p.percent").alias("percent"), F.col("p.instrument").alias("instrument"))
    found = best.groupBy("day", "category").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    every = days.select("day").distinct().join(categories.select("category"), how="cross").join(found, ["day", "category"], "left")
    parts = F.coalesce("parts", F.array().cast(found.schema["parts"].dataType))
    total = F.aggregate(parts, F.lit(0).cast("decimal(9,2)"), lambda s, x: (s + F.coalesce(x["percent"], F.lit(0).cast("decimal(5,2)"))).cast("decimal(9,2)"))
    missing = F.transform(F.filter(parts, lambda x: x["percent"].isNull()), lambda x: x["component"])
    return every.select("day", "category", parts.alias("parts"), total.alias("percent"), missing.alias("missing"))


def option_details(options: DataFrame, categories: DataFrame, components: DataFrame, laws: DataFrame) -> DataFrame:
    """options: item, day, category, legal_base (law ids), amount, and others -> them with parts, percent, missing, texts and base, tax, total.

    Rates are joined by day and category, laws by each element of the legal base; `texts` keeps the base's order, and a law that is not
    known has its id alone.  An unknown category has null rates and amounts.
    """
    days = options.select("day").filter("day IS NOT NULL").distinct()
    rated = options.join(component_totals(days, categories, components), ["day", "category"], "left")
    bases = options.select("legal_base").distinct()
    each = bases.select("legal_base", F.posexplode("legal_base").alias("place", "law")).join(laws, "law", "left")
    texts = each.groupBy("legal_base").agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(": ", "law", "text").alias("text")))).alias("t"))
    out = rated.join(texts.select("legal_base", F.transform("t", lambda x: x["text"]).alias("texts")), "legal_base", "left")
    base, tax, total = N.invoice(F.col("amount"), F.col("percent"))
    return out.select(*options.columns, "parts", "percent", "missing", F.coalesce("texts", F.array().cast("array<string>")).alias("texts"), base, tax, total)
