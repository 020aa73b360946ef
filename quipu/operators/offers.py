"""Offers of one product across sellers: which descriptions can be one product, and cliques of offers in order of arrival.

Descriptions are compared, not offers: offers that say the same (code, brand, pack, models, words) are one description.  Every word of a
description is spelled out as the forms by which it can be met: itself, its stem without the gender, and its beginnings; two words agree
if one's word is among the other's beginnings or their stems are equal, so agreement is membership in arrays and differences are counts.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.functions import text as T
from quipu.sources.shared import materialized

#: Words of the packing, not of the product.
FILLERS = ("frasco", "paquete", "paq", "pote", "lata", "bolsa", "botella", "envase", "unidad", "und", "tipo", "presentacion")
#: Beginnings of words that tell products apart when only one name has them.
DISTINCTIVE = (
    "descrem", "semidescrem", "complet", "deslactos", "integral", "light", "diet", "zero", "sin", "libre", "gluten", "organic", "dulc", "salad", "picant", "amarill", "blanc", "negr", "rojo", "roja",
    "verde", "infantil", "nino", "adulto", "mayor", "bulto", "caja", "fardo",
)
#: Letters that gender changes; the shortest abbreviation; words of difference.
GENDER, SHORTEST, APART = "[aoe]$", 3, 1


def forms(words: Column) -> Column:
    """(word, stem, heads) of each word; heads are its beginnings of SHORTEST letters or more, none for a word that begins with a digit."""
    heads = lambda w: F.when(w.rlike("^[^0-9].{2,}"), F.transform(F.sequence(F.lit(SHORTEST), F.length(w)), lambda n: F.substr(w, F.lit(1), n))).otherwise(F.array().cast("array<string>"))
    return F.transform(words, lambda w: F.struct(w.alias("word"), F.regexp_replace(w, GENDER, "").alias("stem"), heads(w).alias("heads")))


def unmet(these: Column, those: Column) -> Column:
    """The forms of `these` that agree with none of `those`."""
    word, stem, heads = those["word"], those["stem"], F.flatten(those["heads"])
    return F.filter(these, lambda f: ~(F.array_contains(stem, f["stem"]) | F.array_contains(heads, f["word"]) | F.arrays_overlap(f["heads"], word)))


def _listed(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def descriptions(offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, offer_id, seller, description) of the offers, and (query_id, description and what that is) of the different ones.

    `description` is a hash of all that is compared.  Names are read once for each different one of a search, not for each offer.
    """
    said = [c for c in ("query_id", "ean", "name", "brand") if c in offers.columns]
    name = F.col("name")
    brand = F.nullif(T.normal(F.col("brand")), F.lit("")) if "brand" in said else F.lit(None).cast("string")
    d = F.struct("ean", brand.alias("brand"), T.pack_size(name).alias("pack"), F.array_sort(_listed(T.model_codes(name))).alias("models"), _listed(T.significant_words(name)).alias("words"))
    kinds = materialized(offers.select(said).distinct().select(*said, d.alias("d")).withColumn("description", F.xxhash64("d")), "descriptions")
    of = kinds.select(*[F.col(c).alias(f"_{c}") for c in said], "description")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in said])
    return offers.join(of, same).select("query_id", "offer_id", "seller", "description"), kinds.select("query_id", "description", "d.*")


def links(told: DataFrame) -> DataFrame:
    """(query_id, one, other, by_code): pairs of descriptions, in both directions and with themselves, that can be one product.

    Equal codes decide, as do different ones.  Else equal models agree unless the brands contradict.  Else both need one pack size, brands
    that agree (one alone must stand in the other's name), and at most APART words of difference, not a distinctive one.  Pairs meet by
    code, models, or pack and the first two letters of a word's stem: an equi-join within one search.
    """
    one = told.dropDuplicates(["query_id", "description"])
    brands = _listed(F.split("brand", " "))
    ready = one.select("query_id", "description", F.struct("ean", "pack", "models", "brand", forms(brands).alias("parts"), forms(F.array_compact(F.array("brand"))).alias("label"), forms("words").alias("words")).alias("d"))
    by_word = F.transform("d.words", lambda f: F.concat_ws("|", F.lit("word"), F.col("d.pack"), F.substring(f["stem"], 1, 2)))
    keys = F.concat(
        F.when(F.col("d.ean").isNotNull(), F.array(F.concat(F.lit("ean|"), F.col("d.ean")))).otherwise(F.array().cast("array<string>")),
        F.when(F.size("d.models") > 0, F.array(F.concat(F.lit("models|"), F.array_join("d.models", "|")))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("d.pack").isNotNull(), by_word).otherwise(F.array().cast("array<string>")),
    )
    met = ready.select("query_id", "description", F.explode(F.array_distinct(keys)).alias("key"))
    pairs = met.withColumnRenamed("description", "one").join(met.withColumnRenamed("description", "other"), ["query_id", "key"]).filter("one <= other").select("query_id", "one", "other").distinct()
    side = lambda name, d: ready.select("query_id", F.col("description").alias(name), F.col("d").alias(d))
    pairs = pairs.join(side("one", "a"), ["query_id", "one"]).join(side("other", "b"), ["query_id", "other"])

    contradict = (F.size("a.label") > 0) & (F.size("b.label") > 0) & (F.size(unmet(F.col("a.label"), F.col("b.label"))) > 0)
    named = lambda x, y: (F.size(f"{x}.label") == 0) | (F.size(f"{y}.label") > 0) | (F.size(unmet(F.col(f"{x}.parts"), F.col(f"{y}.words"))) == 0)
    own = lambda x: unmet(F.filter(f"{x}.words", lambda f: ~f["word"].isin(*FILLERS)), F.concat("a.parts", "b.parts"))
    pairs = pairs.withColumn("x", own("a")).withColumn("y", own("b"))
    pairs = pairs.withColumn("apart", F.transform(F.concat(unmet(F.col("x"), F.col("y")), unmet(F.col("y"), F.col("x"))), lambda f: f["word"]))
    few = (F.size("x") > 0) & (F.size("y") > 0) & (F.size("apart") <= APART) & ~F.exists("apart", lambda w: w.rlike(f"^({'|'.join(DISTINCTIVE)})"))
    by_words = F.coalesce(F.col("a.pack") == F.col("b.pack"), F.lit(False)) & ~contradict & named("a", "b") & named("b", "a") & few
    coded = F.col("a.ean").isNotNull() & F.col("b.ean").isNotNull()
    linked = F.when(coded, F.col("a.ean") == F.col("b.ean")).when((F.size("a.models") > 0) & (F.col("a.models") == F.col("b.models")), ~contradict).otherwise(by_words)
    found = pairs.filter(linked).select("query_id", "one", "other", coded.alias("by_code"))
    return found.unionByName(found.filter("one <> other").select("query_id", F.col("other").alias("one"), F.col("one").alias("other"), "by_code"))


def _cliques(offers: pd.DataFrame, linked: pd.DataFrame) -> pd.DataFrame:
    """Each offer, in order, joins the first clique of which every description is linked with its own; without a code, one offer a seller."""
    near: dict[int, dict[int, bool]] = defaultdict(dict)
    for one, other, by_code in zip(linked["one"], linked["other"], linked["by_code"], strict=True):
        near[one][other] = by_code
    sellers: list[dict[int, set]] = []  # of each clique, by description
    first, holding, out = [], defaultdict(list), []
    for seller, offer, told in offers.sort_values(["seller", "offer_id"])[["seller", "offer_id", "description"]].itertuples(index=False):
        reach = near[told]
        for i in sorted({i for d in reach for i in holding[d]}):
            if all(d in reach and (reach[d] or seller not in s) for d, s in sellers[i].items()):
                break
        else:
            i = len(sellers)
            sellers.append(defaultdict(set))
            first.append(offer)
        if told not in sellers[i]:
            holding[told].append(i)
        sellers[i][told].add(seller)
        out.append((offer, first[i]))
    return pd.DataFrame(out, columns=["offer_id", "cluster"])


def offer_clusters(offers: DataFrame) -> DataFrame:
    """offers: query_id, offer_id, seller, ean, name and perhaps brand -> offer_id, cluster (its first offer).

    The order (seller, offer_id) is part of the result, so the offers and links of one search meet in one task; they are bounded by the
    sellers asked.
    """
    told, kinds = descriptions(offers)
    return told.groupBy("query_id").cogroup(links(kinds).withColumnRenamed("query_id", "search").groupBy("search")).applyInPandas(_cliques, "offer_id long, cluster long")
