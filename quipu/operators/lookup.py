"""Finding names that hold all words of a query and look like it: an inverted index of inner grams, then trigram similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quipu.functions import text as T
from quipu.operators.relational import top_per_key
from quipu.sources.shared import materialized

THRESHOLD, WORDS = 0.2, 6


def _cut(text: Column, size: int) -> Column:
    """All strings of `size` letters within the text."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substr(text, i, F.lit(size)))


def postings(names: DataFrame) -> DataFrame:
    """names: id, text -> (gram, id): pairs and triples of letters inside the normalised text, each once."""
    normal = T.normal(F.col("text"))
    return names.select(F.explode(F.array_distinct(F.concat(_cut(normal, 3), _cut(normal, 2)))).alias("gram"), "id")


def needed_grams(words: DataFrame) -> DataFrame:
    """words: text, words -> (text, gram): what a name with all these words must have, of a word of two letters its pair, of longer ones triples."""
    grams = F.flatten(F.transform("words", lambda w: F.when(F.length(w) >= 3, _cut(w, 3)).otherwise(_cut(w, 2))))
    return words.select("text", F.explode(F.array_distinct(grams)).alias("gram"))


def rarest(needed: DataFrame, index: DataFrame) -> DataFrame:
    """(text, gram): of the grams that a text needs the one that the fewest names have; a text with a gram that no name has is left out."""
    counts = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = needed.join(counts, "gram", "left").groupBy("text").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("all"))
    return ranked.filter("all").select("text", "gram")


def alike(texts: DataFrame, names: DataFrame, words: Column | None = None) -> DataFrame:
    """texts: text; names: name -> (text, name, similarity) where the normalised name contains every word of the text.

    By default the words are the first WORDS significant ones of two letters or more.  Each different text reads the postings of its rarest
    gram alone, and the different names found there are compared with it; no text meets all names.  Texts without words find nothing.
    """
    words = F.slice(F.filter(T.significant_words(F.col("text")), lambda w: F.length(w) >= 2), 1, WORDS) if words is None else words
    asked = texts.select("text").distinct().select("text", words.alias("words"), T.trigrams(F.col("text")).alias("of_text")).filter(F.size("words") > 0)
    different = materialized(names.filter("name IS NOT NULL").select("name").distinct(), "names")
    plain = different.select("name", T.normal(F.col("name")).alias("plain"), T.trigrams(F.col("name")).alias("of_name"))
    needed = needed_grams(asked)
    named = different.select(F.col("name").alias("id"), F.col("name").alias("text"))
    index = materialized(postings(named).join(needed.select("gram").distinct(), "gram", "left_semi"), "postings").withColumnRenamed("id", "name")
    met = rarest(needed, index).join(index, "gram").select("text", "name")
    both = met.join(asked, "text").join(plain, "name").filter(F.forall("words", lambda w: F.contains(F.col("plain"), w)))
    shared = F.size(F.array_intersect("of_text", "of_name"))
    return both.select("text", "name", (shared / (F.size("of_text") + F.size("of_name") - shared)).alias("similarity"))


def holding_all_words(texts: DataFrame, names: DataFrame, words: Column | None = None) -> DataFrame:
    """texts: text; names: id, text -> (text, id, similarity): alike(), for each row of a name."""
    named = names.select("id", F.col("text").alias("name"))
    return alike(texts, named, words).join(named, "name").select("text", "id", "similarity")


def reference_images(queries: DataFrame, products: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """queries: query_id, text, codes; products: id, text, ean, image, seen, active -> (query_id, id, by): the product whose image stands for a query.

    By the first of its codes that a product with an image has, the one seen last; else by name: all words, the most similar of those at
    the threshold or above, then the one seen last.  Ties go to the smaller id.  Queries that find nothing have no row.
    """
    shown = materialized(products.filter("active AND image IS NOT NULL").select("id", "text", "ean", "seen"), "shown")
    newest = shown.filter("ean IS NOT NULL").groupBy("ean").agg(F.min_by("id", F.struct(F.unix_micros(F.col("seen").cast("timestamp")) * -1, "id")).alias("id"))
    asked = queries.select("query_id", F.posexplode("codes").alias("place", "ean"))
    coded = asked.join(newest, "ean").groupBy("query_id").agg(F.min_by("id", "place").alias("id")).select("query_id", "id", F.lit("code").alias("by"))
    rest = queries.join(coded, "query_id", "left_anti").filter("text IS NOT NULL")
    latest = top_per_key(shown.select(F.col("text").alias("name"), "id", "seen"), ["name"], [F.desc("seen"), F.col("id")], 1)  # a name's only candidate
    near = alike(rest, latest).filter(F.col("similarity") >= threshold).join(latest, "name")
    order = Window.partitionBy("text").orderBy(F.col("similarity").desc(), F.col("seen").desc(), "id")
    best = near.withColumn("n", F.row_number().over(order)).filter("n = 1").select("text", "id")
    return coded.unionByName(rest.join(best, "text").select("query_id", "id", F.lit("name").alias("by")))


def index_search(texts: DataFrame, products: DataFrame, limit: int = 24) -> DataFrame:
    """texts: text; products: id, text, available -> (text, id, place): names with all words, those in stock first, then the most similar."""
    first = materialized(top_per_key(products.select(F.col("text").alias("name"), "id", "available"), ["name"], [F.desc("available"), F.col("id")], limit), "first")
    found = alike(texts, first).join(first, "name")
    order = Window.partitionBy("text").orderBy(F.col("available").desc(), F.col("similarity").desc(), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("text", "id", "place")
