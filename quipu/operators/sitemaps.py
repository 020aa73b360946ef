"""Sitemaps that list sitemaps: a frontier of documents, level by level, with a set of those seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.sources.shared import materialized

DEPTH = 2


def locations(xml: Column) -> Column:
    """What the document lists, entities of an address decoded."""
    found = F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    return F.transform(found, lambda u: F.regexp_replace(u, "&amp;", "&"))


def crawled(documents: DataFrame, roots: DataFrame, pattern: str, depth: int = DEPTH, every: bool = False) -> DataFrame:
    """documents: url, xml; roots: url -> (url, level): the different page addresses that fit the pattern, with the level they were first seen at.

    With `every`, an address has a row for each level at which a document lists it.

    A document with <sitemapindex> leads to others, down to indexes at `depth`; those below lead nowhere.  Each document is read once,
    whoever lists it, so repeats and cycles end.  An address without a document leads nowhere.  A level is one join, stored; there are at
    most depth + 2.
    """
    known = documents.select("url", F.col("xml").rlike(r"<sitemapindex\b").alias("index"), locations(F.col("xml")).alias("listed"))
    frontier, seen, pages = materialized(roots.select("url").distinct(), "frontier"), None, None
    for level in range(depth + 2):
        read = materialized(known.join(frontier, "url", "left_semi"), f"level{level}")
        found = read.filter("NOT index").select(F.explode("listed").alias("url")).filter(F.col("url").rlike(pattern)).withColumn("level", F.lit(level))
        pages = found if pages is None else pages.unionByName(found)
        seen = frontier if seen is None else seen.unionByName(frontier)
        if level <= depth:
            following = read.filter("index").select(F.explode("listed").alias("url")).distinct().join(seen, "url", "left_anti")
            frontier = materialized(following, f"frontier{level + 1}")
            if frontier.isEmpty():
                break
    return pages.distinct() if every else pages.groupBy("url").agg(F.min("level").alias("level"))
