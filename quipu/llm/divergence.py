"""Operator 13: source divergence audit by joint count histograms.

Per language, the terms in at least DOCUMENTS of its documents are kept.  Every (lang, source) group gives every kept term a smoothed share
p = 1 + floor(SCALE * (count + 1) / (N + V)); two groups differ by the sum over all kept terms of f = floor((p - q)^2 / q).  That sum is not
taken term by term: terms with the same counts in all sources are one row with a multiplicity; of those, each pair of sources tallies how
many terms have a count in both, by the two counts; cells with a zero on one side or on both follow from the margins (histogram of a
source's counts, V) less what was tallied; and f is evaluated once a combination, times its multiplicity.

Null text, lang and source count as ''.  A document is a row: rows that repeat count each.  A text without terms adds nothing, but its
group occurs: it has its pairs and no terms.  Without kept terms (V = 0) every pair has the value 0.  Ties are ranked by the UTF-8 bytes of
the item.  Empty tables give no rows.  Columns but text, lang and source are not looked at.  Whole numbers throughout; counts above 9e9 are
multiplied as decimals.  The result has a row for each pair of sources of a language, so sources of a language are assumed to be thousands
at most; a term's row holds one count per source.  Terms, documents and groups are never gathered.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quipu.llm.common import LOWER, UPPER, batched, read, small, stored

DOCUMENTS, SCALE, TERMS, SALTS, GROUPS = 3, 1_000_000_000, 200, 64, 200_000
#: Terms that a task holds before it sends their counts on.
HELD = 1 << 19
#: Bytes of terms, A-Z lower-cased; all others become blanks.  Every byte of a character beyond ASCII is one of a term.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of terms by group, summed over as many texts as HELD terms allow."""
    occurrences: dict[tuple[str, str], Counter] = defaultdict(Counter)
    documents: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in occurrences.items():
            n, terms = len(found), pa.array(list(found), pa.binary()).cast(pa.string())
            counts = [pa.array(list(found.values()), pa.int64()), pa.array(map(documents[lang, source].__getitem__, found), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), terms, *counts], ["lang", "source", "term", "n", "documents"])
        occurrences.clear()
        documents.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), strict=True):
            words = text.as_py().translate(TERM_BYTES).split()
            occurrences[lang, source].update(words)
            documents[lang, source].update(set(words))
        if sum(map(len, occurrences.values())) >= HELD:
            yield from rows()
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents): occurrences of each term in each group, and documents of the group that have it; by language and term."""
    counted = batched(docs.select("lang", "source", "text")).mapInArrow(_counted, "lang string, source string, term string, n long, documents long")
    return counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def share(n: str, total: str, scale: int) -> Column:
    """1 + floor(scale * (n + 1) / (total + v)) of columns; null where there are no kept terms."""
    return F.expr(f"1 + CAST({n} + 1 AS DECIMAL(20,0)) * {scale} DIV CAST(nullif({total} + v, 0) AS DECIMAL(20,0))")


def distance() -> Column:
    """floor((p - q)^2 / q); p and q are at most scale + 1, so the square is a long up to a scale of 3e9."""
    return F.expr("(p - q) * (p - q) DIV q")


def signed_cells(joint: DataFrame) -> DataFrame:
    """What each tallied combination adds to its own cell and takes from the zero cells of its margins."""
    row = lambda a, b, m: F.struct(a.alias("ca"), b.alias("cb"), m.alias("m"))
    zero, ca, cb, m = F.lit(0).cast("long"), F.col("ca"), F.col("cb"), F.col("m")
    cells = F.array(row(ca, cb, m), row(ca, zero, -m), row(zero, cb, -m), row(zero, zero, m))
    return joint.select("lang", "source", "item", F.explode(cells).alias("c")).select("lang", "source", "item", "c.*")


def divergence(docs: DataFrame, documents: int = DOCUMENTS, scale: int = SCALE, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has every other source of the language, part `term` the first `terms` terms
    that a group uses more than its language does."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = term_counts(docs).groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("by"))
    kept = stored(counts.filter(F.col("documents") >= documents).drop("documents"), "terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    profiles = stored(kept.groupBy("lang", "by").agg(F.count(F.lit(1)).alias("m")), "profiles")

    margins = profiles.select("lang", F.explode("by").alias("x"), "m").groupBy("lang", "x.source", "x.n").agg(F.sum("m").alias("m"))
    margins = stored(margins, "margins")
    sums = margins.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("group_n"), F.sum("m").alias("used"))
    zero = F.lit(0).cast("long")
    groups = docs.groupBy("lang", "source").count().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("group_n", "used", "v", "lang_n"))), "groups")
    other = groups.select("lang", F.col("source").alias("item"), F.col("group_n").alias("item_n"), F.col("used").alias("item_used"))

    first = profiles.select("lang", "m", F.posexplode("by").alias("i", "a"), "by").filter(F.col("i") < F.size("by") - 1)
    met = first.select("lang", "m", "a", F.explode(F.slice("by", F.col("i") + 2, F.size("by"))).alias("b"))
    joint = met.groupBy("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), F.col("a.n").alias("ca"), F.col("b.n").alias("cb")).agg(F.sum("m").alias("m"))
    joint = stored(joint, "joint")
    mirrored = joint.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("cb").alias("ca"), F.col("ca").alias("cb"), "m")

    pairs = groups.join(small(other, GROUPS), "lang").filter("source <> item")
    pairs = stored(pairs, "pairs")
    ids = pairs.select("lang", "source", "item")
    own = margins.select("lang", "source", F.col("n").alias("ca"), zero.alias("cb"), "m").join(small(ids, GROUPS), ["lang", "source"])
    theirs = margins.select("lang", F.col("source").alias("item"), zero.alias("ca"), F.col("n").alias("cb"), "m").join(small(ids, GROUPS), ["lang", "item"])
    nothing = pairs.select("lang", "source", "item", zero.alias("ca"), zero.alias("cb"), (F.col("v") - F.col("used") - F.col("item_used")).alias("m"))
    cells = signed_cells(joint.unionByName(mirrored)).unionByName(own).unionByName(theirs).unionByName(nothing)
    cells = cells.groupBy("lang", "source", "item", "ca", "cb").agg(F.sum("m").alias("m"))
    valued = cells.join(small(pairs, GROUPS), ["lang", "source", "item"]).withColumn("p", share("ca", "group_n", scale)).withColumn("q", share("cb", "item_n", scale))
    values = valued.groupBy("lang", "source", "item").agg(F.coalesce(F.sum((distance() * F.col("m")).cast("decimal(38,0)")).cast("long"), zero).alias("value"))
    by_value = [F.col("value").desc(), F.col("item")]
    pair = values.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value)).alias("rank"))

    used = kept.select("lang", F.col("term").alias("item"), "total", F.explode("by").alias("x")).select("lang", "item", "total", "x.source", "x.n")
    used = used.join(small(groups, GROUPS), ["lang", "source"]).withColumn("p", share("n", "group_n", scale)).withColumn("q", share("total", "lang_n", scale))
    used = used.filter("p > q").select("lang", "source", "item", distance().alias("value"), F.pmod(F.xxhash64("item"), F.lit(SALTS)).alias("salt"))
    salted = Window.partitionBy("lang", "source", "salt").orderBy(*by_value)
    used = used.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= terms).drop("rank", "salt")
    used = used.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_value))).filter(F.col("rank") <= terms)
    return pair.unionByName(used.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM tok GROUP BY lang, term HAVING count(DISTINCT rid) >= {DOCUMENTS}),
gn AS (SELECT lang, source, term, count(*) AS n FROM tok SEMI JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(group_n, 0) AS group_n FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS group_n FROM gn GROUP BY lang, source) USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + {SCALE}::HUGEINT * (coalesce(n, 0) + 1) // (group_n + v) AS p, 1 + {SCALE}::HUGEINT * (total + 1) // (lang_n + v) AS q
  FROM g JOIN kept k USING (lang) JOIN l USING (lang) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source AND gn.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
tv AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pr
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM tv) WHERE rank <= {TERMS}
"""
