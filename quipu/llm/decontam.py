"""Operator 3: benchmark decontamination with a distributed positional inverted index.  DataFrame functions only.

Steps: (1) count, over the whole corpus, the terms that the benchmark has; (2) choose the rarest terms of each benchmark window;
(3) store the corpus postings (document, position) of those terms alone, and each document's length; (4) shift each posting by the
term's offset in the benchmark text and keep the alignments on which all chosen terms of a window meet; (5) confirm exact phrases by
the digest of the document's words there; (6) proximity matches, from the same postings: the chosen terms of a window less than
WINDOW words apart, in any order.

Null and empty texts have no words and no hits.  Repeated rows each get a row.  A very long text has one posting for each rare term in it;
its words meet in one row only for step 5, with at most one place for each word and window length.  Of equally frequent terms the first
by code point counts as rarer.  An empty benchmark hits nothing; no documents give no rows.  Columns but doc_id and text, item_id and text
are not looked at.  Nothing is capped: where the benchmark or the list of documents to compare is too large to broadcast, the same
joins run as shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quipu.llm.common import LOWER, UPPER, document_key, lower_ascii, read, small, stored

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, RAREST = 13, 2
BROADCAST_TERMS, BROADCAST_DOCUMENTS = 200_000, 500_000
LENGTH = "\0"  # no word; its posting is at the end of each document


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), NOT_WORD), "")


def benchmark_texts(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text_id, words) of each different text with words, and (text_id, item_id)."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("text_id", F.sha2(F.array_join("words", " "), 256))
    return items.select("text_id", "words").dropDuplicates(["text_id"]), items.select("text_id", "item_id").distinct()


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often the corpus has each of the given terms (0 too)."""
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    found = tokens.join(small(terms, BROADCAST_TERMS), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index (term, doc_id, key_id, key_hash, pos) of the given terms; the term LENGTH is at each row's number of words."""
    tokens = F.concat(F.coalesce(words_of(F.col("text")), F.array().cast("array<string>")), F.array(F.lit(LENGTH)))
    exploded = docs.select("doc_id", *document_key(), F.posexplode(tokens).alias("pos", "term"))
    wanted = terms.select("term").union(docs.sparkSession.createDataFrame([(LENGTH,)], "term string"))
    return exploded.join(small(wanted, BROADCAST_TERMS), "term").select("term", "doc_id", "key_id", "key_hash", "pos")


def windows_of(texts: DataFrame, counts: DataFrame, length: int = WINDOW, k: int = RAREST) -> DataFrame:
    """(text_id, first, len, digest, need): each window, the digest of its words and the places in the text of its k rarest different terms.

    Windows with a term that the corpus does not have can't occur and are left out.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - length + 1, F.lit(1)))
    cut = texts.select("text_id", F.explode(starts).alias("s"), "words").select("text_id", (F.col("s") - 1).alias("first"), F.slice("words", F.col("s"), F.lit(length)).alias("w"))
    cut = cut.select("text_id", "first", F.size("w").alias("len"), words_digest(F.col("w")).alias("digest"), "w")
    window = ["text_id", "first", "len", "digest"]
    terms = cut.select(*window, F.posexplode("w").alias("offset", "term"))
    terms = terms.groupBy(*window, "term").agg(F.min(F.col("first") + F.col("offset")).alias("at"))
    ranked = terms.join(counts, "term").groupBy(window).agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "term", "at"))), 1, k).alias("r"))
    return ranked.filter("r[0].n > 0").select(*window, F.transform("r", lambda r: F.struct(r["term"].alias("term"), r["at"].alias("at"))).alias("need"))


def words_digest(words: Column) -> Column:
    return F.sha2(F.array_join(words, " "), 256)


def phrase_starts(index: DataFrame, windows: DataFrame) -> DataFrame:
    """Offset-adjusted intersection: (key_id, key_hash, text_id, start, len, digest) where all chosen terms of a window meet.

    An alignment meets only the windows whose rarest term is at a place that it has: at most `length` windows a place, whatever the item's length.
    """
    places = windows.select("text_id", F.explode("need").alias("p")).select("text_id", "p.term", "p.at").distinct()
    moved = index.join(small(places, BROADCAST_TERMS), "term").select("key_id", "key_hash", "text_id", (F.col("pos") - F.col("at")).alias("shift"), "at")
    met = moved.groupBy("key_id", "key_hash", "text_id", "shift").agg(F.collect_set("at").alias("seen"))
    needs = windows.select("text_id", "first", "len", "digest", F.transform("need", lambda p: p["at"]).alias("places")).withColumn("at", F.col("places")[0])
    rarest = met.select("key_id", "key_hash", "text_id", "shift", "seen", F.explode("seen").alias("at"))
    joined = rarest.join(small(needs, BROADCAST_TERMS), ["text_id", "at"]).filter((F.size(F.array_except("places", "seen")) == 0) & (F.col("shift") + F.col("first") >= 0))
    return joined.select("key_id", "key_hash", "text_id", (F.col("shift") + F.col("first")).alias("start"), "len", "digest")


def proximity_matches(index: DataFrame, groups: DataFrame, within: int = WINDOW) -> DataFrame:
    """(group_id, key_id, key_hash): documents in which the terms of a group stand less than `within` words apart, in any order.

    groups: (group_id, terms), one or two terms each.  Between two such postings no other of the group lies, so each is compared with
    its forerunner alone: one sorted pass over a document's postings of a group, no pairs.
    """
    terms = groups.select("group_id", F.size("terms").alias("need"), F.explode("terms").alias("term"))
    met = index.join(small(terms, BROADCAST_TERMS), "term").select("group_id", "need", "key_id", "key_hash", "pos", "term")
    before = Window.partitionBy("group_id", "key_id", "key_hash").orderBy("pos")
    pairs = met.filter("need > 1").select("group_id", "key_id", "key_hash", "pos", "term", F.lag("pos").over(before).alias("last"), F.lag("term").over(before).alias("other"))
    near = pairs.filter((F.col("other") != F.col("term")) & (F.col("pos") - F.col("last") < within))
    return near.select("group_id", "key_id", "key_hash").unionByName(met.filter("need = 1").select("group_id", "key_id", "key_hash")).distinct()


@dataclass
class Index:
    """lengths: doc_id, document key, n_words of each row; postings: term, document key, pos; windows and items of the benchmark."""

    lengths: DataFrame
    postings: DataFrame
    windows: DataFrame
    items: DataFrame


def indexed(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> Index:
    texts, items = benchmark_texts(benchmark)
    texts = stored(texts, "texts")
    counts = stored(term_counts(docs, texts.select(F.explode("words").alias("term")).distinct()), "term_counts")
    windows = stored(windows_of(texts, counts, length), "windows")
    index = stored(postings(docs, windows.select(F.explode("need.term").alias("term")).distinct()), "postings")
    is_length = F.col("term") == LENGTH
    lengths = index.filter(is_length).select("doc_id", "key_id", "key_hash", F.col("pos").cast("long").alias("n_words"))
    return Index(lengths, index.filter(~is_length).drop("doc_id").distinct(), windows, items)


def exact_hits(docs: DataFrame, index: Index) -> DataFrame:
    """(key_id, key_hash, text_id, start, len): exact occurrences of windows, stored."""
    starts = stored(phrase_starts(index.postings, index.windows), "starts")
    key = ["key_id", "key_hash"]
    spots = starts.select(*key, F.struct("start", "len").alias("s")).groupBy(key).agg(F.collect_set("s").alias("spots"))
    wanted = docs.select("text", *document_key()).join(small(starts.select(*key).distinct(), BROADCAST_DOCUMENTS), key, "left_semi").dropDuplicates(key)
    words = wanted.select(*key, words_of(F.col("text")).alias("words")).join(spots, key)
    found = F.transform("spots", lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"), words_digest(F.slice("words", s["start"] + 1, s["len"])).alias("digest")))
    read_there = words.select(*key, F.explode(found).alias("s")).select(*key, "s.*")
    return stored(starts.join(read_there, [*key, "start", "len", "digest"]).select(*key, "text_id", "start", "len"), "hits")


def words_hit(hits: DataFrame) -> DataFrame:
    """(key_id, key_hash, hit): words inside any occurrence, the union of the intervals, each taken from where those before it end."""
    key = ["key_id", "key_hash"]
    ends = hits.select(*key, "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    return ends.select(*key, new.alias("new")).groupBy(key).agg(F.sum("new").cast("long").alias("hit"))


def contaminated(n_words: Column, hit: Column) -> Column:
    return (hit > 0) & (20 * hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """Per document row: words, words hit, items with occurring windows and the digest of their ids, verdict; and n_near, the items of which
    the rarest two terms of some window stand less than `length` words apart (or, where a window has one term only, occur)."""
    index, key = indexed(docs.select("doc_id", "text"), benchmark, length), ["key_id", "key_hash"]
    hits = exact_hits(docs, index)
    named = hits.select(*key, "text_id").distinct().join(small(index.items, BROADCAST_TERMS), "text_id")
    ids = named.select(*key, F.col("item_id").cast("string").alias("item")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("item")).alias("ids"))
    terms = index.windows.select("text_id", F.array_sort(F.transform("need", lambda p: p["term"])).alias("terms"))
    terms = stored(terms.select(F.sha2(F.array_join("terms", " "), 256).alias("group_id"), "terms", "text_id").distinct(), "term_groups")
    near = proximity_matches(index.postings, terms.select("group_id", "terms").distinct(), length)
    near = near.join(small(terms.select("group_id", "text_id").join(index.items, "text_id").select("group_id", "item_id").distinct(), BROADCAST_TERMS), "group_id")
    near = near.select(*key, F.col("item_id").cast("string").alias("item")).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("near"))
    found = index.lengths.join(words_hit(hits).join(ids, key), key, "left").join(near, key, "left")
    ids, hit = F.coalesce("ids", F.array().cast("array<string>")), F.coalesce("hit", F.lit(0)).cast("long")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), hit).alias("contaminated"), F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW) -> DataFrame:
    """docs without the contaminated ones, columns unchanged."""
    index, key = indexed(docs, benchmark, length), ["key_id", "key_hash"]
    hit = words_hit(exact_hits(docs, index)).join(index.lengths, key)
    bad = stored(hit.filter(contaminated(F.col("n_words"), F.col("hit"))).select(*key).distinct(), "contaminated")
    whole = docs.select(F.struct(*docs.columns).alias("row"), *document_key())
    return whole.join(small(bad, BROADCAST_DOCUMENTS), key, "left_anti").select("row.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, s, s + least(len(w), {WINDOW}) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT rid, s, n, item_id FROM dw JOIN bw USING (n, g)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rid, s, n FROM hit)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY rid),
tok AS (SELECT rid, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
bt AS (SELECT DISTINCT unnest(w) AS t FROM b),
cnt AS (SELECT bt.t, count(tok.t) AS c FROM bt LEFT JOIN tok ON tok.t = bt.t GROUP BY bt.t),
wt AS (SELECT DISTINCT item_id, g, unnest(string_split(g, ' ')) AS t FROM bw),
rk AS (SELECT item_id, g, t, row_number() OVER (PARTITION BY item_id, g ORDER BY c, t) AS k, min(c) OVER (PARTITION BY item_id, g) AS least FROM wt JOIN cnt USING (t)),
pair AS (SELECT DISTINCT item_id, a, z FROM (SELECT item_id, min(t) AS a, max(t) AS z FROM rk WHERE k <= {RAREST} AND least > 0 GROUP BY item_id, g)),
near AS (SELECT rid, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_near FROM (
  SELECT DISTINCT x.rid, a, z FROM (SELECT DISTINCT a, z FROM pair) JOIN tok x ON x.t = a JOIN tok y ON y.rid = x.rid AND y.t = z AND abs(x.p - y.p) < {WINDOW}) JOIN pair USING (a, z) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid) LEFT JOIN near USING (rid)
"""
