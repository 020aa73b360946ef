"""Operator 11: target-distribution importance resampling with a vectorised byte automaton.

Words come straight from the UTF-8 bytes of Arrow's text buffers: a table of 256 entries classifies and lower-cases every byte (all bytes of
a character beyond ASCII are word bytes, so bytes decide as characters do), differences of neighbours give word borders, and the CRC states
of all words advance together, a byte a step, through the CRC table; a pair of words goes on from the state of its first word.  One pass
counts hashed features of corpus and target, a second one weighs documents by the gain of each bucket; gains are BUCKETS numbers, whatever
the size of the corpus.  The draw is a total order: range-partitioned by score, sorted, and counted by partition.

Null and empty texts have no features and weight 0.  A null id is hashed like an empty one and comes after all ids.  Rows that repeat each
count and each have a row; equal scores go by id, then by number of features.  A very long text is read at once: about 20 times its bytes
in memory; words beyond STEPS bytes are finished one by one.  Without documents there are no rows; without target texts the gains are those
of an even target.  Columns but doc_id and text (of the target: text) are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quipu.llm.common import LOWER, UPPER, batched, read, runs, small, stored, utf8

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, 7
STEPS, FULL = 64, np.uint32(0xFFFFFFFF)
#: The reflected polynomial of CRC-32 (fixed by the format).
POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), out >> np.uint32(1))
    return out


def _byte_classes() -> np.ndarray:
    """The lower-cased byte for bytes of words, 0 for all others."""
    out = np.zeros(256, np.uint8)
    for kept in (range(0x30, 0x3A), range(0x61, 0x7B), range(0x80, 0x100)):
        out[list(kept)] = list(kept)
    out[0x41:0x5B] = out[0x61:0x7B]
    return out


CRC, CLASSES = _crc_table(), _byte_classes()


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, stops, text of each word); `ends` are the ends of the texts in the bytes; no word crosses one."""
    low = CLASSES[data]
    inside = low != 0
    before, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    before[1:], after[:-1] = inside, np.append(inside[1:], False) if len(data) else inside
    before[ends[ends < len(data)]] = False
    after[ends[ends > 0] - 1] = False
    starts, stops = np.flatnonzero(inside & ~before[:-1]), np.flatnonzero(inside & ~after[:-1]) + 1
    return low, starts, stops, np.searchsorted(ends, starts, "right")


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """CRC states after the bytes of each span, all spans a byte a step; the longest spans are first, so those still open are a prefix."""
    length = stops - starts
    order = np.argsort(-length, kind="stable")
    now, at, length = state[order], starts[order], length[order]
    for k in range(min(int(length[0]), STEPS) if len(length) else 0):
        n = int(np.searchsorted(-length, -k, "left"))
        now[:n] = CRC[(now[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (now[:n] >> np.uint32(8))
    for i in range(int(np.searchsorted(-length, -STEPS, "left"))):
        now[i] = np.uint32(zlib.crc32(data[at[i] + STEPS : at[i] + length[i]].tobytes(), int(now[i] ^ FULL))) ^ FULL
    out = np.empty_like(now)
    out[order] = now
    return out


def feature_buckets(data: np.ndarray, ends: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all words and of all pairs of neighbours, the text of each feature, words of each text)."""
    low, starts, stops, text = word_spans(data, ends)
    one = advance(np.full(len(starts), FULL), low, starts, stops)
    pair = np.flatnonzero(text[1:] == text[:-1])
    spaced = CRC[(one[pair] ^ np.uint32(0x20)) & np.uint32(255)] ^ (one[pair] >> np.uint32(8))
    two = advance(spaced, low, starts[pair + 1], stops[pair + 1])
    found = ((np.concatenate([one, two]) ^ FULL) % np.uint32(buckets)).astype(np.int64)
    return found, np.concatenate([text, text[pair]]), np.bincount(text, minlength=len(ends))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often the texts have each bucket: every task sends its sums, at most `buckets` rows, which Spark adds up."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, n in runs(batch.column(0)):
                total += np.bincount(feature_buckets(*utf8(batch.column(0).slice(at, n)), buckets)[0], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    counted = batched(texts.select("text")).mapInArrow(tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():  # at most `buckets` rows
        out[row.bucket] = row.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) of each bucket, both smoothed by one."""
    ratio = (target + 1.0) * (source.sum() + float(len(source))) / ((source + 1.0) * (target.sum() + float(len(target))))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row: the floored mean gain of its features."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in runs(batch.column(1)):
                found, text, words = feature_buckets(*utf8(batch.column(1).slice(at, n)), len(gains))
                features = np.bincount(text, minlength=n)
                sums = np.rint(np.bincount(text, weights=gains[found], minlength=n)).astype(np.int64)
                columns = [words, features, sums // np.maximum(features, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *(pa.array(c.astype(np.int64)) for c in columns)], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return batched(docs.select("doc_id", "text")).mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, percent: int = PERCENT) -> DataFrame:
    """scored with `rank`, from 1 by falling score, then id; null beyond the given part of the rows."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    placed = stored(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    parts = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")
    parts = parts.select("part", before.alias("before"), F.floor(F.sum("rows").over(Window.partitionBy()) * percent / F.lit(100)).alias("drawn"))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    found = placed.withColumn("part", F.shiftright("at", 33)).join(small(parts, 100_000), "part")
    return found.select(*scored.columns, F.when(rank <= F.col("drawn"), rank).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row; rank is null for rows that are not drawn."""
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = stored(weighted(docs, gains).withColumn("score", F.col("weight") + noise), "scored")
    columns = ["doc_id", "n_features", "weight", "score"]
    few = scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked(scored.filter(F.col("n_words") >= least_words).select(*columns), percent).unionByName(few)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""
WITH RECURSIVE steps AS (SELECT i AS i, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS rid, {_WORDS} AS w FROM benchmark),
df AS (SELECT rid, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS (SELECT rid, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
hexed AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)), lambda s, y: xor(s >> 8, t[(xor(s, y) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM hexed, crc),
s AS (SELECT bucket, count(*) AS s FROM df JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN hashed USING (f) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + {BUCKETS})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + {BUCKETS})::DOUBLE))) AS BIGINT) AS g
  FROM s FULL JOIN t USING (bucket)),
wt AS (SELECT rid, count(*) AS n_features, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM df JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY rid),
sc AS (SELECT doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN wt USING (rid)),
rk AS (SELECT *, row_number() OVER (PARTITION BY n >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features) AS r, count(*) OVER (PARTITION BY n >= {LEAST_WORDS}) AS all_ FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= {LEAST_WORDS} AND r <= {PERCENT} * all_ // 100 THEN r END AS rank FROM rk
"""
