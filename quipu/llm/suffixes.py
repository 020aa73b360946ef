"""Operator 12: suffix-array dedup.  Bytes covered by a string of WIDTH bytes that also starts in a document of a smaller id are removed.

Not every suffix is sorted.  In each window of WIDTH bytes the GRAM-byte string of the least hash (the leftmost of equals) is its anchor, so
equal windows have the same anchor at the same place; an anchor serves a stretch of neighbouring windows.
(1) Sieve: each stretch sends the hashes of its anchor and of all its bytes to the bucket of the anchor, where they are sorted.  Equal
stretches of a later document are found whole; an anchor that stands in one kind of stretch only needs no more; of the others, the stretch in
its first document stays open.
(2) Suffixes: each window of an open stretch is a suffix with its leading bytes and a digest of all WIDTH.  Splitters from a sample of open
stretches deal the suffixes out by leading bytes; each bucket is sorted by multikey quicksort and neighbours are compared.  A splitter is a
whole key, so equal suffixes never lie on both sides of a border.
(3) What was found is gathered by document and cut out of its text.

A batch of texts is sorted before it is sent: of equal stretches or suffixes only those of the first document go to the bucket, and stretches
of an anchor that has many kinds are dealt out one by one, so a passage in a third of all documents is a few rows for each batch.
Nothing is capped.  Keys are hashes of 128 bits together (a suffix: 8 bytes as they are and 64 bits), taken as equal strings.

A null text is empty; texts shorter than WIDTH keep all bytes.  A null id is neither before nor after any: its text is kept whole and removes
nothing.  Rows that repeat an id and text have equal results; texts of one id do not remove from each other.  A very long text takes
about 60 times its bytes in one task.  Empty tables give no rows.  Columns but doc_id (whole numbers) and text are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quipu.llm.common import batched, read, runs, share, small, stored, utf8

WIDTH, GRAM = 50, 24
#: Text bytes for each bucket, kinds of stretches that make an anchor of a batch a frequent one, sampled stretches for the splitters.
BUCKET_BYTES, KINDS, SAMPLE = 16 << 20, 8, 4000
#: Of a stretch: its bucket gets it; found already; of a frequent anchor; tells the bucket of an anchor that it is frequent.
OPEN, FOUND, FREQUENT, NOTICE = range(4)
U = np.uint64
BASE = U(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


BYTES = _mix(np.arange(1, 257, dtype=U))


def _power(n: int) -> np.uint64:
    return U(pow(int(BASE), n, 1 << 64))


def block_hashes(data: np.ndarray, most: int = 16) -> dict[int, np.ndarray]:
    """Polynomial hashes of the strings of 1, 2, 4, ... bytes that start at each place."""
    out, n = {1: BYTES[data]}, 1
    while 2 * n <= most and len(out[n]) > n:
        out[2 * n] = out[n][:-n] * _power(n) + out[n][n:]
        n *= 2
    return out


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost least of the next `width` values, for each place that has so many."""
    at, n = np.arange(len(values)), 1
    least = values
    while n < width:
        step = min(n, width - n)
        first = least[:-step] <= least[step:]
        at = np.where(first, at[:-step], at[step:])
        least = np.where(first, least[:-step], least[step:])
        n += step
    return at


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, windows, hash of the anchor, hash of all bytes) of each stretch of windows with one anchor; no window crosses texts."""
    none = np.zeros(0, np.int64)
    if len(data) < WIDTH:
        return none, none, none, none.view(U), none.view(U)
    block = block_hashes(data)
    gram = _mix(block[16][: len(data) - GRAM + 1] * _power(8) + block[8][16:])
    anchor = least_of(gram, WIDTH - GRAM + 1)
    text = np.searchsorted(ends, np.arange(len(anchor)), "right")
    inside = np.flatnonzero(np.arange(len(anchor)) + WIDTH <= ends[text])
    new = np.ones(len(inside), bool)
    new[1:] = (anchor[inside[1:]] != anchor[inside[:-1]]) | (text[inside[1:]] != text[inside[:-1]])
    first = np.flatnonzero(new)
    start, windows = inside[first], np.diff(np.append(first, len(inside)))
    length = windows + WIDTH - 1
    whole = _mix(length.astype(U))
    for at in (start, start + 16, start + 32, start + length - 32, start + length - 16):
        whole = _mix(whole * BASE + block[16][at])
    return text[start], start, windows, gram[anchor[start]], whole


def packed(start: np.ndarray, tag: np.ndarray, windows: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Place in the text, 24 bits of its hash (texts of one id are told apart by it), windows and kind in one number."""
    return ((start << 24 | tag) << 7) | (windows << 2) | kind


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return at >> 31, (at >> 7) & 0xFFFFFF, (at >> 2) & 31, at & 3


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """Order of the rows by the first word, then, only within runs that are still equal, by the next one."""
    order = np.argsort(words[0], kind="stable")
    new = _changes([words[0][order]])
    for word in words[1:]:
        run = np.cumsum(new) - 1
        still = np.flatnonzero(np.bincount(run)[run] > 1) if len(run) else run
        if not len(still):
            break
        rows = order[still]
        order[still] = rows[np.lexsort((word[rows], run[still]))]
        new |= _changes([word[order]])
    return order


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _first_of_run(new: np.ndarray) -> np.ndarray:
    """The place where each row's run begins."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)


def _batch(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(hashes) % U(parts)).astype(np.int32)


SENT = ["part", "key", "whole", "doc", "at"]


def sender(parts: int) -> Callable:
    """Stretches of a batch of (doc, tag, text), sorted, each with its bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            found: list[tuple[np.ndarray, ...]] = []
            for at, n in runs(batch.column(2)):
                data, ends = utf8(batch.column(2).slice(at, n))
                text, start, windows, key, whole = stretches(data, ends)
                begins = np.append(0, ends[:-1])
                found.append((key, whole, doc[at + text], packed(start - begins[text], tag[at + text], windows, np.zeros(len(text), np.int64))))
            if not found:
                continue
            key, whole, of, at = (np.concatenate(c) for c in zip(*found, strict=True))
            order = multikey_order([key, whole, of])
            key, whole, of, at = key[order], whole[order], of[order], at[order]
            kind_of_key, same = _changes([key]), _changes([key, whole])
            late = of > of[_first_of_run(same)]
            run = np.cumsum(kind_of_key) - 1
            frequent = (np.bincount(run, same)[run] >= KINDS) if len(run) else late
            kind = np.where(late, FOUND, np.where(frequent, FREQUENT, OPEN))
            spread = np.where(late, _mix(of.astype(U)) ^ at.astype(U), np.where(frequent, key ^ _mix(whole), key))
            nothing = U(0)
            columns = [_part(spread, parts), np.where(late, nothing, key).view(np.int64), np.where(late, nothing, whole).view(np.int64), of, at | kind]
            told = frequent & kind_of_key
            notices = [_part(key[told], parts), key[told].view(np.int64), np.zeros(told.sum(), np.int64), of[told], np.full(told.sum(), NOTICE)]
            yield _batch(SENT, [np.concatenate([a, b]) for a, b in zip(columns, notices, strict=True)])

    return send


def _gathered(batches: Iterator[pa.RecordBatch], columns: list[str]) -> list[np.ndarray]:
    """One bucket; buckets are dealt out by a number of parts that follows the bytes of the corpus."""
    held = list(batches)
    return [np.concatenate([b.column(c).to_numpy() for b in held]) if held else np.zeros(0, np.int64) for c in columns]


def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the stretches of a bucket: those of later documents (FOUND), and the first ones of anchors in several kinds of stretches (OPEN)."""
    key, whole, doc, at = _gathered(batches, SENT[1:])
    order = multikey_order([key, whole, doc])
    key, whole, doc, at = key[order], whole[order], doc[order], at[order]
    kind, of_key, same = at & 3, _changes([key]), _changes([key, whole])
    late = doc > doc[_first_of_run(same)]
    run = np.cumsum(of_key) - 1
    several = (np.bincount(run, same)[run] > 1) if len(run) else late
    stays = (kind != FOUND) & (kind != NOTICE)
    found, still = (kind == FOUND) | (stays & late), stays & ~late & (several | (kind == FREQUENT))
    given = found | still
    yield _batch(["doc", "at", "open"], [doc[given], at[given] & ~3, still[given]])


def suffixes(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading eight bytes (in their order) and a digest of all WIDTH bytes of the suffixes that start at the given places."""
    lead = np.zeros(len(start), U)
    for i in range(8):
        lead = (lead << U(8)) | data[start + i]
    block, digest = block_hashes(data)[16], np.zeros(len(start), U)
    for at in (0, 16, 32, WIDTH - 16):
        digest = _mix(digest * BASE + block[start + at])
    return (lead ^ U(1 << 63)).view(np.int64), digest.view(np.int64)


def _opened(batch: pa.RecordBatch, at: int, n: int) -> tuple[np.ndarray, ...]:
    """Suffixes of the open stretches of rows (doc, tag, text, ats) of a batch: (lead, digest, doc, packed place)."""
    data, ends = utf8(batch.column(2).slice(at, n))
    begins = np.append(0, ends[:-1])
    ats = batch.column(3).slice(at, n)
    row = np.repeat(np.arange(n), ats.value_lengths().to_numpy(zero_copy_only=False))
    doc, tag = (batch.column(i).slice(at, n).to_numpy(zero_copy_only=False) for i in (0, 1))
    start, of_tag, windows, _ = unpacked(ats.flatten().to_numpy(zero_copy_only=False))
    mine = of_tag == tag[row]
    row, start, windows = row[mine], start[mine], windows[mine]
    each = np.repeat(np.arange(len(row)), windows)
    place = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(windows) - windows, windows)
    lead, digest = suffixes(data, begins[row[each]] + place) if len(each) else (each, each)
    return lead, digest, doc[row[each]], packed(place, tag[row[each]], np.ones(len(each), np.int64), np.zeros(len(each), np.int64))


def bucket_of(lead: np.ndarray, digest: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """How many splitters (pairs, sorted) are at most each suffix's key."""
    out = np.searchsorted(splitters[:, 0], lead, "left")
    upto = np.searchsorted(splitters[:, 0], lead, "right")
    tied = np.flatnonzero(upto > out)
    for first in np.unique(out[tied]):
        rows = tied[out[tied] == first]
        out[rows] += np.searchsorted(splitters[first : upto[rows[0]], 1], digest[rows], "right")
    return out


def opener(splitters: np.ndarray) -> Callable:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in runs(batch.column(2)):
                lead, digest, doc, place = _opened(batch, at, n)
                order = multikey_order([lead, digest, doc])
                lead, digest, doc, place = lead[order], digest[order], doc[order], place[order]
                late = doc > doc[_first_of_run(_changes([lead, digest]))]
                part = np.where(late, _part(_mix(doc.astype(U)) ^ place.astype(U), len(splitters) + 1), bucket_of(lead, digest, splitters)).astype(np.int32)
                yield _batch(SENT, [part, np.where(late, 0, lead), np.where(late, 0, digest), doc, place | np.where(late, FOUND, OPEN)])

    return deal


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes of a bucket that are equal to one of an earlier document."""
    lead, digest, doc, at = _gathered(batches, SENT[1:])
    late = (at & 3) == FOUND
    given = [[doc[late], at[late] & ~3]]
    lead, digest, doc, at = lead[~late], digest[~late], doc[~late], at[~late]
    order = multikey_order([lead, digest, doc])
    lead, digest, doc, at = lead[order], digest[order], doc[order], at[order]
    late = doc > doc[_first_of_run(_changes([lead, digest]))]
    given.append([doc[late], at[late]])
    yield _batch(["doc", "at"], [np.concatenate(c) for c in zip(*given, strict=True)])


def _joined(texts: DataFrame, ats: DataFrame, how: str = "inner") -> DataFrame:
    """Texts with the list of places found for their id; the places are the side that is held in memory."""
    by_doc = ats.groupBy("doc").agg(F.collect_list("at").alias("ats"))
    return texts.join(by_doc.hint("shuffle_hash"), "doc", how).select("doc", "tag", "text", "ats")


def covered_places(docs: DataFrame) -> DataFrame:
    """(doc, at): packed stretches of windows of which every byte is to go, stored; doc_id is whole numbers."""
    spark = docs.sparkSession
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").bitwiseAND(0xFFFFFF).alias("tag"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES))
    sent = batched(texts).mapInArrow(sender(parts), "part int, key long, whole long, doc long, at long")
    sieved = stored(sent.repartitionById(parts, F.col("part")).mapInArrow(sift, "doc long, at long, open boolean"), "sieved", tidy=True)
    still, found = sieved.filter("open").select("doc", "at"), sieved.filter("NOT open").select("doc", "at")
    n = still.count()
    if not n:
        return found
    some = small(still.filter(share(F.xxhash64("doc", "at"), SAMPLE / n)), 4 * SAMPLE).groupBy("doc").agg(F.collect_list("at").alias("ats"))
    sample = batched(texts.join(small(some, 4 * SAMPLE), "doc").select("doc", "tag", "text", "ats")).mapInArrow(opener(np.zeros((0, 2), np.int64)), "part int, key long, whole long, doc long, at long")
    keys = np.array(sorted((r.key, r.whole) for r in sample.select("key", "whole").collect()), np.int64).reshape(-1, 2)  # of at most about 2 SAMPLE stretches
    splitters = np.unique(keys[np.linspace(0, len(keys), parts + 1)[1:-1].astype(int)], axis=0) if len(keys) else keys
    dealt = batched(_joined(texts, still)).mapInArrow(opener(splitters), "part int, key long, whole long, doc long, at long")
    equal = stored(dealt.repartitionById(parts, F.col("part")).mapInArrow(compare, "doc long, at long"), "suffixes", tidy=True)
    return found.unionByName(equal)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        for first, n in runs(batch.column(2)):
            data, ends = utf8(batch.column(2).slice(first, n))
            spans, kept, sizes = [], [], []
            for i, ats in enumerate(batch.column(3).slice(first, n)):
                text = data[ends[i - 1] if i else 0 : ends[i]]
                sizes.append(len(text))
                if not ats.is_valid:
                    spans.append([])
                    kept.append(text.tobytes())
                    continue
                start, of_tag, windows, _ = unpacked(ats.values.to_numpy(zero_copy_only=False))
                mine = of_tag == batch.column(1)[first + i].as_py()
                depth = np.zeros(len(text) + 1, np.int64)
                np.add.at(depth, start[mine], 1)
                np.add.at(depth, (start + windows + WIDTH - 1)[mine], -1)
                gone = np.cumsum(depth)[:-1] > 0
                edges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2)
                spans.append([{"start": int(a), "stop": int(b)} for a, b in edges])
                kept.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each row: the removed runs of bytes as (start, stop), and the remaining bytes."""
    places = covered_places(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").bitwiseAND(0xFFFFFF).alias("tag"), "text")
    cut = batched(_joined(texts, places, "left")).mapInArrow(_cut, "doc long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
    return cut.select(F.col("doc").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_bytes", "spans", "kept")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
x AS (SELECT rid, doc_id, hex(b) AS h, octet_length(b) AS n FROM d),
part AS (SELECT rid, doc_id, n, o, substr(h, 2 * o + 1, {2 * (256 + WIDTH)}) AS p FROM (SELECT *, unnest(range(0, n - {WIDTH - 1}, 256)) AS o FROM x WHERE n >= {WIDTH})),
w AS (SELECT rid, doc_id, o + i AS s, md5(substr(p, 2 * i + 1, {2 * WIDTH})) AS k FROM (SELECT *, unnest(range(0, least(256, n - {WIDTH - 1} - o))) AS i FROM part)),
first AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
hit AS (SELECT rid, s FROM w JOIN first USING (k) WHERE least < doc_id),
run AS (SELECT rid, s, sum(new) OVER (PARTITION BY rid ORDER BY s) AS r
  FROM (SELECT rid, s, CASE WHEN s <= lag(s) OVER (PARTITION BY rid ORDER BY s) + {WIDTH} THEN 0 ELSE 1 END AS new FROM hit)),
span AS (SELECT rid, r, min(s) AS a, max(s) + {WIDTH} AS z FROM run GROUP BY rid, r),
cut AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS after FROM span),
kept AS (SELECT rid, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) AS head, max(z) AS tail FROM cut JOIN x USING (rid) GROUP BY rid)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM x LEFT JOIN kept USING (rid)
"""
