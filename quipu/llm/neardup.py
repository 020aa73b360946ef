"""Operator 8: near duplicates by one-permutation MinHash with optimal densification, banded buckets and star-shaped candidates.

Words are runs between ASCII white space, A-Z lowered; a document's set is its distinct shingles of k words (fewer words: the whole
sequence), as 64-bit hashes.  Texts with one set collapse first: a node is a set, named by its digest, whatever ids its rows have.  Then
  1. every bucket (band, value) names a centre, the member that shares most buckets with others, and links all members to it: a
     star, so pairs grow with the members;
  2. candidates are confirmed on full sets, and confirmed links give components;
  3. while that joins many documents, buckets whose members are still in different components draw another centre each, and members of
     other components than the centre's are confirmed against it: stars again, over ever fewer members;
  4. nodes whose buckets hold several components even then are searched exactly: shingles are ordered from the rarest among them, and
     two sets that reach the threshold must share a shingle of their first n - ceil(t n) + 1.  Shingles that one set alone has never
     meet another, so texts of one template with a fill of their own make no pairs.
With 32 bands of 4, a pair at 0.8 shares no bucket with probability 5e-8.

Null and empty texts have an empty set and are linked with nothing.  Rows are kept whole: repeated rows each get a row.  Rows that repeat
an id with other text are nodes of their own; a null id takes part like any other, but names a component only if it has no other id, as
null.  A very long text is one set, whose shingles are sorted in one task.  Ties of centres go to the larger digest, of representatives to
the smaller digest.  Empty tables give no rows.  Columns but doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quipu.llm.common import batched, document_key, read, runs, small
from quipu.llm.common import stored as stored_table
from quipu.llm.graph import components

BANDS, ROWS, SKETCH = 32, 4, 1024
BINS = BANDS * ROWS
BROADCAST_IDS, HOT = 500_000, 2000
stored = functools.partial(stored_table, tidy=True)  # no shuffle is read after its writing
LEAST_GAIN = 0.9  # stars go on while a round leaves at most this share of the open components
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """UTF-8 runs without space, tab and the control characters 0x0A to 0x0D; bytes.lower() touches A-Z alone."""
    return text.encode().lower().split() if text else []


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    lists = [words(t) for t in texts]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    codes, found = pd.factorize(np.array([w for x in lists for w in x], dtype=object))
    hashes = pd.util.hash_array(np.asarray(found, dtype=object), categorize=False)[codes] if len(codes) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        flat = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
        for j in range(k):
            flat = flat * _M1 + hashes[j : j + len(flat)]
        flat = mixed(flat)
        out, at = [], 0
        for n in sizes:
            if n >= k:
                out.append(np.unique(flat[at : at + n - k + 1]))
            elif n:
                value = np.uint64(n)
                for h in hashes[at : at + n]:
                    value = value * _M2 + h
                out.append(mixed(np.array([value], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def one_permutation(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Smallest hash of each bin; an empty bin copies from bins drawn by (bin, attempt) until one is filled."""
    where = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(where.astype(np.int64), prepend=-1))
    out, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    slots = where[first].astype(np.int64)
    out[slots], filled[slots] = hashes[first], True
    if len(slots) == 1:
        return np.full(bins, out[slots[0]])
    empty, attempt = np.flatnonzero(~filled), 0
    while len(empty):
        attempt += 1
        with np.errstate(over="ignore"):
            drawn = (mixed(empty.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        hit = filled[drawn]
        out[empty[hit]] = out[drawn[hit]]
        empty = empty[~hit]
    return out


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the elements in each of 1024 cells, as 16 longs: the Hamming distance of two tells their symmetric difference."""
    with np.errstate(over="ignore"):
        cells = (mixed(hashes * _M2 + np.uint64(1)) >> np.uint64(54)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)


def _per_batch(make: Callable[[pa.RecordBatch, list[np.ndarray]], pa.RecordBatch], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Shingle sets of the last column for small runs of rows, so that long texts don't add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, length in runs(batch.column(batch.num_columns - 1)):
                part = batch.slice(at, length)
                yield make(part, shingle_sets(part.column(part.num_columns - 1).to_pylist(), k))

    return run


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, key of the text, n (set size), node (digest of the set), its band values and odd sketch (null for empty sets)."""

    def make(part: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        bands, sketches, digests = [], [], []
        for s in sets:
            if not len(s):
                bands.append(None), sketches.append(None), digests.append(None)
                continue
            with np.errstate(over="ignore"):
                grid, value = one_permutation(s).reshape(BANDS, ROWS), np.zeros(BANDS, np.uint64)
                for j in range(ROWS):
                    value = mixed(value * _M1 + grid[:, j] + np.uint64(j))
            bands.append(value.view(np.int64)), sketches.append(odd_sketch(s)), digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
        longs = pa.list_(pa.int64())
        sizes = pa.array([len(s) for s in sets], pa.int64())
        columns = [*part.columns[:3], sizes, pa.array(digests, pa.binary()), pa.array(bands, longs), pa.array(sketches, longs)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "key_id", "key_hash", "n", "node", "bands", "sketch"])

    schema = "doc_id long, key_id long, key_hash long, n long, node binary, bands array<long>, sketch array<long>"
    return batched(docs).select(F.col("doc_id").cast("long").alias("doc_id"), *document_key(), "text").mapInArrow(_per_batch(make, k), schema)


def full_sets(texts: DataFrame, k: int) -> DataFrame:
    """(node, text) -> (node, items)."""

    def make(part: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "items"])

    return batched(texts).select("node", "text").mapInArrow(_per_batch(make, k), "node binary, items array<long>")


def sets_of(nodes: DataFrame, places: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Full sets of the given nodes, stored; `places` says which text stands for a node."""
    wanted = places.join(nodes.select("node").distinct(), "node", "left_semi").select("node", "key_id", "key_hash")
    texts = docs.select("text", *document_key()).join(small(stored(wanted, "wanted"), BROADCAST_IDS), ["key_id", "key_hash"])
    return stored(full_sets(texts, k).dropDuplicates(["node"]), "sets")


def confirmed(pairs: DataFrame, places: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    Of a pair the set of the node with fewer pairs travels; the other one's is repeated once per HOT of its pairs, so neither a hot
    centre's pairs meet in one task nor is its set sent along with each of them.
    """
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    sets = sets_of(ends, places, docs, k)
    degree = stored(ends.groupBy("node").agg(F.count(F.lit(1)).alias("d")), "degrees")
    both = pairs.join(degree.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("node").alias("b"), F.col("d").alias("db")), "b")
    turn = F.col("da") >= F.col("db")
    part = F.pmod(F.xxhash64("a", "b"), F.ceil(F.greatest("da", "db") / HOT))
    both = both.select(F.when(turn, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(turn, F.col("b")).otherwise(F.col("a")).alias("node"), part.alias("part"))
    both = stored(both, "oriented")
    hubs = both.select("hub", "part").distinct().join(sets.select(F.col("node").alias("hub"), F.col("items").alias("x")), "hub")
    joined = both.join(sets.withColumnRenamed("items", "y"), "node").join(hubs, ["hub", "part"])
    common = F.size(F.array_intersect("x", "y"))
    reached = joined.filter(100 * common >= percent * (F.size("x") + F.size("y") - common))
    return reached.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))


def _could_reach(percent: int) -> Column:
    """Sizes and odd sketches of m and o allow the threshold: their distance is never above the difference of the sets, which has a
    largest allowed value; for large sets the distance expected at that value plus 4.5 deviations is the tighter bound."""
    rest = (100.0 - percent) / (100.0 + percent)
    most = (F.col("m.n") + F.col("o.n")) * rest
    decay = F.exp(-4.0 * most / SKETCH)
    mean = SKETCH / 2 * (1 - F.exp(-2.0 * most / SKETCH))
    variance = F.greatest(SKETCH / 4 * (1 - decay) - most * decay, F.lit(0.0))
    distance = sum((F.bit_count(F.col("m.sketch")[i].bitwiseXOR(F.col("o.sketch")[i])) for i in range(SKETCH // 64)), F.lit(0))
    sizes = 100 * F.least("m.n", "o.n") >= percent * F.greatest("m.n", "o.n")
    return sizes & (distance <= F.least(most, mean + 4.5 * F.sqrt(variance) + 3))


def _placed(live: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (band, value, node, root) of the buckets that hold more than one component."""
    placed = live.select("band", "value", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stored(placed, "placed")
    split = placed.groupBy("band", "value").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band", "value")
    return stored(placed.join(stored(split, "split"), ["band", "value"]), "open")


def _candidates(pairs: DataFrame, facts: DataFrame, done: DataFrame | None, percent: int) -> DataFrame:
    """Different pairs (a < b) that could reach the threshold and are not done."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs if done is None else pairs.join(done, ["a", "b"], "left_anti")
    pairs = pairs.join(facts.select(F.col("node").alias("b"), F.struct("n", "sketch").alias("m")), "b").join(facts.select(F.col("node").alias("a"), F.struct("n", "sketch").alias("o")), "a")
    return stored(pairs.filter(_could_reach(percent)).select("a", "b"), "candidates")


def prefix_pairs(nodes: DataFrame, sets: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of the given (node, root) with other roots that could reach the threshold: those that share a shingle of their prefixes.

    Shingles are counted among these nodes; those of one node alone come first in its order and can't be shared.
    """
    cells = sets.join(nodes.select("node"), "node", "left_semi").select("node", F.size("items").alias("n"), F.explode("items").alias("item"))
    shared = cells.groupBy("item").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    met = cells.join(shared, "item").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("order"))
    length = F.col("n") - F.ceil(F.col("n") * (percent / 100.0) - 1e-9) + 1
    left = (length - (F.col("n") - F.size("order"))).cast("int")  # of the prefix, behind the shingles that no other node has
    heads = met.filter(left > 0).select("node", F.explode(F.slice("order", F.lit(1), F.greatest(left, F.lit(1)))).alias("o")).select("node", "o.item")
    heads = stored(heads.join(nodes, "node").join(facts, "node"), "heads")
    m, o = heads.alias("m"), heads.alias("o")
    pairs = m.join(o, (F.col("m.item") == F.col("o.item")) & (F.col("m.node") < F.col("o.node")) & (F.col("m.root") != F.col("o.root")) & _could_reach(percent))
    return pairs.select(F.col("m.node").alias("a"), F.col("o.node").alias("b")).distinct()


def linked(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key_id, key_hash, n, node) of each row, and (node, root) of each linked node."""
    signed = stored(signatures(docs, k), "signatures")
    key = F.struct("key_id", "key_hash")
    sets = signed.filter("node IS NOT NULL").groupBy("node").agg(F.min(key).alias("key"), F.min_by(F.struct("n", "bands", "sketch"), key).alias("f"))
    chosen = stored(sets.select("node", "key.*", "f.*"), "nodes")
    places, facts = chosen.select("node", "key_id", "key_hash"), chosen.select("node", "n", "sketch")

    members = chosen.select("node", F.posexplode("bands").alias("band", "value"))
    counts = stored(members.groupBy("band", "value").agg(F.count(F.lit(1)).alias("shared")).filter("shared > 1"), "counts")
    live = stored(members.join(counts, ["band", "value"]), "live")
    central = live.groupBy("node").agg(F.sum("shared").alias("weight"))
    centres = live.join(central, "node").groupBy("band", "value").agg(F.max(F.struct("weight", "node")).alias("c")).select("band", "value", F.col("c.node").alias("a"))
    centres = stored(centres, "centres")
    done = _candidates(live.join(centres, ["band", "value"]).filter("a <> node").select("a", F.col("node").alias("b")), facts, None, percent)
    links = stored(confirmed(done, places, docs, k, percent), "links")
    roots = components(links)

    open_, turn = _placed(live, roots), 0
    while not open_.isEmpty():
        drawn = F.struct(F.xxhash64(F.lit(turn), "band", "value", "node").alias("draw"), "node", "root")
        picked = open_.groupBy("band", "value").agg(F.min(drawn).alias("c")).select("band", "value", F.col("c.node").alias("a"), F.col("c.root").alias("its"))
        picked = stored(picked, "picked")
        star = _candidates(open_.join(picked, ["band", "value"]).filter("root <> its").select("a", F.col("node").alias("b")), facts, done, percent)
        more = stored(confirmed(star, places, docs, k, percent), "links")
        before = open_.select("root").distinct().count()
        if not more.isEmpty():
            links, done = links.unionByName(more), done.unionByName(star)
            roots = components(links)
            open_ = _placed(live, roots)
        if open_.select("root").distinct().count() > LEAST_GAIN * before:
            break
        turn += 1
    left = stored(open_.select("node", "root").distinct(), "left")
    if not left.isEmpty():
        rest = stored(prefix_pairs(left, sets_of(left, places, docs, k), facts, percent).join(done, ["a", "b"], "left_anti"), "rest")
        more = stored(confirmed(rest, places, docs, k, percent), "rest_links")
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    return signed.select("doc_id", "key_id", "key_hash", "n", "node"), roots


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with the root of their component, null for empty sets."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links), kept."""
    rows, roots = linked(docs, k, percent)
    ids = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    ids = stored(_rooted(ids, roots), "ids")
    named = ids.join(ids.groupBy("root").agg(F.min("least").alias("c")), "root").select("node", "c")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("c"))
    out = rows.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the smallest id, then digest, then text key; rows without a word all stay.

    Rows that repeat an id with other text stay, unless they are near copies.  Of rows with equal id and text one stays.
    """
    rows, roots = linked(docs, k, percent)
    texts = rows.filter("node IS NOT NULL").groupBy("node", "key_id", "key_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("times"))
    texts = stored(_rooted(texts, roots), "texts")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node", "key_hash")
    first = stored(texts.groupBy("root").agg(F.min_by(F.struct("key_id", "key_hash", "times"), order).alias("r")).select("r.*"), "first")
    key = ["key_id", "key_hash"]
    gone = stored(texts.join(first, key, "left_anti").select("key_id", "key_hash"), "gone")
    again = stored(first.filter("times > 1").select(*key), "again")
    whole = docs.select(F.struct(*docs.columns).alias("row"), *document_key())
    out = whole.join(small(gone, BROADCAST_IDS), key, "left_anti")
    if again.isEmpty():
        return out.select("row.*")
    repeated = small(again, BROADCAST_IDS)
    one = out.join(repeated, key, "left_semi").groupBy(key).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return out.join(repeated, key, "left_anti").select("row.*").unionByName(one.select("row.*"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=4, percent=80)
