"""Operator 6: LM scoring with Brown class bigrams.

Tokens are UTF-8 runs without ASCII white space, A-Z lowered, and one end per text.  All counts cover all training rows.  The most
frequent words and, for all other words, their two-byte endings are the units that exchange clustering assigns to seed classes.  Then
every other word of the training rows takes the class with the best exchange gain, from the counts of its left and right classes over all
of them (one sweep, against the seed classes); unseen words have the class of their ending.  The class bigrams are counted again with these classes.  A text's log10 probability is the sum of class transition and word emission, both smoothed; an
unseen word takes the spare mass of its class.

Counts and classes of frequent words (at most FREQUENT) are looked up in the pass over the texts; those of all others come by a hash
join of the distinct rare words of each text.  Null texts count as empty ones (one end).  Each row is scored, repeated ones too, and
equal texts score the same.  A long text is read whole, in one task.  Of equally frequent words the first by bytes is the seed, of equal
gains the present class stays.  Empty tables give no rows.  Columns but doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quipu.llm.common import held_out, read, runs, stored, utf8

END = b"\n"
WORDS, ENDINGS, CLASSES, FREQUENT = 1000, 400, 48, 200_000
ADD, HELD_TYPES, ROUNDS = 0.1, 800_000, 8
PART = 4 << 20  # bytes of text that are taken apart together


def tokens(text: str | None) -> list[bytes]:
    found = (text or "").encode().lower().split()
    found.append(END)
    return found


def exchange(bigrams: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit: units move, most frequent first, to the class that raises the likelihood of the class bigrams most."""
    n = len(bigrams)
    classes = min(classes, n)
    order = np.argsort(-bigrams.sum(1), kind="stable")
    of = np.empty(n, np.int64)
    of[order] = np.arange(n) % classes
    table = np.zeros((classes, classes))
    np.add.at(table, (of[:, None], of[None, :]), bigrams)
    diagonal = np.arange(classes)
    for _ in range(rounds):
        moved = 0
        for u in order:
            row, column, own = np.bincount(of, bigrams[u], classes), np.bincount(of, bigrams[:, u], classes), of[u]
            self_pairs = bigrams[u, u]
            row[own] -= self_pairs
            column[own] -= self_pairs
            table[own] -= row
            table[:, own] -= column
            table[own, own] -= self_pairs
            left, right = table.sum(1), table.sum(0)
            gain = (xlogx(table + row) - xlogx(table)).sum(1) + (xlogx(table.T + column) - xlogx(table.T)).sum(1)
            both, at = row + column + self_pairs, table[diagonal, diagonal]
            gain += xlogx(at + both) - xlogx(at + row) - xlogx(at + column) + xlogx(at)
            out, into = row.sum() + self_pairs, column.sum() + self_pairs
            gain -= xlogx(left + out) - xlogx(left) + xlogx(right + into) - xlogx(right)
            best = int(np.argmax(gain))
            best = own if gain[best] <= gain[own] + 1e-9 else best
            table[best] += row
            table[:, best] += column
            table[best, best] += self_pairs
            of[u], moved = best, moved + (best != own)
        if not moved:
            break
    return of


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(table: np.ndarray, own: np.ndarray, word: np.ndarray, cell: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Class of each word that raises the likelihood of the class bigrams most, all other words as they are in `table`.

    A word's counts are (word, cell, n), in order of words: cell c is its right neighbours in class c, k + c its left ones, 2 k the word
    beside itself.
    """
    k, words, every = len(table), len(own), np.arange(len(own))
    counts = np.bincount(word * (2 * k + 1) + cell, n, words * (2 * k + 1)).reshape(words, 2 * k + 1)
    right, left, self_pairs = counts[:, :k], counts[:, k : 2 * k], counts[:, 2 * k]
    gain = np.zeros((words, k))
    for side, tab, across in ((0, table.T.copy(), left), (1, table.copy(), right)):
        at = np.flatnonzero(cell // k == side)
        if not len(at):
            continue
        w, j, more = word[at], cell[at] - side * k, n[at].astype(float)
        home, row = own[w], np.arange(len(at))
        base = tab[j]
        change = xlogx(base + more[:, None]) - xlogx(tab)[j]
        base[row, home] -= more  # the word itself is in its class's counts
        inside = np.flatnonzero(j == home)
        base[inside] -= across[w[inside]]
        base[inside, home[inside]] -= self_pairs[w[inside]]
        change[row, home] = xlogx(base[row, home] + more) - xlogx(base[row, home])
        change[inside] = xlogx(base[inside] + more[inside, None]) - xlogx(base[inside])
        starts = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[starts]] += np.add.reduceat(change, starts, axis=0)
    both = right + left + self_pairs[:, None]
    at = np.repeat(table[np.arange(k), np.arange(k)][None, :], words, 0)
    at[every, own] -= both[every, own]
    gain += xlogx(at + both) - xlogx(at + right) - xlogx(at + left) + xlogx(at)
    for margin, mine in ((table.sum(1), right.sum(1) + self_pairs), (table.sum(0), left.sum(1) + self_pairs)):
        rest = np.repeat(margin[None, :], words, 0)
        rest[every, own] -= mine
        gain -= xlogx(rest + mine[:, None]) - xlogx(rest)
    best = gain.argmax(1)
    return np.where(gain[every, best] <= gain[every, own] + 1e-9, own, best)


@dataclass
class Units:
    """What stands for a token in the class model: itself, the end, its ending, or the rest (unit 1)."""

    words: dict[bytes, int]
    endings: dict[bytes, int]

    def __len__(self) -> int:
        return 2 + len(self.words) + len(self.endings)

    def of(self, token: bytes) -> int:
        return 0 if token == END else self.words[token] if token in self.words else self.endings.get(token[-2:], 1)

    @cached_property
    def known(self) -> tuple[pa.Array, np.ndarray]:
        return pa.array([END, *self.words], pa.binary()), np.array([0, *self.words.values()])

    @cached_property
    def by_ending(self) -> np.ndarray:
        """Unit by the last two bytes (from 256 on), or by the only one."""
        out = np.ones(256 + (1 << 16), np.int64)
        for e, unit in self.endings.items():
            out[256 * (len(e) - 1) + int.from_bytes(e, "big")] = unit
        return out

    def of_all(self, tokens: pa.Array) -> np.ndarray:
        words, units = self.known
        at = pc.index_in(tokens, value_set=words).fill_null(-1).to_numpy()
        data, ends = utf8(tokens)
        last, before = data[ends - 1].astype(np.int64), data[np.maximum(ends - 2, 0)].astype(np.int64)
        return np.where(at >= 0, units[at], self.by_ending[np.where(np.diff(ends, prepend=0) > 1, 256 + 256 * before + last, last)])


@dataclass
class Lookup:
    """Fixed size: the frequent words with counts and classes, the units with seed classes."""

    frequent: dict[bytes, int]  # place in seen and cls
    seen: np.ndarray
    cls: np.ndarray
    units: Units
    unit_class: np.ndarray

    @cached_property
    def names(self) -> pa.Array:
        return pa.array(list(self.frequent), pa.binary())

    def place(self, tokens: pa.Array) -> np.ndarray:
        return pc.index_in(tokens, value_set=self.names).fill_null(-1).to_numpy().astype(np.int64)

    def of_all(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place (-1: none) and class of each token; of a token without a place the seed class."""
        place, seed = self.place(tokens), self.unit_class[self.units.of_all(tokens)]
        return place, np.where(place >= 0, self.cls[place], seed) if len(self.cls) else seed


@dataclass
class Model:
    counts: DataFrame  # token, n, cls: the training tokens that have no place in `lookup`
    lookup: Lookup
    total: int
    types: int
    types_in: np.ndarray  # of each class


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]]:
    """Runs of rows: the rows, tokens' codes, row of each token, the different tokens.  The end is the last of these; "" may be among
    them, but no code is its.
    """
    for batch in batches:
        for at, rows in runs(batch.column(column), PART, batch.num_rows):
            part = batch.slice(at, rows)
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(part.column(column), "")))
            flat = lists.flatten().cast(pa.binary()).dictionary_encode()
            codes, found = flat.indices.to_numpy().astype(np.int64), flat.dictionary
            row = np.repeat(np.arange(rows), pc.list_value_length(lists).to_numpy())
            if (empty := pc.index(found, pa.scalar(b"", pa.binary())).as_py()) >= 0:
                row, codes = row[codes != empty], codes[codes != empty]
            ends = np.searchsorted(row, np.arange(rows), "right")
            yield part, np.insert(codes, ends, len(found)), np.insert(row, ends, np.arange(rows)), pa.concat_arrays([found, pa.array([END], pa.binary())])


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over all rows of docs, summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def merged() -> pa.Table:
            out = pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")])
            return pa.table([out["token"], out["n_sum"]], ["token", "n"])

        for _, codes, _, found in _batches(batches, 0):
            n = np.bincount(codes, minlength=len(found))
            at = pa.array(np.flatnonzero(n))
            held.append(pa.table([found.take(at), pa.array(n).take(at)], ["token", "n"]))
            size += len(at)
            if size > 2 * HELD_TYPES:
                held[:], size = [table := merged()], table.num_rows
                if size > HELD_TYPES:
                    yield from table.to_batches()
                    held, size = [], 0
        if held:
            yield from merged().to_batches()

    return docs.select("text").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _summed(df: DataFrame, size: int, cells: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> np.ndarray:
    """How often each of `size` cells comes over all tasks, as one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for at in cells(batches):
            held += np.bincount(at, minlength=size)
        filled = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array(held[filled], pa.int64())], ["cell", "n"])

    found = df.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


def frequent_words(counts: DataFrame, most: int) -> tuple[int, dict[bytes, int]]:
    """A count that at most `most` words reach, found from a histogram with steps of 1/16 octave; those words and their counts."""
    step = F.floor(F.log2("n") * 16)
    steps, held, cut = counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("s")).collect(), 0, None
    for r in steps:
        held += r.words
        if held > most:
            break
        cut = r.least
    if cut is None:
        return 1 << 62, {}
    found = counts.filter(F.col("n") >= cut).toArrow()
    return cut, dict(zip(found["token"].to_pylist(), found["n"].to_pylist(), strict=True))


def _blobs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of values as bytes; bounds: where each begins, and the end of the last."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(((bounds - bounds[0]) * values.itemsize).astype(np.int32)), pa.py_buffer(values[bounds[0] : bounds[-1]].copy())])


def contexts(docs: DataFrame, lookup: Lookup, classes: int) -> DataFrame:
    """(place, token, cells, n): how often each word but the seed words has a neighbour of a seed class (cells as in best_classes), summed
    within each task for a frequent word, which is named by its place, and within runs of texts for any other.  The cells and counts of a
    word are the bytes of 16 and 32 bit numbers, so that rows are words, not cells.
    """
    shared, width = docs.sparkSession.sparkContext.broadcast(lookup), 2 * classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = shared.value
        seeds = 2 + len(look.units.words)
        held = np.zeros(len(look.frequent) * width, np.int32)

        def rows(pairs: np.ndarray, n: np.ndarray, tokens: pa.Array | None) -> pa.RecordBatch:
            """pairs: word * width + cell, in order; without tokens, words are places."""
            word = pairs // width
            bounds = np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(word))
            word = word[bounds[:-1]]
            names = [pa.array(word), pa.nulls(len(word), pa.binary())] if tokens is None else [pa.nulls(len(word), pa.int64()), tokens.take(pa.array(word))]
            return pa.RecordBatch.from_arrays([*names, _blobs((pairs % width).astype(np.int16), bounds), _blobs(n.astype(np.int32), bounds)], ["place", "token", "cells", "n"])

        for _, codes, _, found in _batches(batches, 0):
            unit, place = look.units.of_all(found), look.place(found)
            seed = look.unit_class[unit]
            moves = (unit >= seeds) | (unit == 1)
            a, b = np.concatenate([[len(found) - 1], codes[:-1]]), codes
            alone = a == b
            first, second, beside = moves[a] & ~alone, moves[b] & ~alone, moves[a] & alone
            word = np.concatenate([a[first], b[second], a[beside]])
            cell = np.concatenate([seed[b[first]], classes + seed[a[second]], np.full(beside.sum(), 2 * classes)])
            at = place[word]
            np.add.at(held, at[at >= 0] * width + cell[at >= 0], 1)
            pairs, n = np.unique(word[at < 0] * width + cell[at < 0], return_counts=True)
            if len(pairs):
                yield rows(pairs, n, found)
        for at in range(0, len(held), 20_000 * width):
            pairs = np.flatnonzero(held[at : at + 20_000 * width]) + at
            if len(pairs):
                yield rows(pairs, held[pairs], None)

    return docs.select("text").mapInArrow(run, "place long, token binary, cells binary, n binary")


def moved(cells: DataFrame, lookup: Lookup, table: np.ndarray) -> DataFrame:
    """(place, token, cls): each word's best class.

    A word's counts meet by one sorted shuffle and are summed as they stream by; the last word of a batch waits for the next one.
    """
    width = 2 * len(table) + 1
    shared = cells.sparkSession.sparkContext.broadcast((lookup, table))
    schema = pa.schema([("place", pa.int64()), ("token", pa.binary()), ("cls", pa.int64())])

    def settled(rows: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        """rows: whole words, in order; first: where each begins."""
        look, table = shared.value
        cell, ends = utf8(rows["cells"].combine_chunks())
        n, _ = utf8(rows["n"].combine_chunks())
        word = np.repeat(np.arange(len(first)), np.diff(ends[np.append(first[1:], rows.num_rows) - 1], prepend=0) // 2)
        counts = np.bincount(word * width + cell.view(np.int16), n.view(np.int32), len(first) * width)
        at = np.flatnonzero(counts)
        heads = rows.select(["place", "token"]).take(pa.array(first)).combine_chunks()
        place, token = (heads[c].combine_chunks() for c in ("place", "token"))
        own = look.unit_class[look.units.of_all(pc.coalesce(token, look.names.take(place)))]
        best = best_classes(table, own, at // width, at % width, counts[at])
        return pa.RecordBatch.from_arrays([place, token, pa.array(best.astype(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for batch in batches:
            rows = pa.concat_tables([*waiting, pa.Table.from_batches([batch])]).combine_chunks()
            place, token = rows["place"].fill_null(-1).to_numpy(), rows["token"].fill_null(b"").combine_chunks().dictionary_encode().indices.to_numpy()
            first = np.flatnonzero((np.diff(place, prepend=-2) != 0) | (np.diff(token, prepend=-1) != 0))
            for at in range(0, len(first) - 1, 500):
                end = min(at + 500, len(first) - 1)
                yield settled(rows.slice(first[at], first[end] - first[at]), first[at:end] - first[at])
            waiting = [rows.slice(first[-1])] if len(first) else []
        for rows in waiting:
            yield settled(rows, np.zeros(1, np.int64))

    return cells.repartition("place", "token").sortWithinPartitions("place", "token").mapInArrow(run, "place long, token binary, cls long")


def train(docs: DataFrame, words: int = WORDS, endings: int = ENDINGS, classes: int = CLASSES) -> Model:
    counts = stored(token_counts(docs), "counts")
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least, frequent = frequent_words(counts, FREQUENT)
    top = sorted((w for w in frequent if w != END), key=lambda w: (-frequent[w], w))[:words]
    ends = counts.filter(F.col("token") != F.lit(bytearray(END))).groupBy(F.substring("token", -2, 2).alias("e")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "e").limit(endings).collect()
    units = Units({w: i + 2 for i, w in enumerate(top)}, {bytes(r.e): i + 2 + len(top) for i, r in enumerate(ends)})
    size = len(units)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, codes, _, found in _batches(batches, 0):
            seen = units.of_all(found)[codes]
            before = np.concatenate([[0], seen[:-1]])
            yield before * size + seen

    bigrams = _summed(docs.select("text"), size * size, pairs).reshape(size, size).astype(float)
    unit_class = exchange(bigrams, classes)
    k = int(unit_class.max()) + 1
    table = np.zeros((k, k))
    np.add.at(table, (unit_class[:, None], unit_class[None, :]), bigrams)
    seen = np.fromiter(frequent.values(), np.int64, len(frequent))
    seed = unit_class[units.of_all(pa.array(list(frequent), pa.binary()))]
    lookup = Lookup({w: i for i, w in enumerate(frequent)}, seen, seed, units, unit_class)
    best = stored(moved(contexts(docs, lookup, k), lookup, table), "classes")
    found = best.filter("place IS NOT NULL").select("place", "cls").toArrow()
    lookup.cls = seed.copy()
    lookup.cls[found["place"].to_numpy()] = found["cls"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(lookup)

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = shared.value.unit_class[shared.value.units.of_all(b.column(0))]
            cls = b.column(2).to_numpy(zero_copy_only=False).astype(float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.where(np.isnan(cls), own, cls).astype(np.int64))], ["token", "n", "cls"])

    rest = counts.filter(F.col("n") < least).join(best.filter("place IS NULL").select("token", "cls"), "token", "left")
    rest = stored(rest.select("token", "n", "cls").mapInArrow(seeded, "token binary, n long, cls long"), "rest")
    types_in = np.bincount(lookup.cls, minlength=k)
    for r in rest.groupBy("cls").count().collect():
        types_in[r["cls"]] += r["count"]
    return Model(rest, lookup, total, types, types_in)


def encoded(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, word (sum of log10 of counts), classes (a byte per token)."""
    shared = docs.sparkSession.sparkContext.broadcast(model.lookup)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = shared.value
        for part, codes, row, found in _batches(batches, 2):
            rows = part.num_rows
            place, cls = look.of_all(found)
            count = np.where(place >= 0, look.seen[place], 0) if len(look.seen) else np.zeros(len(found), np.int64)
            seen = count[codes]
            word = np.bincount(row, np.where(count > 0, np.log10(count + ADD), 0.0)[codes], rows)
            bounds = np.searchsorted(row, np.arange(rows + 1))
            rare = np.flatnonzero(seen == 0)
            pairs, which = np.unique(row[rare] * len(found) + codes[rare], return_inverse=True)
            firsts = np.searchsorted(pairs, np.arange(rows + 1) * len(found))
            names = found.take(pa.array(pairs % len(found)))
            slots = np.full(len(codes), -1, np.int64)
            slots[rare] = which - firsts[row[rare]]
            at = np.flatnonzero(slots >= 0)
            starts = np.searchsorted(row[at], np.arange(rows + 1))
            here, flat = cls.astype(np.uint8)[codes].tobytes(), slots[at].astype(np.int32)
            lists = lambda values, kind, b: pa.ListArray.from_arrays(pa.array(b, pa.int32()), pa.array(values, kind))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.bincount(row, minlength=rows), pa.int64()), pa.array(np.bincount(row, seen > 0, rows).astype(np.int64)), pa.array(word), pa.array([here[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()), lists(names, pa.binary(), firsts), lists(flat, pa.int32(), starts), lists((at - bounds[row[at]]).astype(np.int32), pa.int32(), starts)],
                ["uid", "doc_id", "n_tokens", "n_known", "word", "classes", "rare", "slots", "places"],
            )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known, word, classes = [], [], []
            for k, w, c, slots, places, tail in zip(*(b.column(i).to_pylist() for i in range(2, 5)), *(b.column(i) for i in range(5, 8)), strict=True):
                if slots.values is not None and len(slots.values):
                    slot, place = slots.values.to_numpy(), places.values.to_numpy()
                    n, cls, have = np.zeros(slot.max() + 1, np.int64), np.zeros(slot.max() + 1, np.uint8), np.zeros(slot.max() + 1, bool)
                    if tail.values is not None and len(tail.values):
                        at = tail.values.field("i").to_numpy()
                        n[at], cls[at], have[at] = tail.values.field("n").to_numpy(), tail.values.field("cls").to_numpy(), True
                    k += int((n[slot] > 0).sum())
                    w += float(np.log10(n[slot] + ADD).sum())
                    held = np.frombuffer(c, np.uint8).copy()
                    held[place] = np.where(have[slot], cls[slot], held[place])
                    c = held.tobytes()
                known.append(k)
                word.append(w)
                classes.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(known, pa.int64()), pa.array(word, pa.float64()), pa.array(classes, pa.binary())], ["doc_id", "n_tokens", "n_known", "word", "classes"])

    found = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text").mapInArrow(look_up, "uid long, doc_id long, n_tokens long, n_known long, word double, classes binary, rare array<binary>, slots array<int>, places array<int>")
    found = stored(found, "looked_up")
    rare = found.select("uid", F.posexplode("rare").alias("i", "token")).join(model.counts, "token")
    tail = rare.groupBy("uid").agg(F.collect_list(F.struct("i", "n", F.col("cls").cast("int").alias("cls"))).alias("tail"))
    joined = found.drop("rare").join(tail, "uid", "left").select("doc_id", "n_tokens", "n_known", "word", "classes", "slots", "places", "tail")
    return stored(joined.mapInArrow(settle, "doc_id long, n_tokens long, n_known long, word double, classes binary"), "encoded")


def score(docs: DataFrame, learnt: DataFrame, model: Model) -> DataFrame:
    """Of encoded docs: doc_id, n_tokens, n_known, base_score (unigram), score (class bigram with the transitions of `learnt`), in log10."""
    k, end = len(model.types_in), int(model.lookup.unit_class[0])

    def steps(classes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        here = np.frombuffer(b"".join(classes.to_pylist()), np.uint8).astype(np.int64)
        return np.concatenate([[end], here[:-1]])[: len(here)], here  # each row ends with the end, where the next one starts

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            before, here = steps(b.column(0))
            yield before * k + here

    table = _summed(learnt.select("classes"), k * k, pairs).reshape(k, k).astype(float)
    tokens_in = table.sum(0)
    prior = (tokens_in + 0.5) / (tokens_in.sum() + 0.5 * k)
    transition = np.log10((table + 2.0 * prior) / (table.sum(1, keepdims=True) + 2.0))
    mass = np.log10(tokens_in + ADD * (model.types_in + 1))
    base_mass = float(np.log10(model.total + ADD * (model.types + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before, here = steps(b.column(4))
            n, word = b.column(1).to_numpy(), b.column(3).to_numpy()
            row = np.repeat(np.arange(b.num_rows), n)
            own = word + np.bincount(row, transition[before, here] - mass[here], b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(word - n * base_mass), pa.array(own)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.filter(~held_out(F.col("doc_id"), 10)))
    texts = encoded(docs, model)
    out = score(texts, texts.filter(~held_out(F.col("doc_id"), 10)), model).withColumn("held_out", held_out(F.col("doc_id"), 10)).withColumn("train_tokens", F.lit(model.total).cast("long"))
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", perplexity.alias("perplexity"))
