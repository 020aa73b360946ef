"""Operator 5: language identification by words first, backing off to shorter character n-grams for unseen words.

Learnt from a deterministic share of each language's rows: at most about PER_LANGUAGE documents and CHARACTERS characters of whole texts a
language, and ALL_CHARACTERS over all languages; the bounds are parameters.  Every word and every n-gram of that sample counts.  A known
word adds its log frequency in each language; an unseen one the mean log frequency of its known n-grams of the longest length that has
any.  Words and n-grams are counted in Spark and known by 64-bit hashes, in sorted arrays.

Null texts and texts without a letter are `und` with score 0; where nothing was learnt every text is.  Ties go to the first language by
code point.  Long texts are read whole, in runs of bounded size.  Rows that repeat each get a row and teach once each.  Empty tables give no
rows.  Columns but doc_id, text and lang are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quipu.llm.common import batched, held_out, read, runs, share

PER_LANGUAGE, CHARACTERS, ALL_CHARACTERS, LONGEST = 3000, 6_000_000, 40_000_000, 5
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and number signs that have a letter (general category L): `Ⅷ`, `½` and `①` alone are no words."""
    return [w for w in LETTERS.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]


def hashed(names: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array([*names, ""], dtype=object), categorize=False)[:-1]


def grams_of(word: str, size: int) -> list[str]:
    padded = f" {word} "
    return [padded[j : j + size] for j in range(len(padded) - size + 1)]


@dataclass
class Table:
    """Log frequencies of hashed names, a row each, in order of the hashes."""

    keys: np.ndarray
    logs: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, language: np.ndarray, n: np.ndarray, languages: int) -> Table:
        """Half a count is added to every name in every language."""
        found, at = np.unique(keys, return_inverse=True)
        counts = np.zeros((len(found), languages))
        np.add.at(counts, (at, language), n)
        return cls(found, (np.log(counts + 0.5) - np.log(counts.sum(0) + 0.5 * (len(found) + 1))).astype(np.float32))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


@dataclass
class Languages:
    names: list[str]
    prior: np.ndarray
    words: Table
    grams: list[Table]  # by length, from 1

    def word_scores(self, found: list[str]) -> np.ndarray:
        out = np.zeros((len(found), len(self.names)), np.float32)
        at = self.words.find(hashed(found))
        out[at >= 0] = self.words.logs[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for size in range(LONGEST, 0, -1):
            lists = [grams_of(found[i], size) for i in left]
            row = np.repeat(np.arange(len(left)), [len(x) for x in lists])
            table = self.grams[size - 1]
            place = table.find(hashed([g for x in lists for g in x]))
            row, place = row[place >= 0], place[place >= 0]
            known = np.bincount(row, minlength=len(left))
            for k in range(len(self.names)):
                sums = np.bincount(row, table.logs[place, k], len(left))
                out[left[known > 0], k] = (sums / np.maximum(known, 1))[known > 0]
            left = left[known == 0]
        return out


def counted(docs: DataFrame) -> DataFrame:
    """(lang, size, key, n): how often each language has each word (size 0) and n-gram of its words, by hash."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["lang", "word", "n"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for size in range(LONGEST + 1):
                lists = [grams_of(w, size) for w in found] if size else [[w] for w in found]
                row = np.repeat(np.arange(len(found)), [len(x) for x in lists])
                names = hashed([g for x in lists for g in x]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(np.full(len(row), size), pa.int64()), pa.array(names), pa.array(n[row])], ["lang", "size", "key", "n"])

    whole = batched(docs).select("lang", "text").mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return whole.mapInArrow(keys, "lang string, size long, key long, n long").groupBy("lang", "size", "key").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, characters: int = CHARACTERS) -> Languages:
    """docs: rows to learn from, with doc_id, text and lang."""
    docs = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    totals = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars")).collect()
    names = sorted(r.lang for r in totals)
    most = min(characters, ALL_CHARACTERS // max(1, len(names)))
    chosen = F.lit(False)
    for r in totals:
        chosen = chosen | ((F.col("lang") == r.lang) & share(F.xxhash64("doc_id", "text"), min(1.0, per_language / r.n, most / max(1, r.chars))))
    found = counted(docs.filter(chosen)).toArrow()
    language = np.searchsorted(np.array(names, dtype=object), np.array(found["lang"].to_pylist() + [None], dtype=object)[:-1]) if names else np.zeros(0, np.int64)
    size, key, n = (found[c].to_numpy() for c in ("size", "key", "n"))
    tables = [Table.of(key[size == s].view(np.uint64), language[size == s], n[size == s], len(names)) for s in range(LONGEST + 1)]
    counts = {r.lang: r.n for r in totals}
    prior = np.log(np.array([counts[x] for x in names], dtype=np.float64) / max(1, sum(counts.values())))
    return Languages(names, prior, tables[0], tables[1:])


def predict(docs: DataFrame, model: Languages) -> DataFrame:
    """Per row: doc_id, lang_pred, score (posterior of the language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for start, length in runs(batch.column(1)):
                part = batch.slice(start, length)
                lists = [words_of(t) for t in part.column(1).to_pylist()]
                codes, found = pd.factorize(np.array([w for x in lists for w in x] + [None], dtype=object)[:-1])
                row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                langs, scores = ["und"] * len(lists), np.zeros(len(lists))
                if m.names and len(codes):
                    each = m.word_scores(list(found))
                    total = np.stack([np.bincount(row, each[codes, k], len(lists)) for k in range(len(m.names))], axis=1) + m.prior
                    odds = np.exp(total - total.max(1, keepdims=True))
                    odds /= odds.sum(1, keepdims=True)
                    best = odds.argmax(1)
                    for i, x in enumerate(lists):
                        if x:
                            langs[i], scores[i] = m.names[best[i]], odds[i, best[i]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return batched(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out(F.col("doc_id"), 5)))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "lang_pred", "score")
