"""Operator 10: toxicity by non-negative positive-unlabelled learning.

Linear classifiers over the presence of words and word beginnings, trained in numpy from documents confirmed as toxic and a sample of all
other rows that may be learnt from, whatever their label.  The risk is prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]):
the unlabelled part can't go negative.  The class prior is the toxic share of the labelled rows.  Every feature of the samples is weighed;
its value is 1 for a feature whose rates in the two samples differ by SURE standard deviations or more and falls with the square of that
distance below, so that what tells the samples apart only by chance stays near 0.  The samples are bounded in rows (POSITIVES, UNLABELLED)
and in characters of whole texts (CHARACTERS); the bounds are parameters.

Null texts count as empty ones.  Without confirmed examples every score is 0.  A long text is read whole, its features once each.  Rows
that repeat each get a row, and teach once each; texts of the same words tie, with equal scores.  Empty tables give no rows.  A column
named like the result is replaced, others are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quipu.llm.common import batched, held_out, read, share, small, stored
from quipu.llm.quality import labelled_sample

POSITIVES, UNLABELLED, CHARACTERS, CLASSIFIERS, SURE = 3000, 10_000, 40_000_000, 2, 10.0
LETTERS = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """The different words, their beginnings of 4 to 7 letters (`ab*`), and the beginnings that several different words share (`ab**`)."""
    words = set(LETTERS.findall((text or "").lower()))
    out = set(words)
    for n in range(4, 8):
        once: set[str] = set()
        again: set[str] = set()
        for c in [w[:n] for w in words if len(w) > n]:
            (again if c in once else once).add(c)
        out.update([c + "*" for c in once], [c + "**" for c in again])
    return out


@dataclass
class Toxicity:
    weights: dict[str, float]
    intercept: float

    def score(self, text: str | None) -> float:
        logit = self.intercept + sum(self.weights[w] for w in features(text) & self.weights.keys())
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


@dataclass
class Rows:
    """Sets of features of some documents: the features of all, one after another, and how many each has."""

    features: np.ndarray
    sizes: np.ndarray

    def __post_init__(self) -> None:
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.features], len(self.sizes))

    def spread(self, values: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.features, values[self.row], width)

    def some(self, first: int, step: int) -> Rows:
        taken = np.arange(len(self.sizes)) % step == first
        return Rows(self.features[taken[self.row]], self.sizes[taken])


def distances(xp: Rows, xu: Rows, width: int) -> np.ndarray:
    """Standard deviations between each feature's rates in the two samples."""
    p, u, n, m = np.bincount(xp.features, minlength=width), np.bincount(xu.features, minlength=width), len(xp.sizes), len(xu.sizes)
    rate = (p + u) / (n + m)
    return np.abs(p / n - u / m) / np.sqrt(rate * (1 - rate) * (1 / n + 1 / m) + 1e-12)


def nn_pu(xp: Rows, xu: Rows, values: np.ndarray, prior: float, rounds: int = 120, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam; where the corrected risk of the unlabelled part is negative its gradient is reversed."""
    width, w = len(values), np.zeros(len(values) + 1)  # the intercept last
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -60, 60)))
    for t in range(1, rounds + 1):
        vp, vu = xp.sums(w[:-1] * values) + w[-1], xu.sums(w[:-1] * values) + w[-1]
        sp, su = sigmoid(vp), sigmoid(vu)
        positive, minus, unlabelled = -prior * (1 - sp) / len(sp), -prior * sp / len(sp), su / len(su)
        risk = np.logaddexp(0, vu).mean() - prior * np.logaddexp(0, vp).mean()
        on_p, on_u = (positive + minus, unlabelled) if risk >= 0 else (-minus, -unlabelled)
        grad = np.append((xp.spread(on_p, width) + xu.spread(on_u, width)) * values + decay * w[:-1], on_p.sum() + on_u.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1] * values, float(w[-1])


def fit(positive: Rows, unlabelled: Rows, prior: float, names: list[str]) -> Toxicity:
    """names: the features by number."""
    if not len(positive.sizes) or not len(unlabelled.sizes) or prior <= 0:
        return Toxicity({}, -60.0)
    values = np.minimum(1, (distances(positive, unlabelled, len(names)) / SURE) ** 2)
    parts = min(CLASSIFIERS, len(unlabelled.sizes))
    found = [nn_pu(positive, unlabelled.some(k, parts), values, min(prior, 0.9)) for k in range(parts)]
    w = np.mean([f[0] for f in found], axis=0)
    return Toxicity({n: float(v) for n, v in zip(names, w, strict=True) if v}, float(np.mean([f[1] for f in found])))


def sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int, characters: int = CHARACTERS) -> tuple[DataFrame, float]:
    """(doc_id, positive, w): features of confirmed toxic documents and of unlabelled ones, stored; and the class prior."""
    docs = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id"), 5))
    known = labelled_sample(labels, "toxic", 1 << 60)
    toxic, all_ = known.agg(F.coalesce(F.sum(F.col("y")), F.lit(0)), F.count(F.lit(1))).first()
    rows, chars = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    fits = characters * max(1, rows) / max(1, chars)  # texts of mean length
    confirmed = known.filter("y = 1").filter(share(F.col("doc_id"), min(positives, fits / 2) / max(1, toxic))).select("doc_id")
    others = docs.filter(share(F.col("doc_id"), min(unlabelled, fits / 2) / max(1, rows), "unlabelled"))
    both = docs.join(small(confirmed, 4 * positives), "doc_id", "left_semi").withColumn("positive", F.lit(True)).unionByName(others.withColumn("positive", F.lit(False)))
    both = batched(both)
    split = F.arrow_udf(lambda values: pa.array([sorted(features(v.as_py())) for v in values], pa.list_(pa.string())), "array<string>")
    return stored(both.select("doc_id", "positive", split(F.col("text")).alias("w")), "toxicity_sample"), toxic / max(1, all_)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Toxicity:
    """The samples come to the driver as hashes of features, each different feature's name once."""
    found, prior = sample(docs, labels, positives, unlabelled)
    names = found.select(F.explode("w").alias("w")).distinct().select(F.xxhash64("w").alias("h"), "w").toArrow()
    names = dict(zip(names["h"].to_pylist(), names["w"].to_pylist(), strict=True))
    keys = np.array(sorted(names), np.int64)
    rows = found.select("doc_id", "positive", F.array_sort(F.transform("w", lambda x: F.xxhash64(x))).alias("w")).toArrow()
    flat = np.searchsorted(keys, np.concatenate([*(c.flatten().to_numpy() for c in rows["w"].chunks), np.zeros(0, np.int64)]))
    sizes = np.concatenate([*(c.value_lengths().to_numpy() for c in rows["w"].chunks), np.zeros(0, np.int64)])
    side, ids = np.array(rows["positive"].to_pylist(), bool), np.array(rows["doc_id"].to_pylist(), np.int64)
    ends = np.cumsum(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (ids[i], int(sizes[i]), flat[ends[i] - sizes[i] : ends[i]].tobytes()))

    def rows_of(positive: bool) -> Rows:
        taken = [i for i in order if side[i] == positive]
        return Rows(np.concatenate([*(flat[ends[i] - sizes[i] : ends[i]] for i in taken), np.zeros(0, np.int64)]), sizes[taken])

    return fit(rows_of(True), rows_of(False), prior, [names[k] for k in keys])


def scored(docs: DataFrame, model: Toxicity, out: str = "score") -> DataFrame:
    def run(values: pa.Array) -> pa.Array:
        return pa.array([model.score(v.as_py()) for v in values], pa.float64())

    return batched(docs).withColumn(out, F.arrow_udf(run, "double")(F.col("text")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
