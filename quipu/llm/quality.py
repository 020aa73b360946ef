"""Operator 1: quality classifier, a sparse rule ensemble.

Statistics of each text (one pass in Python, numbers only come back) feed small boosted trees; every path from a root is a conjunctive
rule; lasso logistic regression keeps few of them; what is left is compiled into one Spark column expression over the statistics.
Learnt from at most LABELLED labelled rows (a deterministic share; the bound is a parameter).

Null texts count as empty ones and are scored too.  A document whose labels contradict each other teaches nothing; without any usable
label every score is 0.5; where the labelled rows are too few for any rule every score is the share of good ones.  A text is measured
whole, one at a time, however long it is.  Rows that repeat each get a row, and teach once each; texts with equal statistics tie, with
equal scores.  Empty tables give no rows.  Of a clashing column only the one named like the result is replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quipu.llm.common import batched, fresh, held_out, read, share, small

LABELLED, TREES, DEPTH, LASSO, THRESHOLD = 20_000, 40, 3, 0.002, 0.3
STATISTICS = ["chars", "words", "word_length", "letters", "upper", "digits", "symbols", "bars", "exclaims", "stops", "lines", "distinct_words", "top_word", "same_as_last", "distinct_sentences", "distinct_lines", "shout_words", "symbol_words"]
_GROUPS = {"letters": [*range(65, 91), *range(97, 123), *range(128, 256)], "upper": [*range(65, 91)], "digits": [*range(48, 58)], "symbols": [ord(c) for c in "#$%&*@^~<>=+{}[]\\/_`"], "bars": [ord("|")], "exclaims": [ord("!")], "stops": [ord(c) for c in ".,;:?"], "lines": [10]}
_SYMBOLS = bytes(_GROUPS["symbols"] + _GROUPS["bars"])


def text_statistics(text: str | None) -> list[float]:
    data = (text or "").encode()
    bins = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, np.int64)
    size, plain = max(1, len(data)), data.split()
    lowered = data.lower().split()
    n, counts = max(1, len(lowered)), Counter(lowered)
    shares = {k: float(bins[v].sum()) / size for k, v in _GROUPS.items()}
    shares["upper"] = float(bins[_GROUPS["upper"]].sum()) / max(1, float(bins[_GROUPS["letters"]].sum()))
    sentences, lines = [s for s in data.split(b".") if s.strip()], [s for s in data.split(b"\n") if s.strip()]
    return [
        float(np.log1p(len(data))), float(np.log1p(len(lowered))), sum(map(len, lowered)) / n, *shares.values(), len(counts) / n, max(counts.values(), default=0) / n,
        sum(map(eq, lowered, lowered[1:])) / n, len(set(sentences)) / max(1, len(sentences)), len(set(lines)) / max(1, len(lines)),
        sum(w.isupper() and len(w) > 1 for w in plain) / n, sum(w[-1] in _SYMBOLS or w[0] in _SYMBOLS for w in plain) / n,
    ]


def with_statistics(docs: DataFrame, out: str = "statistics") -> DataFrame:
    """docs and a struct of the statistics of their text."""

    def measure(values: pa.Array) -> pa.Array:
        rows = np.array([text_statistics(v.as_py()) for v in values], dtype=float).reshape(len(values), len(STATISTICS))
        return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(STATISTICS))], STATISTICS)

    kind = "struct<" + ",".join(f"{s}:double" for s in STATISTICS) + ">"
    return batched(docs).withColumn(out, F.arrow_udf(measure, kind)(F.col("text")))


@dataclass
class Rule:
    """A conjunction of (statistic, above, threshold) with its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.terms:
            out &= (x[:, f] > t) == above
        return out


def _grow(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, terms: tuple, rules: list, values: np.ndarray) -> None:
    """One regression tree on gradients; values gets each row's leaf value, rules every path."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-3, None)
    if depth and len(rows) >= 20:
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            cell = np.searchsorted(cut, x[rows, f], side="left")
            gs, hs, ns = (np.cumsum(np.bincount(cell, w, len(cut) + 1))[:-1] for w in (grad[rows], hess[rows], None))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < 5) | (len(rows) - ns < 5)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, float(cut[k])))
    if best[1] is None:
        values[rows] = -g / (h + 1)
        return
    f, t = best[1]
    above = x[rows, f] > t
    for side, part in ((False, rows[~above]), (True, rows[above])):
        path = (*terms, (f, side, t))
        rules.append(path)
        _grow(x, cuts, grad, hess, part, depth - 1, path, rules, values)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, step: float = 0.3) -> list[Rule]:
    cuts = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 64), method="nearest")) for c in x.T]
    logit, paths = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        values = np.zeros(len(y))
        _grow(x, cuts, p - y, p * (1 - p), np.arange(len(y)), depth, (), paths, values)
        logit += step * values
    return [Rule(terms) for terms in dict.fromkeys(tuple(sorted(set(p))) for p in paths)]


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = LASSO, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; the intercept is not penalised."""
    z1 = np.hstack([z, np.ones((len(z), 1))]).astype(np.float32)
    v = np.ones(z1.shape[1], np.float32)
    for _ in range(20):
        v = z1.T @ (z1 @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / max(1e-9, float(v @ (z1.T @ (z1 @ v))))
    w = ahead = np.zeros(z1.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z1 @ ahead.astype(np.float32)).astype(float)))
        new = ahead - step * (z1.T @ (p - y).astype(np.float32)).astype(float) / len(y)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (before - 1) / t * (new - w)
        w = new
    return w[:-1], float(w[-1])


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    intercept: float

    def score(self, statistics: str) -> Column:
        """The rules as one column expression over a struct of statistics."""
        total = F.lit(self.intercept)
        for r in self.rules:
            holds = F.lit(True)
            for f, above, t in r.terms:
                value = F.col(f"{statistics}.{STATISTICS[f]}")
                holds = holds & ((value > t) if above else (value <= t))
            total = total + F.when(holds, F.lit(r.weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    if not len(y) or y.min() == y.max():
        return RuleEnsemble([], 0.0 if not len(y) else 4.0 if y[0] else -4.0)
    rules = tree_rules(x, y)
    if not rules:
        return RuleEnsemble([], float(np.log(y.mean() / (1 - y.mean()))))
    weights, intercept = lasso_logistic(np.stack([r.holds(x) for r in rules], axis=1).astype(np.float32), y)
    return RuleEnsemble([Rule(r.terms, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6], intercept)


def labelled_sample(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, y) of the rows that may be learnt from, about `bound` of them at most; contradicting labels drop out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out(F.col("doc_id"), 5))
    once = usable.groupBy("doc_id").agg(F.min(column).alias("y"), F.max(column).alias("z")).filter("y = z").select("doc_id", "y")
    n = once.count()
    return once.filter(share(F.col("doc_id"), min(1.0, bound / max(1, n))))


def train(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> RuleEnsemble:
    sample = docs.select("doc_id", "text").join(small(labelled_sample(labels, "quality", bound), 4 * bound), "doc_id")
    rows = with_statistics(sample).select("doc_id", "y", "statistics.*").toPandas().sort_values(["doc_id", *STATISTICS], ignore_index=True)
    return fit(rows[STATISTICS].to_numpy(float), rows["y"].to_numpy(float))


def scored(docs: DataFrame, model: RuleEnsemble, out: str = "score") -> DataFrame:
    """docs and their score, which takes the place of a column of that name; every other column is kept, whatever its name."""
    held = fresh(docs, "statistics")
    return with_statistics(docs, held).withColumn(out, model.score(held)).drop(held)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
