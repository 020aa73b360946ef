"""Operators 11 to 13 against brute force on odd rows: nulls, empty and long texts, ties, repeated rows, clashing columns, hot groups."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quipu.llm import divergence, resampling, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, score double, rank string, weight int, spans string, value string"


def docs_of(spark, rows):
    """(doc_id, text, lang, source) and columns that are named like results."""
    return spark.createDataFrame([(*r, 0.5, "r", 7, "s", "v") for r in rows], SCHEMA)


ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "Ñandú ñandú THE the 12 x_y", "en", "a"), (3, "Ñandú ñandú THE the 12 x_y", "en", "a"), (3, "another text of the same id", "en", "b"), (None, "no id here, the end", "en", None),
    (7, " ".join(f"w{i % 50}" for i in range(3000)), "fr", "b"), (8, "x" * 500 + " tail " + "é" * 90, "fr", "b"), (9, "\x00\x7f \U0001f600 日本語", "", ""), (10, " ".join(["tie"] * 25), "en", "c"), (11, " ".join(["tie"] * 25), "en", "c"),
]


def lower(text):
    return "".join(c.lower() if c < "\x80" else c for c in text or "")


# --- 11


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def features(text):
    w = word_list(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def resample(rows, target, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)) for texts in ([r[1] for r in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    scored = []
    for doc_id, text, *_ in rows:
        found = features(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        scored.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((i for i, r in enumerate(rows) if len(word_list(r[1])) >= least), key=lambda i: (-scored[i][3], scored[i][0] is None, scored[i][0], scored[i][1]))
    rank = {i: n + 1 for n, i in enumerate(order[: percent * len(order) // 100])}
    return Counter((*x, rank.get(i)) for i, x in enumerate(scored))


def test_resampling_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = ODD + [(100 + i, " ".join(rng.choice(["Red", "green", "blue,", "ñu", "4x", "the"], rng.integers(0, 60))), "en", "a") for i in range(60)]
    target = [(1, "red the ñu red the"), (2, None), (3, "")]
    got = resampling.resampled(docs_of(spark, rows), spark.createDataFrame(target, "item_id long, text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == resample(rows, [x for _, x in target])


def test_resampling_of_nothing(spark):
    docs, none = docs_of(spark, ODD), spark.createDataFrame([], "item_id long, text string")
    assert resampling.resampled(docs.limit(0), none).collect() == []
    assert Counter(map(tuple, resampling.resampled(docs, none).collect())) == resample(ODD, [])


def test_byte_automaton():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("aZ9 _é,日"), rng.integers(0, 300))) for _ in range(40)] + ["", "q" * 5000, "é" * 70]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    low, starts, stops, text = resampling.word_spans(data, ends)
    assert [(int(t), low[a:b].tobytes().decode()) for t, a, b in zip(text, starts, stops)] == [(i, w) for i, t in enumerate(texts) for w in word_list(t)]
    found, of, words = resampling.feature_buckets(data, ends, 10_000)
    assert Counter(zip(of.tolist(), found.tolist())) == Counter((i, zlib.crc32(f.encode()) % 10_000) for i, t in enumerate(texts) for f in features(t))
    assert words.tolist() == [len(word_list(t)) for t in texts]


# --- 12


def without_repeats(rows, width=50):
    first = {}
    for doc_id, text, *_ in rows:
        b = (text or "").encode()
        for i in range(len(b) - width + 1):
            if doc_id is not None:
                first[b[i : i + width]] = min(first.get(b[i : i + width], doc_id), doc_id)
    out = Counter()
    for doc_id, text, *_ in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            if doc_id is not None and first[b[i : i + width]] < doc_id:
                gone[i : i + width] = True
        spans, i = [], 0
        for a in np.flatnonzero(gone[:-1] & ~np.append(False, gone[:-2] if len(b) > 1 else gone[:0])) if len(b) else []:
            z = a
            while gone[z]:
                z += 1
            spans.append((int(a), int(z)))
        out[doc_id, len(b), tuple(spans), bytes(b[i] for i in range(len(b)) if not gone[i])] += 1
    return out


def found_repeats(docs):
    return Counter((r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept)) for r in suffixes.without_repeats(docs).collect())


def passages(seed, n):
    rng = np.random.default_rng(seed)
    say = lambda k: "".join(rng.choice(list("abcdeé "), k))
    shared = [say(k) for k in (30, 49, 50, 51, 80, 300)]
    rows = []
    for i in range(n):
        parts = [say(rng.integers(0, 80))]
        for _ in range(rng.integers(0, 4)):
            parts += [shared[rng.integers(0, len(shared))], say(rng.integers(0, 30))]
        rows.append((int(rng.integers(0, 2 * n)), "".join(parts), "en", "a"))
    return rows + [(5000 + i, shared[5][:200], "en", "a") for i in range(10)] + [(7, "a" * 400, "en", "a"), (8, "b" + "a" * 120, "en", "a"), (9, "a" * 60 + "c" * 60, "en", "a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_against_brute_force(spark, seed):
    """Ids repeat with other texts, passages of 49 to 51 bytes, runs of one letter, whole copies, nulls."""
    rows = ODD + passages(seed, 150) + [(None, "y" * 120, "en", "a"), (6, "y" * 120, "en", "a")]
    assert found_repeats(docs_of(spark, rows)) == without_repeats(rows)


def test_suffix_dedup_in_small_runs_and_buckets(spark, monkeypatch):
    """A frequent phrase among other words in every text: its anchors have many kinds of stretches and are dealt out."""
    rng = np.random.default_rng(9)
    say = lambda k: "".join(rng.choice(list("klmnopqrst"), k))
    phrase = "all rights reserved by the holders of this text"
    rows = [(i, f"{say(40)} {phrase}{' and' if i % 3 else ' or'} {say(40)} {phrase} {say(12)}", "en", "a") for i in range(300)]
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 4000)
    docs = docs_of(spark, rows).repartition(7)
    assert found_repeats(docs) == without_repeats(rows)


def test_suffix_dedup_of_nothing(spark):
    docs = docs_of(spark, ODD)
    assert suffixes.without_repeats(docs.limit(0)).collect() == []
    short = [r for r in ODD if len((r[1] or "").encode()) < 50]
    assert found_repeats(docs_of(spark, short)) == without_repeats(short)


def test_multikey_order():
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 4, 500) for _ in range(3)]
    order = suffixes.multikey_order(words)
    assert [tuple(w[i] for w in words) for i in order] == sorted(zip(*words, strict=True))
    assert not len(suffixes.multikey_order([np.zeros(0, np.int64)] * 2))


def test_a_stretch_depends_on_its_bytes_alone():
    """Equal windows have one anchor wherever they stand, so a passage gives the same stretches in any surroundings."""
    rng = np.random.default_rng(1)
    passage, seen = rng.integers(0, 9, 300).astype(np.uint8), []
    for k in (0, 1, 7, 90):
        data = np.concatenate([rng.integers(0, 9, k).astype(np.uint8), passage, rng.integers(0, 9, 60).astype(np.uint8)])
        _, start, windows, key, whole = suffixes.stretches(data, np.array([len(data)]))
        seen.append({(int(s) - k, int(w), int(a), int(b)) for s, w, a, b in zip(start, windows, key, whole) if s - k >= 30 and s - k + w + 49 <= 270})
        assert windows.sum() == len(data) - 49
    assert seen[0] and all(x == seen[0] for x in seen)


# --- 13


def audit(rows, least=3, scale=1_000_000_000, top=200):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(r[1]))) for r in rows]
    df, total, group = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        df[lang].update(set(words))
        total[lang].update(words)
        group[lang, source].update(words)
    out = Counter()
    for lang, source in group:
        kept = [w for w in df[lang] if df[lang][w] >= least]
        p = lambda c: {w: 1 + scale * (c[w] + 1) // (sum(c[x] for x in kept) + len(kept)) for w in kept}
        mine, whole = p(group[lang, source]), p(total[lang])
        f = lambda a, b: (a - b) ** 2 // b
        pairs = [(s, sum(f(mine[w], q[w]) for w in kept)) for (g, s), c in group.items() if g == lang and s != source for q in [p(c)]]
        terms = [(w, f(mine[w], whole[w])) for w in kept if group[lang, source][w] > 0 and mine[w] > whole[w]]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                out[lang, source, part, item, value, rank] += 1
    return out


def test_divergence_against_brute_force(spark):
    """Groups without terms, languages without kept terms, ties, repeated rows, more terms than are listed."""
    rng = np.random.default_rng(6)
    names = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "uvwxyzñÄ日"] + ["The", "the"]
    rows = ODD + [(i, " ".join(rng.choice(names, rng.integers(0, 200))), rng.choice(["en", "fr"]), rng.choice(list("abcd"), p=[0.7, 0.1, 0.1, 0.1])) for i in range(120)]
    rows = [(i, t, str(x) if x is not None else None, str(s) if s is not None else None) for i, t, x, s in rows] + [(1, "rare", "de", "a"), (2, "rarer", "de", "b"), (3, None, "en", "silent")]
    got = divergence.divergence(docs_of(spark, rows), terms=60)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = audit(rows, top=60)
    assert Counter(map(tuple, got.collect())) == want
    assert ("de", "a", "pair", "b", 0, 1) in want and any(k[:3] == ("en", "silent", "pair") for k in want) and max(k[5] for k in want) == 60


def test_divergence_of_nothing(spark):
    assert divergence.divergence(docs_of(spark, ODD).limit(0)).collect() == []


def test_counts_are_sent_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 5)
    assert Counter(map(tuple, divergence.divergence(docs_of(spark, ODD * 3)).collect())) == audit(ODD * 3)
