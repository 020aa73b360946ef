"""Edge tables, brute force, round trips and held-out accuracy of the training-data operators."""

import binascii
import hashlib
import io
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quipu.llm import brown, decontam, langid, licences, media, mixing, neardup, pii, quality, queries, tagger, toxicity
from quipu.llm.common import share_cut, small, stored
from quipu.llm.graph import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and very long texts, repeated rows, a column whose name clashes with results; and the same tables empty."""
    words = [f"word{i % 97}{'abcdef'[i % 6]}" for i in range(40_000)]
    rows = [
        (1, None, None, None, None, 0.5), (2, "", "en", "a", 0, 0.5), (3, "Hello  there\tgeneral kenobi you are bold one today", "en", "a", 40, None),
        (3, "Hello  there\tgeneral kenobi you are bold one today", "en", "a", 40, None), (4, " ".join(words), "fr", "a", 1, 0.1), (5, " ".join([*words, "extra"]), "fr", "b", 1, 0.1),
        (None, "lost id text mail me at x.y@z.org or +1 (555) 123-4567", "en", None, 9, 0.1), (7, "\U0001f600 ñandú Ölçü", None, "b", 3, 0.1), (8, "Ünïcode 10.0.0.255 and 4111 1111 1111 1111", "de", "c", 5, 0.0),
    ]
    out = {}
    for kind, docs in (("odd", rows), ("empty", [])):
        d = str(tmp_path_factory.mktemp(kind))
        spark.createDataFrame(docs, DOCS).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, 0, 1), (None, 1, 1), (7, None, None), (3, 1, 0)] if docs else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "general KENOBI you"), (2, None), (3, ""), (4, " ".join(words[100:130]))] if docs else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out[kind] = (d, docs)
    return out


#: The queries with a row for each document row.
BY_ROW = {name: query for name, query in queries.QUERIES.items() if name != "op13_source_divergence"}


@pytest.mark.parametrize("kind", ["odd", "empty"])
@pytest.mark.parametrize("name", list(BY_ROW))
def test_edge_tables(spark, odd, name, kind):
    """One row per document row, whatever is null, empty, long or repeated."""
    d, docs = odd[kind]
    got = queries.QUERIES[name](spark, d).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in docs)


def test_edge_values(spark, odd):
    """Defined results for null, empty, very long, repeated and tied rows, by operator."""
    d, docs = odd["odd"]
    got = {name: [r.asDict() for r in q(spark, d).collect()] for name, q in BY_ROW.items()}
    of = lambda name, i: [r for r in got[name] if r["doc_id"] == i]
    for name, rows in got.items():
        assert len({str(r) for r in of(name, 3)}) == 1, f"{name}: equal rows differ"
    for name in ("op1_quality", "op10_toxicity"):
        assert all(0 <= r["score"] <= 1 for r in got[name]) and of(name, 1)[0]["score"] == of(name, 2)[0]["score"]
    assert all(r["digest"] is None and not r["is_license"] for i in (1, 2) for r in of("op2_licences", i))
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in of("op3_decontamination", 3)] == [(9, 3, True)] * 2
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["n_near"]) for r in (of("op3_decontamination", 1) + of("op3_decontamination", 2))] == [(0, 0, 0, 0)] * 2
    long = of("op3_decontamination", 4)[0]
    assert long["n_words"] == 40_000 and long["n_items"] == 1 and long["n_hit"] > 30
    assert {r["size"] for r in of("op4_mixing", 4)} == {40_000} and all(r["taken"] == 0 for i in (1, 2) for r in of("op4_mixing", i))
    assert [(r["lang_pred"], r["score"]) for i in (1, 2) for r in of("op5_language_id", i)] == [("und", 0.0)] * 2
    assert all(r["n_tokens"] == 1 for i in (1, 2) for r in of("op6_brown_lm", i)) and of("op6_brown_lm", 4)[0]["n_tokens"] == 40_001
    assert all(r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"])) for r in got["op6_brown_lm"])
    assert [r["n_email"] + r["n_phone"] for r in of("op7_pii", None)] == [2] and [(r["n_ip"], r["n_card"]) for r in of("op7_pii", 8)] == [(1, 1)]
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got["op8_near_duplicates"]}
    assert near[1] == (0, 1, True) and near[2] == (0, 2, True) and near[5][1:] == (4, False) and near[None][1:] == (None, True)
    assert all((r["n_bytes"], r["payload_bytes"]) == (0, 64) for i in (1, 2) for r in of("op9_media", i))


CLASHES = "_score _statistics _n _size _nth _copies row key_id key_hash node copy statistics items bands text_ n_words hit".split()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_keep_clashing_columns(spark, odd, name, stage):
    d, docs = odd["odd"]
    frame = spark.read.parquet(f"{d}/documents.parquet")
    wide = frame.select("*", *(F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")).alias(c) for c in CLASHES))
    out = stage(spark, wide, d)
    assert out.columns == ([c for c in wide.columns if c != "copy"] + ["copy"] if name == "source_mixing" else wide.columns)
    rows = out.collect()
    assert rows and all(r[c] == f"{c}{r.doc_id or 0}" for r in rows for c in CLASHES if not (c == "copy" and name == "source_mixing"))


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_edge_tables(spark, odd, kind):
    d, docs = odd[kind]
    out = corpus_pipeline.run(spark, d)
    assert out.columns == [*[c.split()[0] for c in DOCS.split(", ")], "copy"]
    assert set(r.doc_id for r in out.collect()) <= {r[0] for r in docs}


def test_languages_need_letters(spark, odd):
    """Signs of numbers are no letters; marks and scripts don't matter."""
    texts = ["½ ² 12", "Ⅷ ①", "〇", "_ -", "é", "a½", "the same words"]
    docs = spark.createDataFrame([(10 + i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.train(spark.read.parquet(f"{odd['odd'][0]}/documents.parquet").select("doc_id", "text", "lang"))
    got = {r.doc_id - 10: r.lang_pred for r in langid.predict(docs, model).collect()}
    assert [got[i] == "und" for i in range(len(texts))] == [True, True, True, True, False, False, False]


def test_shares_are_exact_at_any_size():
    for n in (3000, 3e9, 5e10, 1e15):
        cut = share_cut(1500 / n)
        assert (cut + 2**63) / 2**64 == pytest.approx(1500 / n, rel=1e-3)
    assert share_cut(1.0) == 2**63 - 1 and share_cut(0.0) == -(2**63)


def test_small_checks_rows_and_bytes(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    hinted = lambda x: "broadcast" in x._jdf.queryExecution().logical().toString().lower()
    assert hinted(small(df, 100)) and not hinted(small(df, 99)) and not hinted(small(df, 100, 50_000))


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on its own input, at sf0.01."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {name: None for name, _ in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, sf), name)
        before[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()])
        docs = out
    ids = lambda rows: sorted(r["doc_id"] for r in rows)

    given, kept = before["quality_classifier"]
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    x = np.array([quality.text_statistics(r["text"]) for r in given])
    logit = model.intercept + sum(r.weight * r.holds(x) for r in model.rules)
    assert ids(kept) == sorted(r["doc_id"] for r, v in zip(given, logit, strict=True) if 1 / (1 + np.exp(-v)) >= quality.THRESHOLD) and len(kept) < len(given)

    given, kept = before["near_duplicates"]
    found = _components(_sets([(r["doc_id"], r["text"]) for r in given], 5))
    assert ids(kept) == sorted(i for i, c in found.items() if i == c) and len(kept) < len(given)

    given, kept = before["decontamination"]
    items = [w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (w := _item_words(r.text))]
    windows = {tuple(w[s : s + 13]) for w in items for s in range(max(1, len(w) - 12))}
    sizes, clean = {len(w) for w in windows}, []
    for r in given:
        w, hit = _item_words(r["text"]), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append(r["doc_id"])
    assert ids(kept) == sorted(clean)

    given, kept = before["personal_data"]
    after = {r["doc_id"]: r["text"] for r in kept}
    assert ids(kept) == ids(given)
    for r in given:
        assert not any((r["text"] or "")[a:b] in after[r["doc_id"]] for _, a, b in pii.base_spans(r["text"] or ""))
        if not pii.base_spans(r["text"] or "") and not pii.TRIGGER.search(r["text"] or ""):
            assert after[r["doc_id"]] == r["text"]

    given, kept = before["source_mixing"]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals, taken, largest = Counter(), Counter(), Counter()
    for r in given:
        totals[r["source"]] += size(r["text"])
        largest[r["source"]] = max(largest[r["source"]], size(r["text"]))
    for r in kept:
        taken[r["source"]] += size(r["text"])
    target = _targets(totals)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in totals)
    copies = Counter((r["doc_id"], r["copy"]) for r in kept)
    assert max(copies.values()) == 1 and {c for _, c in copies} <= {1, 2}


def _item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))


def _targets(totals):
    """Targets of the sources by repeated resharing."""
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(totals, key=lambda s: (s is None, s)))}
    left, target, open_ = 1.5 * sum(totals.values()), {}, set(totals)
    while open_:
        part = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if part * weight[s] > 2 * totals[s]}
        if not over:
            target |= {s: part * weight[s] for s in open_}
            break
        target |= {s: 2 * totals[s] for s in over}
        left, open_ = left - sum(2 * totals[s] for s in over), open_ - over
    return target


def test_sql_agrees(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.SQL.items():
        got, want = queries.QUERIES[name](spark, SF), con.execute(sql)
        order = [c[0] for c in want.description]
        assert Counter(map(tuple, got.select(order).collect())) == Counter(want.fetchall()), name


def _sets(texts, k):
    out = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower() if (t or "").isascii() else "".join(c.lower() if c < "\x80" else c for c in t or ""))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def _components(sets):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if 100 * min(len(sets[a]), len(sets[b])) >= 80 * max(len(sets[a]), len(sets[b])) > 0:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_near_duplicates_against_brute_force(spark, sf):
    sets = _sets([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], 4)
    found = _components(sets)
    got = neardup.op8_near_duplicates(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), c, i == c) for i, c in found.items()}


def test_texts_of_one_template_make_no_pairs(spark):
    """At similarity 0.6 every two of them share a bucket, but no rare shingle; a near copy of one is still found."""
    shared = [f"t{i}" for i in range(225)]
    rows = [(i, " ".join([*shared, *(f"x{i}_{j}" for j in range(75))])) for i in range(600)] + [(600, " ".join([*shared, *(f"x7_{j}" for j in range(74)), "other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = neardup.signatures(docs, 4)
    sets = neardup.full_sets(docs.join(signed.select("doc_id", "node"), "doc_id"), 4)
    assert neardup.prefix_pairs(signed.select("node", F.col("node").alias("root")), sets, signed.select("node", "n", "sketch"), 80).count() == 1
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 4).filter("NOT kept").collect()} == {600: 7}


def test_repeated_and_null_ids_keep_their_links(spark):
    rng = np.random.default_rng(2)
    one, two = ([f"{x}{i}" for i in rng.integers(0, 9999, 120)] for x in "ab")
    near = lambda words, i: " ".join([*words[: 7 * i], f"e{i}", *words[7 * i + 1 :]])
    rows = [(5, " ".join(one)), (5, " ".join(two)), (9, near(one, 1)), (10, near(two, 2)), (None, near(one, 3)), (None, "two words"), (None, "two words"), (None, None), (7, ""), (5, " ".join(one))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((str(r.doc_id), r.component_id, r.kept) for r in neardup.near_duplicates(docs, 4).collect())
    assert got == Counter([("5", 5, True), ("5", 5, True), ("5", 5, True), ("9", 5, False), ("10", 5, False), ("None", 5, False), ("None", None, True), ("None", None, True), ("None", None, True), ("7", 7, True)])
    for _ in range(2):
        left = Counter((r.doc_id, r.text) for r in neardup.deduplicated(docs, 4).collect())
        assert left == Counter([(5, rows[0][1]), (5, rows[1][1]), (None, "two words"), (None, None), (7, "")])


def test_near_copies_that_the_centre_misses_are_linked(spark):
    """A chain of edits: neighbours are linked, the ends are not."""
    rng = np.random.default_rng(1)
    base, rows = [f"w{i}" for i in rng.integers(0, 9999, 120)], []
    for i in range(60):
        base = base.copy()
        base[rng.integers(0, 120)] = f"e{i}"
        rows.append((i, " ".join(base)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r.component_id for r in got} == {0}


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, 50), (50, 75)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 10 for i in range(11, 41)} | {100: 50, 75: 50}


def test_mixing_meets_targets_and_repeats(spark):
    got, again = (mixing.op4_mixing(spark, SF).collect() for _ in range(2))
    assert sorted(map(str, got)) == sorted(map(str, again))
    taken, largest, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source], target[r.source] = max(largest[r.source], r.size), r.target
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)
    totals = Counter()
    for r in got:
        totals[r.source] += r.size
    assert target == pytest.approx(_targets(totals))


def test_equal_rows_of_the_mix_are_units_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 7)
    rows = [(None, "a", 3)] * 50 + [(1, "a", 5), (2, None, 4), (2, None, 4)]
    got = Counter((r.doc_id, r.source, r["size"], r.nth) for r in mixing.numbered(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect())
    assert got == Counter([(None, "a", 3, i + 1) for i in range(50)] + [(1, "a", 5, 1), (2, None, 4, 1), (2, None, 4, 2)])


def test_mixed_documents_take_the_planned_copies(spark):
    docs = spark.createDataFrame([(i % 7 or None, f"{'w ' * (i % 3 + 1)}{i}", "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
    plan = mixing.mix(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))).collect()
    want, got = Counter(), Counter()
    for r in plan:
        want[r.doc_id, r.source, r["size"]] += r.copies
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id, r.source, len(r.text.split())] += 1
    assert got == want and max(Counter((r.text, r.copy) for r in mixing.mixed_documents(docs).collect()).values()) == 1


def test_settle_keeps_words_and_leaves_one_open():
    rng = np.random.default_rng(3)
    sizes, parts = rng.integers(1, 500, 300).astype(float), rng.random(300)
    out = mixing.settle(sizes, parts, np.random.default_rng(0))
    assert sizes @ out == pytest.approx(sizes @ parts)
    assert ((out > 0) & (out < 1)).sum() <= 1


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    share = lambda rows, right: np.mean([right(r) for r in rows])
    q = [r for r in quality.op1_quality(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert share(q, lambda r: r.predicted == labels[r.doc_id].quality) > 0.95
    t = [r for r in toxicity.op10_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert share(t, lambda r: r.predicted == labels[r.doc_id].toxic) > 0.9
    g = [r for r in langid.op5_language_id(spark, sf).collect() if r.held_out and langs[r.doc_id]]
    assert share(g, lambda r: r.lang_pred == langs[r.doc_id]) > 0.97


def test_brown_base_score_and_gain(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    toks = {i: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t)), "\n"] for i, t in docs}
    held = {i: binascii.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    counts = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = brown.op6_brown_lm(spark, SF).collect()
    for r in got:
        want = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks[r.doc_id])
        assert r.base_score == pytest.approx(want) and r.train_tokens == n and r.n_tokens == len(toks[r.doc_id]) and r.n_known == sum(counts[w] > 0 for w in toks[r.doc_id]) and r.held_out == held[r.doc_id]
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(0)
    of, flow = np.repeat([0, 1, 2], 10), np.array([[0, 90, 5], [5, 0, 90], [90, 5, 0]])
    found = brown.exchange(rng.poisson(flow[of][:, of]).astype(float), 3)
    assert all(len(set(found[of == c])) == 1 for c in range(3)) and len(set(found)) == 3


def test_best_classes_against_the_likelihood():
    rng = np.random.default_rng(3)
    of, k = rng.integers(0, 4, 30), 4
    bigrams = rng.poisson(2.0, (30, 30)).astype(float)

    def table(of):
        out = np.zeros((k, k))
        np.add.at(out, (of[:, None], of[None, :]), bigrams)
        return out

    def likelihood(of):
        t = table(of)
        return (t * np.log(t)).sum() - (t.sum(1) * np.log(t.sum(1))).sum() - (t.sum(0) * np.log(t.sum(0))).sum()

    cells = np.zeros((30, 2 * k + 1))
    for w in range(30):
        others = np.arange(30) != w
        cells[w, :k] = np.bincount(of[others], bigrams[w, others], k)
        cells[w, k : 2 * k] = np.bincount(of[others], bigrams[others, w], k)
        cells[w, 2 * k] = bigrams[w, w]
    word, cell = np.nonzero(cells)
    want = [max(range(k), key=lambda c, w=w: likelihood(np.where(np.arange(30) == w, c, of))) for w in range(30)]
    assert brown.best_classes(table(of), of, word, cell, cells[word, cell]).tolist() == want


@pytest.mark.parametrize("frequent", [200_000, 40])
def test_words_beyond_the_seed_get_the_class_of_their_neighbours(spark, monkeypatch, frequent):
    """Two kinds of words alternate; their endings say nothing, and only a few of them are seed words."""
    monkeypatch.setattr(brown, "FREQUENT", frequent)
    rng = np.random.default_rng(4)
    kinds = [[f"{x}{i}zz" for i in range(60)] for x in "ab"]
    weights = 1 / np.arange(1, 61)
    texts = [" ".join(kinds[i % 2][rng.choice(60, p=weights / weights.sum())] for i in range(40)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = brown.train(docs, words=8, endings=5, classes=4)
    look = model.lookup
    cls = {w.decode(): int(look.cls[i]) for w, i in look.frequent.items()} | {bytes(r.token).decode(): r.cls for r in model.counts.collect()}
    assert all(w in cls for x in kinds for w in x) and not {cls[w] for w in kinds[0]} & {cls[w] for w in kinds[1]}


def test_texts_are_taken_apart_by_arrow_as_by_hand(monkeypatch):
    """Tokens come as one Arrow array of different ones and codes, whatever white space, letters, empty texts and sizes of runs there are."""
    texts = [None, "", " ", "\x0b\x0c", " a  B\ta\r\n", "É é A\x1fb\x85c\xa0d\u2028e", "".join(map(chr, range(1, 0x300))), "x" * 50, "one two one", "\n"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(11)), pa.array(["left out", *texts])], ["i", "text"]).slice(1)
    for size in (1, 20, 1 << 20):
        monkeypatch.setattr(brown, "PART", size)
        got = [[] for _ in texts]
        for part, codes, row, found in brown._batches(iter([batch]), 1):
            assert isinstance(found, pa.BinaryArray) and len(set(found.to_pylist())) == len(found) and found[-1].as_py() == brown.END
            for r, c in zip(row, codes, strict=True):
                got[part.column(0)[r].as_py() - 1].append(found[int(c)].as_py())
        assert got == [brown.tokens(t) for t in texts]
    units = brown.Units({b"one": 2, b"two": 3}, {b"ne": 4, b"x": 5, b"\xa9": 6, b"xx": 7})
    words = [brown.END, b"one", b"two", b"none", b"x", b"yx", b"xxx", "é".encode(), b"\xa9", b"ne", b"z"]
    assert units.of_all(pa.array(words, pa.binary())).tolist() == [units.of(w) for w in words]
    assert not len(units.of_all(pa.array([], pa.binary()))) and units.of_all(pa.array([brown.END], pa.binary())).tolist() == [0]


@pytest.mark.parametrize("frequent", [200_000, 40])
def test_contexts_send_a_row_a_word_not_a_cell(spark, monkeypatch, frequent):
    """What a task sends on grows with its different words, not with their neighbours; the counts are those of all neighbours."""
    monkeypatch.setattr(brown, "FREQUENT", frequent)
    sent = []
    monkeypatch.setattr(brown, "moved", lambda cells, lookup, table, f=brown.moved: sent.append((cells, lookup, len(table))) or f(cells, lookup, table))
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{i}{'xyz'[i % 3]}" for i in rng.integers(0, 80, 50)) for _ in range(60)]
    brown.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), words=8, endings=5, classes=4)
    (cells, look, k), want, got = sent[0], Counter(), Counter()
    seed = lambda w: int(look.unit_class[look.units.of(w)])
    flat = [brown.END, *(w for t in texts for w in brown.tokens(t))]
    for a, b in zip(flat[:-1], flat[1:], strict=True):
        moves = [x != brown.END and x not in look.units.words for x in (a, b)]
        want.update([(a, 2 * k)] if a == b and moves[0] else [x for x, m in zip(((a, seed(b)), (b, k + seed(a))), moves, strict=True) if m and a != b])
    rows, names = cells.collect(), list(look.frequent)
    for r in rows:
        for c, n in zip(np.frombuffer(r.cells, np.int16), np.frombuffer(r.n, np.int32), strict=True):
            got[names[r.place] if r.token is None else bytes(r.token), int(c)] += int(n)
    assert got == want and len(rows) == len({w for w, _ in want})


#: The contract's patterns, leftmost and without retries.
PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def test_base_spans_against_the_patterns(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["a@b.c@d.e 1.2.3.4.5.6.7.8 0000000000001.2.3.4 256.1.1.1", "+1 (555) 123-4567+4 4 4 4111-1111-1111-1111 5", "x@y z@@w.de é@q.org"]
    for t in texts:
        want = [(k, m.start(), m.end()) for k, p in PATTERNS for m in re.finditer(p, t) if k == "email" or pii.valid(k, m.group())]
        assert pii.base_spans(t) == want


#: Data in notations that no base pattern reads, as they are planted below.
WRITTEN = [
    ("email", "maria dot lopez at example dot org"), ("email", "jo77 [at] mailhost [dot] net"), ("email", "petra(at)firma.de"), ("email", "user at host dot org"), ("email", "sales @ shop.com"),
    ("phone", "(415) 555-0132"), ("phone", "415-555-0132"), ("phone", "415.555.0132"), ("phone", "four one five five five five zero one three two"), ("phone", "001 415 555 0132"),
    ("card", "4111.1111.1111.1111"), ("card", "5500/0000/0000/0004"), ("ip", "10[.]0[.]12[.]255"), ("ip", "192 . 168 . 1 . 77"), ("ip", "172 dot 16 dot 254 dot 1"),
]


def test_pii_query_adds_planted_spans_and_keeps_the_base(spark, tmp_path):
    """The query's own columns: counts, digest and base spans against the patterns; added spans against what was planted."""
    rng, planted, rows = np.random.default_rng(9), {}, []
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect():
        text = r.text or ""
        if len(text) > 600 and not pii.TRIGGER.search(text):
            kind, datum = WRITTEN[len(planted) % len(WRITTEN)]
            spaces = [m.end() for m in re.finditer(" ", text)]
            at = spaces[int(rng.integers(5, len(spaces) - 5))]
            text, planted[r.doc_id] = f"{text[:at]}{datum} {text[at:]}", (kind, at, at + len(datum))
        rows.append((r.doc_id, text))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts, caught, exact, wrong = dict(rows), 0, 0, 0
    for r in pii.op7_pii(spark, str(tmp_path)).collect():
        want = [(k, m.start(), m.end()) for k, p in PATTERNS for m in re.finditer(p, texts[r.doc_id]) if k == "email" or pii.valid(k, m.group())]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert set(want) <= set(spans)
        kind, a, b = planted.get(r.doc_id, ("", 0, 0))
        added = [s for s in spans if s not in want]
        caught += any(s[0] == kind and s[1] < b and a < s[2] for s in added)
        exact += (kind, a, b) in added
        wrong += sum(not (s[0] == kind and s[1] < b and a < s[2]) for s in added)
    assert len(planted) > 300 and caught > 0.85 * len(planted) and exact > 0.75 * len(planted) and wrong < 0.05 * caught


def test_skipped_windows_change_no_span(spark):
    """Random taggers over texts with and without data: what is read equals what a decoding of every window reads."""
    rng = np.random.default_rng(3)
    texts = [(r.text or "")[:1500] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(80).collect()]
    pieces = [d for _, d in WRITTEN] + ["FOUR ONE FIVE FIVE FIVE FIVE ZERO ONE THREE TWO", "one.two.three.four.five.six.seven.eight.nine", "Jo At Mail\nDoT Org", "x( [at] )y.z", "look at home. The", "a@b", "12", "a-at-b-dot-c", "9" * 80, "w" * 90, "\u00b2", "seven", "+1 (555) 123-4567", "me@here.org"]
    texts += [" ".join(pieces[int(i)] for i in rng.integers(0, len(pieces), rng.integers(1, 12))) for _ in range(150)] + ["", " ", "1"]
    base, spans = [pii.base_spans(t) for t in texts], 0
    for seed in range(3):
        model = tagger.new_params(pii.SYMBOLS, pii.TAGS, 4, 6, seed)
        model["o"][1 + 2 * seed : 3 + 2 * seed] += 1
        got = pii.added_spans(texts, base, model)
        assert got == pii.added_spans(texts, base, model, lambda t, *_: list(range(pii._windows(len(t)))))
        spans += sum(map(len, got))
    assert spans > 100


def test_any_spelling_that_passes_the_checks_is_read(monkeypatch):
    """A tagger that calls every character part of one phone number, or of one address."""
    for kind, datum in (("phone", "FOUR ONE FIVE FIVE FIVE FIVE ZERO ONE THREE TWO"), ("phone", "four.one.five/five.five.five/zero.one.three.two"), ("email", "Jo aT mail DoT org")):
        begin, text = 1 + 2 * pii.KINDS.index(kind), f"{'word ' * 30}{datum} {'word ' * 30}"
        a = text.index(datum)
        places = {pii.encode(text[w * pii.STRIDE : w * pii.STRIDE + pii.READ]).tobytes(): w * pii.STRIDE for w in range(pii._windows(len(text)))}
        gold = pii.tags_of(len(text), [(kind, a, a + len(datum))])
        monkeypatch.setattr(tagger, "decode", lambda model, codes, links, places=places, gold=gold: np.array([gold[(s := places[c.tobytes()]) : s + pii.READ] for c in codes]))
        assert begin in gold and pii.added_spans([text], [[]], {}) == [[(kind, a, a + len(datum))]]


def test_redaction_hides_spans():
    text = "write to a.b@c.org or +1 (555) 123-4567 now"
    assert pii.redact(text, pii.base_spans(text)) == "write to [EMAIL] or [PHONE] now"
    assert pii.redact(None, []) is None


def test_crf_gradient():
    p, rng = tagger.new_params(5, 3, 3, 4, 0), np.random.default_rng(0)
    codes, gold = rng.integers(0, 5, (2, 6)), rng.integers(0, 3, (2, 6))
    p = {k: v.astype(np.float64) for k, v in p.items()}
    _, g = tagger.loss_and_gradients(p, codes, gold)
    for k in ("A", "Wf", "Ub", "E"):
        at = np.unravel_index(int(np.argmax(np.abs(g[k]))), g[k].shape)
        p[k][at] += 1e-3
        up = tagger.loss_and_gradients(p, codes, gold)[0]
        p[k][at] -= 2e-3
        down = tagger.loss_and_gradients(p, codes, gold)[0]
        p[k][at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(g[k][at], rel=0.05)


def test_media_round_trip(spark):
    for r in media.op9_media(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        data = (r.text or "").encode()
        padded = data.ljust(max(1, -(-len(data) // 64)) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), binascii.crc32(padded[-64:]))
        form = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
        grid = np.frombuffer(padded, np.uint8).reshape(-1, 64).astype(float)
        assert r.tile_sha256 == hashlib.sha256(r.tile).hexdigest() and np.abs(np.load(io.BytesIO(r.tile))[:, :, 0] - _cell_means(grid, 16, 16)).max() <= 0.5 + 1e-6
        dark = np.rint(_cell_means(grid, 8, 9) * 256)
        assert r.feature == np.packbits(dark[:, :-1] < dark[:, 1:]).tobytes().hex()


def _cell_means(grid, height, width):
    """Area means by the overlap of each source row and column with each cell."""
    def overlap(n, m):
        a, b = np.arange(n), np.linspace(0, n, m + 1)
        return np.clip(np.minimum(a[None] + 1, b[1:, None]) - np.maximum(a[None], b[:-1, None]), 0, None)

    rows, columns = overlap(len(grid), height), overlap(grid.shape[1], width)
    return rows @ grid @ columns.T / (len(grid) / height * grid.shape[1] / width)


def test_area_resize_is_the_mean_of_cells():
    image = np.random.default_rng(0).integers(0, 255, (9000, 12, 3)).astype(np.uint8)
    want = image.reshape(3, 3000, 4, 3, 3).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 3, 4), want)


def test_decoders():
    assert media.decode(b"P3 # c\n2 1 255\n1 2 3 4 5 6\n").tolist() == [[[1, 2, 3], [4, 5, 6]]]
    assert media.decode(b"P4\n3 1\n\xa0")[:, :, 0].tolist() == [[0, 255, 0]]
    bmp = b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") + (1).to_bytes(4, "little") + b"\x01\x00\x18\x00" + bytes(24) + b"\x03\x02\x01\x00"
    assert media.decode(bmp).tolist() == [[[1, 2, 3]]]


def test_licence_spellings_meet(spark):
    mit = dict(licences.KNOWN)["MIT"]
    other = "Copyright (c) 2020 Jane\n" + mit.replace("License", "LICENCE").replace(", ", " ,  ")
    docs = spark.createDataFrame([(1, other), (2, mit + " more"), (3, None), (4, "...")], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licences.licence_scan(docs, licences.known_licences(spark)).collect()}
    assert got == {1: "MIT", 2: None, 3: None, 4: None}


def test_licence_query_finds_whole_texts(spark, tmp_path):
    """Through the query: standard texts with holders, wrapped lines and curly quotes, and texts that only mention a licence."""
    title, body = dict(licences.KNOWN)["MIT"].split("\n\n", 1)
    whole = dict(licences.whole_texts())
    texts = [
        ("MIT", f"{title}\n\nCopyright (c) 2020 Jane Doe. All rights\nreserved.\n\n{body}"), ("MIT", f"Copyright [yyyy] [name of copyright owner]\n\n{body}"),
        ("MIT", body.replace('"Software"', "\u201cSoftware\u201d").replace('"AS IS"', "\u201cAS IS\u201d")), ("GPL-3.0", whole["GPL-3.0"].upper()), ("MPL-2.0", "  ".join(whole["MPL-2.0"].split())),
        (None, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0."), (None, None),
    ]
    spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.license_id for r in licences.op2_licences(spark, str(tmp_path)).collect()} == {i: name for i, (name, _) in enumerate(texts)}


def test_whole_licences_and_copyright_clauses(spark):
    mit, whole = dict(licences.KNOWN)["MIT"], dict(licences.whole_texts())
    title, body = mit.split("\n\n", 1)
    texts = [
        ("MIT", f"{title}\n\nCopyright Jane Doe, 2020\n\n{body}"), ("MIT", f"Copyright (c) 2020 Jane Doe {body}"), ("MIT", f"{title} Copyright 2019-2020 by Doe, Inc. All rights reserved. {body}".replace("\n", " ")),
        ("MIT", f"Copyright Foundation and other contributors\n{body}"), (None, f"Copyright 2020 Jane Doe"),
        *[(name, text) for name, text in licences.whole_texts()],
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2021, Jane Doe\n" + next(t for n, t in licences.whole_texts() if n == "BSD-3-Clause" and t.startswith("Copyright")).split("\n", 1)[1]), ("Apache-2.0", "\n".join(" ".join(p.split()) for p in whole["Apache-2.0"].split("\n\n"))),
    ]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licences.licence_scan(docs, licences.known_licences(spark)).collect()}
    assert [got[i] for i in range(len(texts))] == [name for name, _ in texts]
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-SA-4.0"} <= set(whole)


def test_decontamination_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r.doc_id for r in decontam.contamination(docs, bench).filter("contaminated").collect()}
    kept = {r.doc_id for r in decontam.decontaminated(docs, bench).collect()}
    assert bad and kept == {r.doc_id for r in docs.select("doc_id").collect()} - bad


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x blue"), (2, "red x x x x x x blue red"), (3, "blue"), (4, "green blue blue x x x red red x x blue")], "doc_id long, text string")
    terms = spark.createDataFrame([("red",), ("blue",), ("green",)], "term string")
    groups = spark.createDataFrame([("a", ["blue", "red"]), ("b", ["green"])], "group_id string, terms array<string>")
    index = decontam.postings(docs, terms).filter(F.col("term") != decontam.LENGTH).drop("doc_id")
    found = lambda within: sorted((r.group_id, r.key_id) for r in decontam.proximity_matches(index, groups, within).collect())
    assert found(4) == [("a", 1), ("a", 2), ("a", 4), ("b", 4)] and found(2) == [("a", 2), ("b", 4)]


def test_brown_score_against_the_formulas(spark):
    """Class transitions and word emissions by hand, from the classes that training gave."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{i}{'xyz'[i % 3]}" for i in rng.integers(0, 300, 30)) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (60, "w1y never w2z"), (61, None)], "doc_id long, text string")
    learnt = docs.filter("doc_id < 50")
    model = brown.train(learnt, words=20, endings=3, classes=5)
    coded = brown.encoded(docs, model)
    got = {r.doc_id: r.score for r in brown.score(coded, coded.filter("doc_id < 50"), model).collect()}
    look = model.lookup
    cls = {w: int(look.cls[i]) for w, i in look.frequent.items()} | {bytes(r.token): r.cls for r in model.counts.collect()}
    of = lambda w: cls.get(w, int(look.unit_class[look.units.of(w)]))
    k, end, counts, table = len(model.types_in), of(brown.END), Counter(), Counter()
    for t in texts[:50]:
        words = brown.tokens(t)
        counts.update(words)
        table.update(zip([end, *map(of, words)], map(of, words)))
    tokens, types = [sum(n for w, n in counts.items() if of(w) == c) for c in range(k)], [sum(of(w) == c for w in counts) for c in range(k)]
    total = sum(tokens)
    for i, t in [*enumerate(texts), (60, "w1y never w2z"), (61, None)]:
        want, last = 0.0, end
        for w in brown.tokens(t):
            c = of(w)
            prior = (tokens[c] + 0.5) / (total + 0.5 * k)
            want += np.log10((table[last, c] + 2 * prior) / (sum(table[last, x] for x in range(k)) + 2)) + np.log10((counts[w] + 0.1) / (tokens[c] + 0.1 * (types[c] + 1)))
            last = c
        assert got[i] == pytest.approx(want)


def test_rule_expression_agrees_with_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.STATISTICS)))
    model = quality.fit(x, (x[:, 1] + x[:, 3] > 1).astype(float))
    logit = model.intercept + sum(r.weight * r.holds(x) for r in model.rules)
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *quality.STATISTICS])
    got = rows.select("i", F.struct(*quality.STATISTICS).alias("s")).select(model.score("s").alias("v"), "i").orderBy("i").collect()
    assert np.allclose([r.v for r in got], 1 / (1 + np.exp(-logit)))
    assert np.mean(((1 / (1 + np.exp(-logit))) > 0.5) == (x[:, 1] + x[:, 3] > 1)) > 0.9


def test_language_backoff_and_undetermined(spark):
    rows = [(i, "the house stands alone", "en") for i in range(20)] + [(i, "la maison reste seule", "fr") for i in range(20, 40)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "houses"), (2, "maisons"), (3, "123"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(asked, model).collect()} == {1: "en", 2: "fr", 3: "und", 4: "und"}
    assert model.names == ["en", "fr"]
