"""Stems, full-text scores, tariff detection, store pages, printed tariffs, versions and lock-outs on small hand-made cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from quipu.functions.stems import stem, stems
from quipu.operators import detection, merge, rules, search, state
from quipu.sources import readers


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("cepillos", "cepill"), ("dientes", "dient"), ("chicas", "chic"), ("chaparrones", "chaparron"), ("rapidamente", "rapid"), ("actividades", "activ"), ("comprandoselas", "compr"), ("blanqueado", "blanqu"),
        ("torneada", "torn"), ("che", "che"), ("toreado", "tor"), ("distribuciones", "distribu"), ("paguen", "pag"), ("y", "y"), ("", ""), ("1234", "1234"),
    ],
)
def test_stems(word, want):
    assert stem(word) == want


def test_scores_phrase_fields_stop_words_and_nulls(spark):
    docs = spark.createDataFrame([("1", "Cepillos", "de dientes", None), ("2", "Dientes", "para cepillos", "x"), ("3", None, None, None)], "code string, a string, b string, c string")
    postings = search.index(docs, "code", [F.col("a"), F.col("b"), F.col("c")], "spanish")
    asked = search.terms(spark.createDataFrame([(1, "cepillo de diente"), (2, "de la"), (3, None)], "q int, t string"), ["q"], F.col("t"), "spanish")
    got = search.best(search.scores(asked, ["q"], postings, "code"), ["q"], "code", 5).orderBy(F.desc("phrase")).collect()
    assert [(r.q, r.code, r.phrase, r.coverage, r.in_a, r.in_b) for r in got] == [(1, "1", True, 1.0, 1, 1), (1, "2", False, 1.0, 1, 1)]


def _detected(spark, texts, **more):
    codes = [("1006301000", "Arroz", "blanqueado"), ("1006302000", "Arroz", "partido"), ("1905100000", "Pan", "crujiente"), ("9801000000", "Cafe", "especial"), ("0901210000", "Cafe", "tostado")]
    table = spark.createDataFrame(codes, "code string, a string, b string")
    groups = [("arroz", ["arroz"], ["con leche"], ["100630"], 50), ("pan", ["pan"], [], ["1905"], 50), ("harina", ["harina ... maiz", "harina"], [], ["1905", "1006"], 60)]
    known = spark.createDataFrame(groups, "group string, terms array<string>, excluded array<string>, prefixes array<string>, priority int")
    postings = search.index(table, "code", [F.col("a"), F.col("b")])
    queries = spark.createDataFrame(list(enumerate(texts)), "query int, text string")
    got = detection.detect(queries, known, postings, table.select("code"), [4, 6], {"blanco": "blanqueado"}, special=["98", "99"], **more).orderBy("query", "place")
    return [(r.query, r.code, r.confidence, r.reasons, r.state) for r in got.collect()]


def test_detection_by_dictionary_text_and_neither(spark):
    got = _detected(spark, ["Arroz blanco", "arroces", "arroz", "panes", "arroz con leche", "harina de maiz", "cafe tostado", None, "nada"])
    assert got == [
        (0, "1006301000", 0.8, "arroz", "decided"), (0, "1006302000", 0.45, "arroz", "decided"),
        (2, "1006301000", 0.55, "arroz", "conditional"), (2, "1006302000", 0.55, "arroz", "conditional"),
        (3, "1905100000", 0.9, "pan", "decided"),
        (5, "1006301000", 0.55, "harina", "conditional"), (5, "1006302000", 0.55, "harina", "conditional"), (5, "1905100000", 0.55, "harina", "conditional"),
        (6, "0901210000", 0.55, "text", "conditional"),
    ]


def test_detection_by_category(spark):
    by = spark.createDataFrame([(0, "pan"), (0, "pan")], "query int, group string")
    assert _detected(spark, ["tostadas"], by_category=by) == [(0, "1905100000", 0.85, "pan", "decided")]


def test_enclosing_objects_skip_braces_in_strings_and_unclosed_ones():
    assert readers.enclosing_objects('{"a":{"k":[1],"t":"}{\\""},"k":[2]}', '"k":[') == ['{"k":[1],"t":"}{\\""}', '{"a":{"k":[1],"t":"}{\\""},"k":[2]}']
    assert readers.enclosing_objects('"k":[ {"k":[', '"k":[') == [] == readers.enclosing_objects(None, "x")


def test_further_stores(spark):
    def offers(platform, body):
        return [(r.id, r.name, r.brand, r.price, r.in_stock) for r in readers.store_offers(spark.createDataFrame([(body,)], "body string"), platform).collect()]

    assert offers("arigato", '{"parent_id":{"groups":[{"doclist":{"docs":[{"id":"7","name":"TV","brand":"B","price":9.5,"stock":0},{"id":"8"}]}},{"doclist":{"docs":[]}}]}}') == [("7", "TV", "B", 9.5, False)]
    assert offers("kromi", '{"item":[{"code":"1","name":"Te PRS","price":10,"priceO":0,"impuesto":16,"stock":2,"c_codmoneda":{"simbolo":"$"}},{"code":"2","name":"x","price":1,"c_codmoneda":{"simbolo":"Bs"}}]}') == [("1", "Te", None, 11.6, True)]
    assert offers("readdy", '[{"code":"a","name":"N","price_retail1":"2.50","stock_sede3":1},{"code":"b","name":"M","price_retail1":"0"}]') == [("a", "N", None, 2.5, True)]
    card = '<div class="producto"><a href="x"></a><p class="nombre-producto"> <a href="y">Pan &amp; te</a></p><p class="precio-producto"><h5>$ 1.234,50</h5></p><input name="id_producto" value="12"></form>'
    assert [(r.id, r.name, r.price, r.in_stock) for r in readers.html_offers(spark.createDataFrame([(card,)], "html string"), "alacena").collect()] == [("12", "Pan & te", 1234.5, True)]


def test_printed_tariff(spark):
    text = "0101.21.00.00   - -  Reproductores de   \n      raza pura        5      u\n 0101.29.00.00   - - Los demas    10BK     kg N\n\n no more\n0102.10 Sub"
    got = readers.printed_tariff(spark.createDataFrame([(text,), (None,), ("",)], "text string")).orderBy("code").collect()
    assert [tuple(r) for r in got] == [("0101.21.00.00", "- - Reproductores de raza pura", "5", "u"), ("0101.29.00.00", "- - Los demas", "10BK", "kg N")]


def test_printed_tariff_reads_five_lines_below_a_code(spark):
    text = "0101.21.00.00   - uno\n  dos\n  tres\n  cuatro\n  cinco\n  seis    2,5    X    kg met.am.\n  siete    9    u\n0102.21.00.00  Todo   BIT   15   u\n  12 ABC\n0103.10 x"
    got = readers.printed_tariff(spark.createDataFrame([(text,)], "text string")).orderBy("code").collect()
    assert [tuple(r) for r in got] == [("0101.21.00.00", "- uno dos tres cuatro cinco seis", "2,5", "kg met.am."), ("0102.21.00.00", "Todo BIT", "15", "u")]


def test_versions_edits_and_golden_cases(spark):
    history = spark.createDataFrame([("r", 1, '{"p":1,"n":null}'), ("s", 3, '{"p":2,"n":"x"}')], "k string, version int, after string")
    table = spark.createDataFrame([("r", 1, None), ("s", 2, "y"), ("t", 5, None)], "k string, p int, n string")
    got = merge.edited(history, table, "k", "7+e1").orderBy("k").collect()
    assert [(r.k, r.version, r.before, r.after, r.catalogue) for r in got] == [("s", 4, '{"p":2,"n":"x"}', '{"p":2,"n":"y"}', "7+esv4"), ("t", 1, None, '{"p":5,"n":null}', "7+etv1")]
    assert [tuple(r) for r in rules.broken_cases(table, table.filter("k <> 't'").withColumn("p", F.lit(1)), "k").orderBy("k").collect()] == [("s", '{"p":2,"n":"y"}', '{"p":1,"n":"y"}'), ("t", '{"p":5}', None)]


def test_lock_out_after_failures_and_its_end(spark):
    at = dt.datetime(2024, 1, 1)
    plan = [(0, True), (1, False), (2, True), (3, True), (4, False), (13, True), (30, False), (31, True)]
    df = spark.createDataFrame([(u, at + dt.timedelta(minutes=m), i, bad) for u in (1, None) for i, (m, bad) in enumerate(plan)], "u int, ts timestamp, i int, bad boolean")
    got = state.lock_outs(df, ["u"], "ts", "i", F.col("bad"), 2, 600).orderBy("u", "i").collect()
    assert [(r.outcome, r.failures) for r in got] == 2 * [("failed", 1), ("in", 0), ("failed", 1), ("failed", 2), ("locked", 2), ("failed", 3), ("in", 0), ("failed", 1)]


def test_robots_longest_pattern_decides(spark):
    from quipu.operators.agenda import allowed

    said = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(a).alias("allow")) for p, a in (("/a", False), ("/a/b", True), ("/c", False), ("/c", True), ("/*.x$", False), ("", False))])
    paths = spark.createDataFrame([("/a",), ("/a/b1",), ("/c",), ("/q.x",), ("/q.xy",), ("/zxx",)], "p string")
    assert [r[0] for r in paths.select(allowed(F.col("p"), said)).collect()] == [False, True, True, False, True, True]


def test_asof_finds_rows_in_far_stretches_and_null_keys(spark):
    from quipu.operators import asof

    day = dt.date
    left = spark.createDataFrame([(k, day(y, 6, 1), y) for k in ("a", None) for y in (1960, 1999, 2020)], "k string, d date, y int")
    right = spark.createDataFrame([(k, day(y, 6, 1), y) for k in ("a", None) for y in (1980, 1999)] + [("b", day(2019, 1, 1), 7)], "k string, d date, v int")

    def got(join, strict=False):
        return {(r.k, r.y): r.v for r in join(left, right, "d", ["k"], ["v"], strict=strict).collect()}

    assert got(asof.asof_backward) == {(k, y): v for k in ("a", None) for y, v in ((1960, None), (1999, 1999), (2020, 1999))}
    assert got(asof.asof_backward, True) == {(k, y): v for k in ("a", None) for y, v in ((1960, None), (1999, 1980), (2020, 1999))}
    assert got(asof.asof_forward) == {(k, y): v for k in ("a", None) for y, v in ((1960, 1980), (1999, 1999), (2020, None))}


def test_items_that_say_the_same_share_one_vector_and_all_of_them_are_ranked(spark):
    rows = [(f"{i:03}", *[("LARGE", "red ring", "b 1"), ("LARGE", "red  Ring", "b 1"), ("SMALL", "red ring", None), (None, "ring ring", ""), ("LARGE", None, "red")][i * i % 5]) for i in range(60)]
    items = spark.createDataFrame(rows, "code string, a string, b string, c string")
    asked = search.terms(spark.createDataFrame([("large red ring",), ("ring ring",), ("small",)], "query string"), ["query"], F.col("query"))
    per_item = search.scores(asked, ["query"], search.index(items, "code", [F.col("a"), F.col("b"), F.col("c")]), "code")
    for limit in (1, 8, 40):
        want = search.best(per_item, ["query"], "code", limit).collect()
        got = search.best_items(asked, ["query"], items, "code", ["a", "b", "c"], limit)
        assert sorted(map(tuple, got.select(per_item.columns).collect())) == sorted(map(tuple, want))
    assert "BroadcastHashJoin" not in per_item._jdf.queryExecution().executedPlan().toString()  # postings of small files can be many


def test_stems_of_odd_rows_keep_their_places(spark):
    rows = [(1, ["cepillos", "dientes", "cepillos"]), (2, []), (3, None), (4, ["chicas", None])]
    got = spark.createDataFrame(rows, "id int, w array<string>").coalesce(1).select("id", stems(F.col("w")).alias("s"))
    assert {r.id: r.s for r in got.collect()} == {1: ["cepill", "dient", "cepill"], 2: [], 3: None, 4: ["chic", None]}
    assert got.filter("false").count() == 0
    assert stems.evalType == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF  # a batch stays in Arrow's buffers
