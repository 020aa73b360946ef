"""Hand-made rows for reforms, lookups, records of several sources, streams with state, rates, sitemaps, names, the search box and the classifier."""

import datetime as dt
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quipu.functions import names
from quipu.operators import consolidate, lookup, rates, rules, searchbox, sitemaps, tree
from quipu.operators.reforms import reformed
from quipu.operators.vat import Catalogue, classified
from quipu.plans import catalogue, paths, vat
from quipu.sources import introspect
from quipu.sources.shared import shared_folder
from quipu.streaming import cached, dimension, mailbox, streams

SF = "/root/testdata/sf0.001"
CHANGE = "code string, step int, article int, line long, action string, text string, rate string, unit string, named array<string>"


def test_reforms_carry_records_and_name_conflicts(spark):
    base = spark.createDataFrame([("a", "Old text", "5", "kg"), ("b", "B", "10", "u"), ("d", "D", "1", None)], "code string, text string, rate string, unit string")
    none = [None] * 4
    changes = [
        ("a", 1, 1, 1, "says", "Old text", "5", "kg", None), ("a", 1, 1, 2, "set", "Old  text", "8", "kg", None), ("b", 1, 1, 3, "says", "B", "12", "u", None), ("x", 1, 1, 4, "says", *none), ("c", 1, 2, 5, "add", "C", "3", "u", None), ("c", 1, 2, 5, "add", "C", "3", "u", None),
        ("c", 2, 1, 6, "add", "C2", "4", "u", None), ("b", 2, 1, 7, "list", None, "9", None, ["rate"]), ("d", 2, 1, 8, "list", None, "2", "m", ["rate", "unit"]), ("b", 3, 1, 9, "set", "B again", "7", "u", None), (None, 1, 1, 10, "add", "lost key", "1", "u", None),
    ]
    out = reformed(base, spark.createDataFrame(changes, CHANGE), "code", ["text", "rate", "unit"], checked=["rate"], loose=["text"])
    state = {r.code: (r.text, r.rate, r.unit, r.step) for r in out.state.collect() if r.code}
    assert state == {"a": ("Old text", "8", "kg", 1), "b": ("B again", "7", "u", 3), "c": ("C", "3", "u", 1), "d": ("D", "2", "m", 2)}
    log = sorted((r.code, r.seq, r.step, r.kind, r.field, r.before, r.after) for r in out.log.collect() if r.code)
    assert log == [("a", 0, 1, "modify", "rate", "5", "8"), ("b", 0, 1, "delete", "", "B", None), ("b", 1, 3, "create", "", None, "B again"), ("c", 0, 1, "create", "", None, "C"), ("d", 0, 2, "list", "rate", "1", "2"), ("d", 1, 2, "list", "unit", None, "m")]
    assert {(r.code, r.step, r.kind, r.detail) for r in out.conflicts.collect()} == {("b", 1, "said_differs", "rate: 12 / 10"), ("b", 2, "listed_missing", None), ("c", 2, "added_exists", None), ("x", 1, "said_missing", None)}


def test_lookup_reads_one_list_of_postings(spark):
    products = [(1, "Arroz Mary Tradicional 1kg", "e1", "i1", dt.datetime(2026, 1, 1), True), (2, "Arroz Mary 1kg", "e1", "i2", dt.datetime(2026, 1, 2), True), (3, "Arroz Primor", "e2", None, dt.datetime(2026, 1, 3), True), (4, "Arroz Mary", "e3", "i4", dt.datetime(2026, 1, 4), False), (5, "Té", "e5", "i5", dt.datetime(2026, 1, 1), True)]
    products = spark.createDataFrame(products, "id long, text string, ean string, image string, seen timestamp, active boolean")
    queries = spark.createDataFrame([(1, "nothing like it", ["e9", "e1"]), (2, "Mary arroz", []), (3, "Arroz Primor", ["e2"]), (4, None, []), (5, "te", []), (6, "arroz mary", ["e3"]), (7, "", [])], "query_id long, text string, codes array<string>")
    found = lookup.reference_images(queries, products)
    assert {(r.query_id, r.id, r.by) for r in found.collect()} == {(1, 2, "code"), (2, 2, "name"), (5, 5, "name"), (6, 2, "name")}
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_consolidation_counts_what_differs_from_what_is_held(spark):
    rows = [("k", 1, "a", "", "2024-01"), ("k", 2, "b", "Name", "2024-03"), ("k", 3, "c", "Other", "2024-02"), ("k", 4, "c", "Name", None), ("m", 1, "a", None, None)]
    out = consolidate.consolidated(spark.createDataFrame(rows, "k string, n int, source string, name string, period string"), "k", ["n"], first=["name"], latest=["period"])
    got = {r.k: (r.name, r.period, r.name_conflicts, r.period_conflicts, r.sources) for r in out.collect()}
    assert got == {"k": ("Name", "2024-03", 1, 2, ["a", "b", "c"]), "m": (None, None, 0, 0, ["a"])}
    assert {(r.field, r.conflicts, r["keys"]) for r in consolidate.conflict_report(out, ["name", "period"]).collect()} == {("name", 1, 1), ("period", 2, 1)}


def test_kept_lookups_in_mixed_order(spark):
    """Found answers hold ten minutes, missing ones two; a failure gives the old answer; files come out of order by less than the lateness."""
    at = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, 1, at(0), False, "x"), (2, 1, at(9), False, "y"), (3, 1, at(11), True, None), (4, 1, at(12), False, None), (5, 1, at(13), False, "z"), (6, 1, at(15), False, "z"), (7, 2, at(1), True, None), (8, 2, at(2), False, "q"), (9, 9, at(60), False, None)]
    frame = spark.createDataFrame(rows, "request_id long, code long, at timestamp_ntz, failed boolean, value string")
    path = shared_folder(spark, "requests")
    for ids in ((2, 4, 8), (1, 7, 3), (6, 5), (9,)):
        frame.filter(F.col("request_id").isin(*ids)).coalesce(1).write.mode("append").parquet(path)
    stream = streams.file_stream(spark, path, frame.schema, 1)
    got = {r.request_id: (r.value, r.from_cache, r.stale) for r in streams.drained(cached.cached_lookups(stream, 600, 120, "30 minutes"), "kept").collect()}
    assert got == {1: ("x", False, False), 2: ("x", True, False), 3: ("x", False, True), 4: (None, False, False), 5: (None, True, False), 6: ("z", False, False), 7: (None, False, False), 8: ("q", False, False)}


def test_codes_of_one_group_keep_their_own_answers(spark):
    """Eleven codes and a missing one in two groups of state: each is found once, then answered from what is kept of it alone."""
    at = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    codes = [*range(10), 2**60 + 1, None]
    rows = [(2 * n + m, c, at(m), False, f"{c}-{m}") for n, c in enumerate(codes) for m in (0, 1)]
    path = shared_folder(spark, "requests")
    schema = "request_id long, code long, at timestamp_ntz, failed boolean, value string"
    for part in (rows, [(99, 3, at(120), False, None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    got = streams.drained(cached.cached_lookups(streams.file_stream(spark, path, schema, 1), 600, 120, "30 minutes", groups=2), "grouped").collect()
    assert sorted((r.request_id, r.code, r.value, r.from_cache) for r in got) == [(i, c, f"{c}-0", m == 1) for n, c in enumerate(codes) for m in (0, 1) for i in [2 * n + m]]


def test_a_batch_reads_the_version_that_is_there(spark):
    source, table, out, state = (shared_folder(spark, n) for n in ("source", "table", "out", "state"))
    put = lambda *ids: spark.createDataFrame([(i, i % 2) for i in ids], "id long, k long").coalesce(1).write.mode("append").parquet(source)
    put(1, 2)
    dimension.put_version(spark.createDataFrame([(0, "even"), (1, "odd")], "k long, name string"), table, 1)
    stream = streams.file_stream(spark, source, "id long, k long", 1)
    dimension.joined_by_version(stream, table, ["k"], out, state)
    dimension.put_version(spark.createDataFrame([(0, "pair")], "k long, name string"), table, 2)
    put(3)
    put(4)
    dimension.joined_by_version(stream, table, ["k"], out, state)
    dimension.joined_by_version(stream, table, ["k"], out, state)
    assert sorted((r.id, r.name, r.version) for r in spark.read.parquet(out).collect()) == [(1, "odd", 1), (2, "even", 1), (3, None, 2), (4, "pair", 2)]


def test_mailbox_cursors_survive_a_failure_and_a_reset(spark):
    folder = shared_folder(spark, "box")
    box = lambda *rows: spark.createDataFrame(rows, "mailbox long, validity int, uid long")
    first = box(*[(1, 7, u) for u in range(1, 6)], (2, 1, 10))
    assert mailbox.mailbox_pass(first, folder, 2)
    spark.createDataFrame([(1, 7, 99)], "mailbox long, validity int, uid long").write.parquet(f"{folder}/taken/pass=2")  # written, but its cursors never were
    mailbox.read_all(first, folder, 2)
    assert sorted((r.mailbox, r.uid, r["pass"]) for r in mailbox.taken(spark, folder).collect()) == [(1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 2), (1, 5, 3), (2, 10, 1)]
    mailbox.read_all(box((1, 8, 1), (1, 8, 2), (2, 1, 10), (2, 1, 11)), folder, 2)  # numbered anew: nothing old is read again
    mailbox.read_all(box((1, 8, 1), (1, 8, 2), (1, 8, 3), (2, 1, 11)), folder, 2)
    assert sorted((r.mailbox, r.uid) for r in mailbox.taken(spark, folder).filter("pass > 3").collect()) == [(1, 3), (2, 11)]
    assert not mailbox.mailbox_pass(box((1, 8, 3)), folder, 2)


def test_all_passes_of_a_mailbox_are_one_job(spark):
    """Forty passes write one folder of messages and one cursor a mailbox; numbers of passes go on from there."""
    folder = shared_folder(spark, "box")
    box = lambda n: spark.range(1, n + 1).select(F.lit(1).cast("long").alias("mailbox"), F.lit(7).alias("validity"), F.col("id").alias("uid"))
    mailbox.read_all(box(40), folder, 1)
    assert spark.read.schema(mailbox.CURSOR).parquet(f"{folder}/cursors").count() == 1
    assert spark.read.parquet(f"{folder}/taken").select("pass").distinct().count() == 1
    mailbox.read_all(box(43), folder, 2)
    assert sorted((r.uid, r["pass"]) for r in mailbox.taken(spark, folder).collect()) == [*((u, u) for u in range(1, 41)), (41, 41), (42, 41), (43, 42)]


def test_rates_by_the_day(spark):
    day = dt.date
    components = spark.createDataFrame([("g", 16, day(2026, 1, 1), day(2026, 6, 30), "one"), ("g", 12, day(2026, 7, 1), None, "two"), ("l", 15, day(2026, 3, 1), day(2026, 3, 31), "three")], "component string, percent int, since date, until date, instrument string").withColumn("percent", F.col("percent").cast("decimal(5,2)"))
    kinds = spark.createDataFrame([("general", ["g"]), ("both", ["g", "l"]), ("none", [])], "category string, components array<string>")
    days = spark.createDataFrame([(day(2026, 3, 31),), (day(2026, 4, 1),), (day(2026, 7, 1),), (day(2025, 1, 1),)], "day date")
    got = {(r.day.isoformat(), r.category): (float(r.percent), r.missing) for r in rates.component_totals(days, kinds, components).collect()}
    assert got[("2026-03-31", "both")] == (31.0, []) and got[("2026-04-01", "both")] == (16.0, ["l"]) and got[("2026-07-01", "general")] == (12.0, []) and got[("2025-01-01", "both")] == (0.0, ["g", "l"]) and got[("2026-04-01", "none")] == (0.0, []) and len(got) == 12
    laws = spark.createDataFrame([("L1", "text")], "law string, text string")
    options = spark.createDataFrame([(1, day(2026, 4, 1), "general", ["L2", "L1"], 10.0), (2, None, "general", [], 5.0), (3, day(2026, 4, 1), "unheard of", None, 5.0)], "item int, day date, category string, legal_base array<string>, amount double").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    out = {r.item: (r.percent and float(r.percent), r.texts, r.tax and float(r.tax)) for r in rates.option_details(options, kinds, components, laws).collect()}
    assert out == {1: (16.0, ["L2", "L1: text"], 1.6), 2: (None, [], None), 3: (None, [], None)}


def test_sitemaps_end_where_they_repeat(spark):
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    leaf = lambda *u: "<urlset>" + "".join(f"<url><loc>\n{x} </loc></url>" for x in u) + "</urlset>"
    documents = {"r": index("a", "b", "r", "gone"), "a": leaf("https://x/p/1?a=1&amp;b=2", "https://x/p/1?a=1&amp;b=2", "http://x/p/2", "https://x/other"), "b": index("a", "c"), "c": index("d", "r", "e"), "d": leaf("https://x/p/3", "https://x/p/1?a=1&amp;b=2"), "e": index("f"), "f": leaf("https://x/p/4")}
    docs = spark.createDataFrame(list(documents.items()), "url string, xml string")
    got = {(r.url, r.level) for r in sitemaps.crawled(docs, docs.filter("url = 'r'"), "^https://x/p/").collect()}
    assert got == {("https://x/p/1?a=1&b=2", 1), ("https://x/p/3", 3)}
    assert sitemaps.crawled(docs, docs.limit(0), "x").collect() == []


NAMES = {
    "Arroz 1,5 KG": "1500g", "Cerveza 24x330ml": "330ml", "Pastillas 500 mg x10": "10un+500mg", "Promo 2x1 Jugo 1L": "1000ml+1un", "Té x 20 sobres": "20sobre", "Tabletas x30 500mg": "30un+500mg", 'TV 32"': "32pulg", "Leche 900gr 900g": "900g", "Galleta 0 g": "",
    "Modelo A-12kg": "", "Aceite 0.9 lt": "900ml", "Huevos 30 unidades": "30un", "Vacío": "", "Jabón x3": "3un", "Kilo de azúcar": "",
}
WORDS = {"P.A.N. Harina de maíz blanco 1kg": "blanco harina maiz pan", "Galletas Marías 3 unidades": "galleta maria", "Refrescos sabores": "refresco sabor", "Gases x10": "gase", "QN55 TV": "qn tv", "a e y de": ""}


def test_names_are_told_apart(spark):
    rows = spark.createDataFrame([(n,) for n in [*NAMES, *WORDS]], "name string").select("name", names.pack_key(F.col("name")).alias("pack"), F.array_join(F.array_sort(names.name_words(F.col("name"))), " ").alias("words"), names.grams(F.col("name")).cast("double").alias("grams")).collect()
    got = {r.name: r for r in rows}
    assert {n: got[n].pack for n in NAMES} == NAMES
    assert {n: got[n].words for n in WORDS} == WORDS
    assert [got[n].grams for n in ("Arroz 1,5 KG", "Cerveza 24x330ml", "Galleta 0 g", "Leche 900gr 900g")] == [1500.0, None, None, 900.0]
    assert spark.sql("SELECT CAST(NULL AS STRING) AS name").select(names.pack_key(F.col("name")).alias("p")).first().p in (None, "")


def test_counts_and_digests_come_from_files(spark):
    got = {r.file: (r.bytes, r.sha256) for r in catalogue.QUERIES["file_digests"](spark, SF).collect()}
    for t in paths.TABLES:
        data = open(f"{SF}/{t}.parquet", "rb").read()
        assert got[f"{t}.parquet"] == (len(data), hashlib.sha256(data).hexdigest())
    plan = catalogue.QUERIES["table_catalogue"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<>") == len(paths.TABLES) and "ReadSchema: struct<l" not in plan


def test_a_file_that_no_task_may_read_whole_has_its_digest(spark, tmp_path, monkeypatch):
    """Files beyond what one value may hold (2 GB; here 20,000 bytes): the digest goes on from piece to piece."""
    noise = random.Random(5).randbytes(100_000)
    files = {
        "noise": noise, "ends": noise + b"\n", "returns": noise.replace(b"\n", b"\r\n") + b"\r", "feeds": b"\n" * 50_000, "marked": b"\xef\xbb\xbf" + noise, "marked and ended": b"\xef\xbb\xbf" + noise + b"\n", "starts": b"\n\n" + noise,
        "one line": bytes(70_000), "sparse": b"\n".join([bytes(30_000)] * 4), "x[1]{a}*": noise[::-1], "small": b"abc", "packed.gz": gzip.compress(noise[:15_000]),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    settings = {"spark.sql.sources.binaryFile.maxLength": "20000", "spark.sql.files.maxPartitionBytes": "8192", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k, None) for k in settings}
    monkeypatch.setattr(introspect, "WHOLE", 10_000, raising=False)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r.file: (r.bytes, r.sha256) for r in introspect.file_digests(spark, [str(tmp_path)]).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in files.items()}


def test_each_query_of_the_box_has_its_paths(spark):
    ways = searchbox.routed(spark.createDataFrame([(1, " v-12345678-9 "), (2, "01.02"), (3, "rgl_ABCD12"), (4, "1234"), (5, "!!"), (6, None), (7, "Ring gear")], "query_id long, q string"))
    assert {(r.query_id, r.path, r.term) for r in ways.collect()} == {(1, "tax_id", "V123456789"), (1, "rule", "v 12345678 9"), (2, "code", "0102"), (2, "rule", "01 02"), (3, "key", "abcd12"), (3, "rule", "rgl abcd12"), (4, "code", "1234"), (4, "key", "1234"), (4, "rule", "1234"), (7, "rule", "ring gear")}


def _items(spark, *rows):
    schema = "item long, code string, publication string, tags array<string>, product string, name string, operation string, day date, context map<string,double>"
    return spark.createDataFrame([(i, c, p, t, pr, n, op, dt.date(2026, 1, 1), x) for i, (c, p, t, pr, n, op, x) in enumerate(rows)], schema)


def test_the_classifier_by_hand(spark):
    rows = [
        (None, None, [], None, None, "sale", {}), ("999", None, None, None, "nothing known", "sale", {}), (None, None, [], None, "a ring", "sale", {"size": 30.0}), (None, None, [], None, "a ring", "sale", {"size": 3.0}), (None, None, [], None, "a ring", "import", {"size": 3.0}),
        (None, "book", [], None, None, "import", {}), ("0001", None, [], None, "a ring", "sale", {"size": 3.0}), (None, None, ["PROMO", "ECONOMY"], None, None, "sale", {"price": 5.0}), (None, None, [], "red one", "small", "sale", {"price": 999.0}),
    ]
    got = {r["item"]: r for r in classified(_items(spark, *rows), vat.catalogue(spark)).collect()}
    options = lambda i: [(o.category, o.condition, o.rules) for o in got[i].options]
    assert [got[i].state for i in (0, 1)] == ["undetermined"] * 2 and got[0].confidence == 0.0 and got[0].options == []
    assert options(2) == [("general", None, ["r1"])] and (got[2].state, got[2].confidence) == ("decided", 0.75)
    assert options(3) == [("general", None, ["r1"]), ("exempt", "small", ["r1"])] and (got[3].state, got[3].confidence) == ("conditional", 0.6)
    assert options(4) == [("general", None, ["r1"])] and got[4].suspended and set(got[4].options[0].legal_base) == {"law-63", "law-17", "decree-3", "law-18-1"}
    assert got[5].options[0].category == "general" and got[5].confidence == 0.95
    assert options(6) == [("exempt", None, ["r3", "r1"])] and got[6].confidence == 0.99 and not got[6].conflict  # both have `exempt`, the code's rule has nothing else
    assert [o[0] for o in options(7)] == ["reduced"] and got[7].rules == ["r2"]
    assert got[8].conflict and got[8].confidence == pytest.approx(0.48) and {o[0] for o in options(8)} == {"reduced", "luxury"}
    assert isinstance(vat.catalogue(spark).with_priority("r4", 30), Catalogue)


def test_names_of_many_products_are_compared_once(spark):
    rows = [(i, "red bolt large" if i % 2 else "red bolt small", None, "x", i % 7, True) for i in range(200)] + [(900, None, None, "x", 99, True), (901, "blue nut", None, "x", 1, True)]
    products = spark.createDataFrame(rows, "id long, text string, ean string, image string, seen int, active boolean").withColumn("seen", F.date_add(F.lit("2024-01-01").cast("date"), F.col("seen")))
    queries = spark.createDataFrame([(1, "red bolt small", []), (2, "bolt red large", []), (3, "nut", []), (4, "screw", [])], "query_id long, text string, codes array<string>")
    assert {(r.query_id, r.id, r.by) for r in lookup.reference_images(queries, products).collect()} == {(1, 6, "name"), (2, 13, "name"), (3, 901, "name")}
    names = products.select(F.col("text").alias("name"))
    assert lookup.alike(queries, names).count() == 3  # pairs of a text and a name, not of a text and a product
    assert lookup.holding_all_words(queries, products).count() == 201


def test_residual_rule_keeps_one_row_for_each_of_equal_codes(spark):
    codes = spark.createDataFrame([(1, "100000"), (2, "100000"), (3, "200000")], "part long, code string")
    known = spark.createDataFrame([("100000", 14), ("100000", 14)], "code string, rule int")
    got = rules.residual(codes, known, "code", 16).select("part", "rule", "percent", "state").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 14, None, None), (2, 14, None, None), (3, None, 16, "conditional")]


def test_an_address_listed_at_two_levels_has_both_of_them(spark, tmp_path):
    pages = [(0, "http://a.example/en/1?x=1&y=2"), (14, "http://a.example/en/1?x=1&y=2"), (15, "http://a.example/en/9"), (1, "http://a.example/de/1")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalogue.QUERIES["nested_sitemaps"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("http://a.example/en/1?x=1&y=2", 2), ("http://a.example/en/1?x=1&y=2", 3)]


def test_of_reforms_on_one_line_the_first_in_place_goes_first(spark):
    base = spark.createDataFrame([("a", "5"), ("b", "5"), ("c", "5")], "code string, size string")
    changes = [(c, 1, 1, 7, action, size, ["size"], place) for c, action in (("a", "set"), ("b", "says"), ("c", "list")) for size, place in (("42", 3), ("11", 9), ("42", 8), ("77", 6))]
    frame = spark.createDataFrame(changes, "code string, step int, article int, line long, action string, size string, named array<string>, place long")
    for n in (1, 3, 8):
        out = reformed(base, frame.repartition(n, "size", "place"), "code", ["size"], ["size"])
        assert {(r.code, r.size) for r in out.state.collect()} == {("a", "42"), ("c", "11")}
        assert [(r.code, r.detail) for r in out.conflicts.collect()] == [("b", "size: 42 / 5")]
        assert [(r.before, r.after) for r in out.log.filter("code = 'c'").orderBy("seq").collect()] == [("5", "42"), ("42", "77"), ("77", "11")]


def test_partitions_of_a_code_tree_grow_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr(tree, "ROWS", 7)
    nodes = spark.createDataFrame([(i, f"{i // 10:04}{i % 10}0", 1 if i % 10 == 0 else 2) for i in range(40)], "seq int, code string, level int")
    out = tree.code_tree(nodes, stem=4, levels=2)
    assert "hashpartitioning(heading" in (plan := out._jdf.queryExecution().executedPlan().toString()) and ", 6), REPARTITION_BY_NUM" in plan
    got = {r.seq: (r.parent, r.by_indent, r.terminal, r.agrees) for r in out.collect()}
    assert got[0] == (None, None, False, True) and got[13] == ("000100", "000100", True, True) and len(got) == 40
