"""Golden rows of functions, merges, folds, readers and writers."""

import datetime as dt
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quipu.functions import numbers as N
from quipu.functions import text as T
from quipu.operators import asof, merge, offers, quality, state
from quipu.plans import domain
from quipu.sources import readers, writers
from quipu.sources.shared import shared_folder


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(("expr", "value", "want"), [
    (T.normal, "Café  CON-leche Ñandú", "cafe con leche nandu"), (T.normal, None, None), (T.normal, "", ""),
    (T.pack_size, "Arroz 1,5 kg", "1500g"), (T.pack_size, "Agua 600ml", "600ml"), (T.pack_size, "Agua", None),
    (T.amount, "Bs. 1.234,56", Decimal("1234.5600")), (T.amount, "$1,234.56", Decimal("1234.5600")), (T.amount, "gratis", None),
    (T.canonical_url, "https://a.b/c?utm_source=x&id=1#top", "https://a.b/c?id=1"), (T.canonical_url, "ftp://a", None), (T.host, "https://www.A.com:80/x", "a.com"),
    (T.own_reply, "Yes.\nOn Monday Ann wrote:\n> hi", "Yes."), (T.mail_class, "Out of office", "auto"),
    (N.gtin_valid, "4006381333931", True), (N.gtin_valid, "4006381333932", False), (N.isbn10_valid, "080442957X", True), (N.issn_valid, "03785955", True),
])
def test_scalars(spark, expr, value, want):
    assert one(spark, expr, value) == want


def test_tax_id(spark):
    assert one(spark, N.tax_id, "j-00002961-0").asDict() == {"id": "J000029610", "kind": "J", "verified": True, "valid": True}
    assert one(spark, N.tax_id, "J-00002961-1").valid is False
    assert one(spark, N.tax_id, "C123456789").asDict() == {"id": "C123456789", "kind": "C", "verified": False, "valid": True}
    assert one(spark, N.tax_id, None).asDict() == {"id": None, "kind": None, "verified": False, "valid": False}


def test_similarity_of_word_and_two_words(spark):
    assert round(one(spark, lambda c: T.similarity(c, F.lit("two words")), "word"), 4) == 0.3636
    assert one(spark, lambda c: T.similarity(c, F.lit("")), "") == 0.0


def test_asof_takes_the_next_business_rate_and_stops_at_the_tolerance(spark):
    day = dt.date
    rates = spark.createDataFrame([("USD", day(2026, 1, 5), 10.0), ("USD", day(2026, 1, 9), 11.0)], "cur string, d date, rate double")
    asked = spark.createDataFrame([(1, "USD", day(2026, 1, 3)), (2, "USD", day(2026, 1, 5)), (3, "USD", day(2026, 1, 10)), (4, "EUR", day(2026, 1, 3)), (5, "USD", day(2025, 12, 1))], "id int, cur string, d date")
    got = {r.id: r.rate for r in asof.asof_forward(asked, rates, "d", ["cur"], ["rate"], 10).collect()}
    assert got == {1: 10.0, 2: 10.0, 3: None, 4: None, 5: None}
    back = {r.id: r.rate for r in asof.asof_backward(asked, rates, "d", ["cur"], ["rate"], strict=True).collect()}
    assert back == {1: None, 2: None, 3: 11.0, 4: None, 5: None}


def test_upsert_keeps_old_values_where_asked(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, v string, first string")
    b = spark.createDataFrame([(1, "a2", "y"), (3, "c", "z")], "k int, v string, first string")
    got = {r.k: (r.v, r.first, r.change) for r in merge.upsert(t, b, ["k"], keep_old=["first"]).collect()}
    assert got == {1: ("a2", "y", "updated"), 2: ("b", "x", "kept"), 3: ("c", "z", "new")}


def test_request_window_starts_at_the_first_request(spark):
    at = [0, 30, 59, 60, 100, 119, 120]
    df = spark.createDataFrame([(i, 1, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)) for i, s in enumerate(at)], "id int, u int, ts timestamp")
    got = {r.id: (r.nth, r.refused) for r in state.request_windows(df, ["u"], "ts", "id", 60, 2).collect()}
    assert got == {0: (1, False), 1: (2, False), 2: (3, True), 3: (1, False), 4: (2, False), 5: (3, True), 6: (1, False)}


def test_rules_report_and_requirement(spark):
    found = quality.checks(spark.createDataFrame([(1,), (None,), (-1,)], "x int"), {"positive": F.col("x") > 0})
    assert found.first().violations == 1
    with pytest.raises(ValueError, match="positive: 1"):
        quality.require(found)


def test_offer_clusters_keep_cliques(spark):
    rows = [(1, 1, 1, None, "Arroz Mary 1kg"), (1, 2, 2, None, "Arroz Mary 1 kg"), (1, 3, 3, None, "Arroz Mary 2kg"), (1, 4, 4, "4006381333931", "x"), (1, 5, 5, "4006381333931", "y")]
    got = offers.offer_clusters(spark.createDataFrame(rows, "query_id long, offer_id long, seller long, ean string, name string")).collect()
    assert {r.offer_id: r.cluster for r in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_offer_clusters_query_covers_all_offers(spark):
    """No name of the table has a brand, a code or an abbreviation: offers of one size and type go together if their words are the same
    but for one, and their sellers differ."""
    sf = "/root/testdata/sf0.001"
    part = {r.p_partkey: r for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect()
    groups, want = {}, {}
    for r in sorted(lines, key=lambda r: (r.l_suppkey, r.l_partkey)):
        p = part[r.l_partkey]
        words, cliques = set(p.p_name.split()), groups.setdefault((p.p_size, p.p_type), [])
        fits = lambda m, w=words, s=r.l_suppkey: m[1] != s and len(m[2] ^ w) <= 1
        home = next((c for c in cliques if all(map(fits, c))), None)
        if home is None:
            cliques.append(home := [])
        home.append((r.l_partkey * 100_000 + r.l_suppkey, r.l_suppkey, words))
        want[home[-1][0]] = home[0][0]
    got = {r.offer_id: r.cluster for r in domain.offer_clusters(spark, sf).collect()}
    assert len(got) == len(lines) and got == want


def test_links_between_descriptions(spark):
    """By brand, code and models: (name, brand, ean) of two offers and whether they can be one product."""
    code, other = "4006381333931", "7591001100016"
    cases = [
        (("Arroz Mary 1kg", "Mary", None), ("Arroz Mary 1 kg", None, None), True), (("Arroz 1kg", "Mary", None), ("Arroz Primor 1kg", None, None), False), (("Arroz 1kg", "Mary", None), ("Arroz 1kg", "Primor", None), False),
        (("Arroz 1kg", "Mary", code), ("Leche 1l", "Nestle", code), True), (("Arroz Mary 1kg", "Mary", code), ("Arroz Mary 1kg", "Mary", other), False), (("TV QN55S90HAEXPA", "Samsung", None), ("Pantalla QN55S90HAEXPA", "Sams", None), True),
        (("TV QN55S90HAEXPA", "Samsung", None), ("TV QN55S90HAEXPA", "LG", None), False), (("Galleta Maria Dulce 200g", None, None), ("Galleta Maria 200g", None, None), False), (("Galleta Maria Roja 200g", None, None), ("Galletas Mario 200g", None, None), False),
        (("Queso Rallado 500g", None, None), ("Queso Rallada Andes 500g", None, None), True), (("Queso Rallado 500g", None, None), ("Queso Rallado Andes Premium 500g", None, None), False), (("Paquete 1kg", None, None), ("Paquete 1kg", None, None), False),
    ]
    rows = [(q, i, i, e, n, b) for q, (one, two, _) in enumerate(cases) for i, (n, b, e) in enumerate((one, two))]
    found = offers.offer_clusters(spark.createDataFrame(rows, "query_id long, offer_id long, seller long, ean string, name string, brand string").withColumn("offer_id", F.expr("query_id * 10 + offer_id"))).collect()
    together = {r.offer_id // 10 for r in found if r.offer_id % 10 == 1 and r.cluster % 10 == 0}
    assert together == {q for q, (_, _, yes) in enumerate(cases) if yes}


def test_offers_without_pack_or_with_distinctive_words_stay_apart(spark):
    names = ["Cafe Molido", "Cafe Molido Extra", "Leche Completa Mary 1l", "Leche Mary 1l", "Arroz Mary 1kg", "Arr. Mary Tipo 1 kg", "TV QN55S90HAEXPA Samsung", "Televisor Samsung QN55S90HAEXPA", "Agua 1500ml", "Jugo 1500ml"]
    rows = [(1, i, i, None, n, "Mary" if n == "Arroz Mary 1kg" else None) for i, n in enumerate(names)]
    got = offers.offer_clusters(spark.createDataFrame(rows, "query_id long, offer_id long, seller long, ean string, name string, brand string")).collect()
    assert {r.offer_id: r.cluster for r in got} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 9}


def test_xlsx_sheets_by_the_workbook(spark, tmp_path):
    ns, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="Second" r:id="rId2"/><sheet name="First" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/x.xml"/><Relationship Id="rId2" Target="/xl/worksheets/y.xml"/></Relationships>')
        z.writestr("xl/worksheets/x.xml", f'<worksheet {ns}><sheetData><row r="3"><c r="AB3"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/y.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="str"><v>f</v></c></row></sheetData></worksheet>')
    got = [(r.sheet, r.row, r.cells) for r in readers.xlsx_rows(spark, str(tmp_path / "b.xlsx")).collect()]
    assert got == [("Second", 1, ["f"]), ("First", 3, [None] * 27 + ["1"])]
    assert [r.row for r in readers.xlsx_rows(spark, str(tmp_path / "b.xlsx"), "First").collect()] == [3]


def test_xlsx_shared_inline_and_missing_cells(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="B2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
    assert [r.cells for r in readers.xlsx_rows(spark, str(tmp_path / "a.xlsx")).orderBy("row").collect()] == [["name", None, "7"], [None, "in"]]


def test_json_ld_and_store_replies(spark):
    html = '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"Cafe","gtin13":"4006381333931","offers":{"price":"12,50","priceCurrency":"VES","availability":"https://schema.org/InStock"}},{"@type":"Other"}]}</script>'
    r = readers.json_ld_products(spark.createDataFrame([(1, html)], "id int, html string")).collect()
    assert [(x.id, x.name, x.price, x.in_stock) for x in r] == [(1, "Cafe", Decimal("12.5000"), True)]
    body = '{"products":[{"id":"9","title":"Te","vendor":"V","variants":[{"price":"3.5","available":true}]}]}'
    o = readers.store_offers(spark.createDataFrame([(1, body)], "s int, body string"), "shopify").first()
    assert (o.s, o.id, o.name, o.price, o.in_stock) == (1, "9", "Te", 3.5, True)
    vtex = '[{"productId":"1","productName":"P","brand":"B","items":[{"sellers":[{"commertialOffer":{"Price":2.5,"AvailableQuantity":0}}]}]}]'
    assert readers.store_offers(spark.createDataFrame([(vtex,)], "body string"), "vtex").first().in_stock is False


def test_insert_statements_and_pasted_lists(spark):
    dump = spark.createDataFrame([("INSERT INTO `t` VALUES (1,'it''s, ok',NULL),(2,'b',3);",)], "sql string")
    assert [(r.table, r.values) for r in readers.insert_statements(dump, "sql").collect()] == [("t", ["1", "it's, ok", None]), ("t", ["2", "b", "3"])]
    got = readers.pasted_list(spark.createDataFrame([('a;"b, c"\n\nd,e',)], "t string"), "t").collect()
    assert [r.cells for r in got] == [["a", "b, c"], ["d", "e"]]


def test_csv_guard_calendar_folding_and_manifest(spark):
    df = spark.createDataFrame([("=1+1",), ("ok",), (None,)], "x string")
    assert [r.x for r in writers.guarded(df).collect()] == ["'=1+1", "ok", None]
    assert one(spark, writers.folded, "a" * 80) == "a" * 74 + "\r\n " + "a" * 6
    assert writers.manifest(df, "d").first() == writers.manifest(df.orderBy(F.desc("x")), "d").first()
    path = shared_folder(spark, "csv")
    writers.write_csv(df.filter("x = 'ok'"), path)
    assert readers.typed_csv(spark, path, "x string").collect()[0].x == "ok"


def test_offers_that_say_the_same_are_described_once(spark):
    rows = [(1, i, i, None, "Arroz blanco 1kg" if i % 2 else "Harina pan 1kg", None) for i in range(50)]
    told, kinds = offers.descriptions(spark.createDataFrame(rows, "query_id long, offer_id long, seller long, ean string, name string, brand string"))
    assert told.count() == 50 and kinds.count() == 2


def test_duties_are_dated_for_kinds_of_taxpayers(spark):
    plan = domain.duties_due(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "c_custkey" not in plan.split("Window")[1].split("]")[0]
