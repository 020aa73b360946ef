"""Every rule of the load validations finds what was planted for it, and nothing in clean tables."""

import datetime as dt

from pyspark.sql import functions as F

from quipu.operators import validations

D = dt.date


def found(df):
    return {r.rule: (r.violations, r.first) for r in df.collect()}


def test_rates_load(spark):
    f = spark.createDataFrame
    schema = "day date, currency string, buy double, sell double"
    day, next_ = D(2026, 1, 5), D(2026, 1, 6)
    clean = [(day, "USD", 1.0, 2.0), (day, "EUR", 2.0, 3.0), (next_, "USD", 1.5, 2.5), (next_, "EUR", 2.0, 3.5)]
    pubs = f([(day, D(2026, 1, 2)), (next_, day)], "day date, traded date")
    src, none = f([("a.xls", "1")], "file string, sha256 string"), f([], "day date")
    old = [(day, "USD", None, 2.0), (day, "EUR", 2.0, 3.0)]
    manifest, last = f([("rates", 4), ("publications", 2)], "name string, rows long"), f([(next_, 2.5)], "day date, sell double")
    ok = found(validations.rates_load(f(clean, schema), pubs, src, none, f(old, schema), pubs.limit(1), src, manifest, last))
    assert len(ok) == 7 and set(ok.values()) == {(0, None)}
    bad = f([(day, "USD", 1.0, 2.1), (day, "EUR", 2.5, 3.0), (next_, "USD", 1.5, 2.4)], schema)
    got = found(validations.rates_load(bad, pubs.withColumn("traded", F.date_add("traded", 1)), src.withColumn("sha256", F.lit("2")), f([(day,)], "day date"), f(old, schema), pubs, src, manifest, last))
    assert got == {"V1 counts": (1, "rates"), "V2 rate contradicts": (2, "2026-01-05 EUR"), "V2 trading day contradicts": (2, "2026-01-05"), "V3 leading currency missing": (1, "2026-01-06"), "V4 last rate": (1, "2026-01-06"), "V5 file with other content": (1, "a.xls"), "V6 silent day with a publication": (1, "2026-01-05")}


def test_calendar_load(spark):
    """Twelve rows a duty would be long: ten terminals in one month, a bank holiday that extends, then one fault for each rule."""
    schema = "duty string, terminal int, day date, extended date, since date, until date"
    month, before = D(2026, 3, 1), D(2026, 2, 28)
    rows = lambda duty, day, since=month, until=before, extended=None: [(duty, t, day, extended, since, until) for t in range(10)]
    holidays = spark.createDataFrame([(D(2026, 3, 19), False), (D(2026, 3, 20), True)], "day date, national boolean")
    clean = rows("p1", D(2026, 3, 17)) + rows("p2", D(2026, 3, 16)) + rows("ordinary", D(2026, 3, 16), until=D(2026, 3, 1)) + rows("bank", D(2026, 3, 19), extended=D(2026, 3, 23)) + rows("year", D(2026, 3, 31)) + rows("twin", D(2026, 3, 31))
    manifest = spark.createDataFrame([("due", len(clean))], "name string, rows long")
    check = lambda due: found(validations.calendar_load(spark.createDataFrame(due, schema), holidays, manifest, ["year"], ["p1"], ["p2"], "ordinary", [("twin", "year")]))
    ok = check(clean)
    assert len(ok) == 8 and set(ok.values()) == {(0, None)}
    swap = lambda duty, t, **new: [tuple({**dict(zip(("duty", "terminal", "day", "extended", "since", "until"), r, strict=True)), **new}.values()) if r[:2] == (duty, t) else r for r in clean]
    assert check(swap("year", 3, day=D(2026, 3, 20)))["V2 due on a closed day"] == (1, "year 3 2026-03-20") and check(swap("year", 3, day=D(2026, 3, 28)))["V2 due on a closed day"][0] == 1
    assert check(swap("p1", 4, terminal=5))["V3 two a terminal and month"][0] == 1 and check(swap("p1", 4, terminal=5))["V4 terminals missing"] == (1, "p1")
    assert check([*clean, clean[-20]])["V4 terminals missing"] == (1, "year") and check([*clean, clean[-20]])["V1 counts"] == (1, "due")
    assert check(swap("p1", 0, day=D(2026, 3, 13)))["V5 half months"][0] == 1 and check(swap("p2", 0, day=D(2026, 3, 17)))["V5 half months"][0] == 1 and check(swap("p2", 0, until=D(2026, 1, 31)))["V5 half months"][0] == 1
    assert check(swap("ordinary", 0, day=D(2026, 3, 17)))["V6 ordinary due day"] == (1, "2026-03-17")
    assert check(swap("twin", 2, day=D(2026, 3, 30)))["V7 twins differ"] == (2, "2 2026-03-30")
    assert check(swap("bank", 1, extended=None))["V8 extension"] == (1, "bank 1 2026-03-19") and check(swap("bank", 1, extended=D(2026, 3, 20)))["V8 extension"][0] == 1 and check(swap("p1", 1, extended=D(2026, 3, 18)))["V8 extension"][0] == 1


def test_directory_load(spark):
    f = spark.createDataFrame
    people = f([(1, ["importers"]), (2, [])], "id long, sources array<string>")
    listed = {"importers": f([(1,)], "id long")}
    places = f([(1, "Main St", None), (1, "main st", "5")], "id long, street string, phone string")
    payers, regions = f([(1, 300, 2)], "id long, cents long, regions long"), f([(1, "a", 100), (1, "b", 200)], "id long, region string, cents long")
    manifest = f([("taxpayers", 2), ("addresses", 2), ("payers", 1), ("regions", 2), ("importers", 1)], "name string, rows long")
    assert set(found(validations.directory_load(people, listed, places, payers, regions, manifest)).values()) == {(0, None)}
    got = found(validations.directory_load(people.withColumn("sources", F.array(F.lit("importers"))), listed, places.withColumn("phone", F.lit("")), payers.withColumn("cents", F.lit(301)), regions, manifest.limit(4)))
    assert got == {"V1 counts": (1, "importers"), "V2 address twice": (1, "1"), "V3 source without its row": (1, "2"), "V4 totals": (1, "1")}
