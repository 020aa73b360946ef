"""Amounts, codes, calendars, merges, histories, quality rules, classification, offers, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quipu.functions import dates as D
from quipu.functions import numbers as N
from quipu.operators import matching, merge, quality, rules, state
from quipu.operators.offers import offer_clusters as clusters_of
from quipu.operators.relational import latest_per_key, longest_prefix
from quipu.plans.core import cents, codes, prefix_rules, CODES_SQL, RULES_SQL
from quipu.plans.registry import Registry, read
from quipu.plans.texts import RULES, RULES_SQL as NAME_RULES_SQL

R = Registry()
case = R.case


@case("SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * 4 / 100, 2) AS DOUBLE) AS converted FROM lineitem")
def decimal_convert(spark, sf):
    l = read(spark, sf, "lineitem")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", N.convert(F.col("l_extendedprice"), F.lit(4), F.lit(100)).cast("double").alias("converted"))


@case("SELECT l_orderkey, l_linenumber, l_partkey, CAST(b AS DOUBLE) AS base, CAST(t AS DOUBLE) AS tax, CAST(b + t AS DOUBLE) AS total FROM (SELECT *, CAST(round(b * p * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS t FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS b, CAST(round(l_tax * 100) AS INT) AS p FROM lineitem))")
def invoice_amounts(spark, sf):
    parts = N.invoice(cents("l_extendedprice"), F.round(F.col("l_tax") * 100).cast("int"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[p.cast("double") for p in parts]).toDF("l_orderkey", "l_linenumber", "l_partkey", "base", "tax", "total")


@case("SELECT p_partkey, (l_extendedprice / p_retailprice - 1) * 100 AS gap, l_extendedprice BETWEEN p_retailprice * 0.5 AND p_retailprice * 30.0 AS plausible, l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey")
def gap_pct(spark, sf):
    j = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    price, reference = F.col("l_extendedprice"), F.col("p_retailprice")
    return j.select("p_partkey", N.gap_percent(price, reference).alias("gap"), N.plausible(price, reference, 0.5, 30.0).alias("plausible"), "l_orderkey", "l_linenumber")


_SUM8 = " + ".join(f"CAST(substr(d, {i}, 1) AS INT) * {w}" for i, w in enumerate([3, 2, 7, 6, 5, 4, 3, 2], 1))


@case(f"SELECT c_custkey, kind || d || last AS id, kind = 'C' OR CASE WHEN s % 11 < 2 THEN 0 ELSE 11 - s % 11 END = last AS valid, kind <> 'C' AS verified FROM (SELECT *, 4 * list_position(['V','E','J','P','G'], kind) + {_SUM8} AS s FROM (SELECT c_custkey, ['V','E','J','P','G','C'][CAST(c_custkey % 6 + 1 AS INT)] AS kind, lpad(CAST(c_custkey * 7919 AS VARCHAR), 8, '0') AS d, CAST(c_custkey % 10 AS INT) AS last FROM customer))")
def mod11_check(spark, sf):
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, "VEJPGC")), (k % 6 + 1).cast("int"))
    text = F.concat(kind, F.lit("-"), F.lpad((k * 7919).cast("string"), 8, "0"), F.lit("-"), (k % 10).cast("string"))
    return read(spark, sf, "customer").select("c_custkey", N.tax_id(text).alias("t")).select("c_custkey", "t.id", "t.valid", "t.verified")


_EAN = "lpad(CAST(750000000000 + p_partkey * 37 AS VARCHAR), 12, '0') || CAST(p_partkey % 10 AS VARCHAR)"
_GS1 = " + ".join(f"CAST(substr(e, {i}, 1) AS INT) * {3 if i % 2 == 0 else 1}" for i in range(1, 13))


@case(f"SELECT p_partkey, (10 - ({_GS1}) % 10) % 10 = CAST(substr(e, 13, 1) AS INT) AS valid, CASE WHEN (10 - ({_GS1}) % 10) % 10 = CAST(substr(e, 13, 1) AS INT) THEN 'ean13' ELSE 'sku' END AS kind FROM (SELECT p_partkey, {_EAN} AS e FROM part)")
def gs1_check(spark, sf):
    k = F.col("p_partkey")
    ean = F.concat((k * 37 + F.lit(750000000000)).cast("string"), (k % 10).cast("string"))
    return read(spark, sf, "part").select("p_partkey", N.gtin_valid(ean).alias("valid"), N.code_type(ean).alias("kind"))


@case("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND (p_partkey % 1000 BETWEEN 300 AND 499 OR p_partkey % 1000 >= 800) THEN 'plu' WHEN p_partkey % 3 = 1 THEN 'internal' ELSE 'sku' END AS kind FROM part")
def code_type(spark, sf):
    k = F.col("p_partkey")
    code = F.when(k % 3 == 0, F.concat((k % 1000 / 100).cast("int").cast("string"), F.lit("000"))).when(k % 3 == 1, F.concat(F.lit("2"), F.lpad(k.cast("string"), 12, "0"))).otherwise(F.concat(F.lit("SKU-"), k.cast("string")))
    return read(spark, sf, "part").select("p_partkey", N.code_type(code).alias("kind"))


CAL_SQL = "SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '1994-12-01', DATE '2002-03-31', INTERVAL 1 DAY) g(d)"
OPEN_SQL = f"SELECT day FROM ({CAL_SQL}) WHERE isodow(day) < 6 AND day(day) NOT IN (1, 24)"


def working_calendar(spark):
    days = D.calendar(spark, "1994-12-01", "2002-03-31")
    return days, days.filter(F.dayofmonth("day").isin(1, 24))


@case(f"WITH b AS ({OPEN_SQL}) SELECT o_orderkey, (SELECT min(day) FROM b WHERE day >= CAST(o_orderdate AS DATE) AND day <= CAST(o_orderdate AS DATE) + 30) AS next_day FROM orders", dates=("next_day",))
def business_day_next(spark, sf):
    table = D.next_business_day(*working_calendar(spark))
    return read(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")).join(F.broadcast(table), "day", "left").select("o_orderkey", "next_day")


@case(f"WITH b AS ({OPEN_SQL}) SELECT o_orderkey, due, CASE WHEN later <> due THEN later END AS extended FROM (SELECT o_orderkey, due, (SELECT min(day) FROM b WHERE day >= due) AS later FROM (SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + INTERVAL 14 DAY AS DATE) AS due FROM orders))", dates=("due", "extended"))
def deadline_extension(spark, sf):
    """Ordinary duties fall due on the 15th of the next month, or on the first business day from there."""
    due = F.date_add(F.add_months(F.trunc("o_orderdate", "month"), 1), 14)
    table = D.next_business_day(*working_calendar(spark)).withColumnRenamed("day", "due")
    joined = read(spark, sf, "orders").select("o_orderkey", due.alias("due")).join(F.broadcast(table), "due", "left")
    return joined.select("o_orderkey", "due", F.when(F.col("next_day") != F.col("due"), F.col("next_day")).alias("extended"))


@case("SELECT o_orderkey, CASE WHEN day(o_orderdate) <= 15 THEN CAST(date_trunc('month', o_orderdate) AS DATE) ELSE CAST(date_trunc('month', o_orderdate) AS DATE) + 15 END AS period_from, CASE WHEN day(o_orderdate) <= 15 THEN CAST(date_trunc('month', o_orderdate) AS DATE) + 14 ELSE last_day(o_orderdate) END AS period_to FROM orders", dates=("period_from", "period_to"))
def period_halfmonth(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", *D.half_month(F.to_date("o_orderdate")))


@case(f"SELECT day FROM ({OPEN_SQL}) WHERE day BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND day NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)", dates=("day",))
def gap_business_days(spark, sf):
    open_ = D.business_days(*working_calendar(spark)).filter("day BETWEEN DATE'1996-01-01' AND DATE'1998-12-31'")
    return open_.join(read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")), "day", "left_anti")


_DUTIES = [("iva", "ESPECIAL", None, None), ("islr", "ESPECIAL", "retenciones", None), ("igtf", "ESPECIAL", None, "exento"), ("iva-o", "ORDINARIO", None, None)]
_DUTIES_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in d) + ")" for d in _DUTIES) + ") d(duty, kind, needs, bars)"


@case(f"SELECT c_custkey, duty, due FROM (SELECT c_custkey, duty, due, row_number() OVER (PARTITION BY c_custkey ORDER BY due, duty) AS n FROM customer, {_DUTIES_SQL}, (SELECT make_date(2026, m::INT, 10 + t::INT) AS due, t FROM range(1, 13) a(m), range(0, 10) b(t)) v WHERE t = c_custkey % 10 AND due >= DATE '2026-03-15' AND kind = CASE WHEN c_acctbal > 5000 THEN 'ESPECIAL' ELSE 'ORDINARIO' END AND (needs IS NULL OR c_mktsegment = 'BUILDING') AND (bars IS NULL OR c_mktsegment <> 'MACHINERY')) WHERE n <= 5", dates=("due",))
def duties_due(spark, sf):
    """The next five duties of each taxpayer by the last digit of its id, its kind and its declared conditions."""
    c = read(spark, sf, "customer")
    conditions = F.array_compact(F.array(F.when(F.col("c_mktsegment") == "BUILDING", "retenciones"), F.when(F.col("c_mktsegment") == "MACHINERY", "exento")))
    people = c.select("c_custkey", (F.col("c_custkey") % 10).alias("digit"), F.when(F.col("c_acctbal") > 5000, "ESPECIAL").otherwise("ORDINARIO").alias("kind"), conditions.alias("conditions"))
    duties = spark.createDataFrame(_DUTIES, "duty string, kind string, needs string, bars string")
    slots = spark.range(12).crossJoin(spark.range(10).withColumnRenamed("id", "digit")).select("digit", F.make_date(F.lit(2026), (F.col("id") + 1).cast("int"), (F.col("digit") + 10).cast("int")).alias("due"))
    alike = ["digit", "kind", "conditions"]  # taxpayers with the same have the same duties, so few rows are dated and ranked
    open_ = people.select(alike).distinct().join(F.broadcast(duties), "kind").filter((F.col("needs").isNull() | F.array_contains("conditions", F.col("needs"))) & (F.col("bars").isNull() | ~F.array_contains("conditions", F.col("bars"))))
    dated = open_.join(F.broadcast(slots.filter("due >= DATE'2026-03-15'")), "digit")
    first = F.row_number().over(Window.partitionBy(*alike).orderBy("due", "duty"))
    return people.join(F.broadcast(dated.withColumn("n", first).filter("n <= 5")), alike).select("c_custkey", "duty", "due")


OLD_SQL = "SELECT c_custkey AS k, c_name AS name, c_acctbal AS v FROM customer WHERE c_custkey % 3 < 2"
NEW_SQL = "SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 3 > 0"


def halves(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("v"))
    return c.filter("k % 3 < 2"), c.filter("k % 3 > 0").withColumn("v", F.when(F.col("k") % 4 == 0, F.col("v") + 1).otherwise(F.col("v")))


@case(f"SELECT k, coalesce(n.name, o.name) AS name, coalesce(n.v, o.v) AS v, CASE WHEN o.v IS NULL THEN 'new' WHEN n.v IS NULL THEN 'kept' WHEN o.v = n.v THEN 'same' ELSE 'updated' END AS change FROM ({OLD_SQL}) o FULL JOIN ({NEW_SQL}) n USING (k)")
def upsert_if_changed(spark, sf):
    return merge.upsert(*halves(spark, sf), ["k"])


@case(f"SELECT * FROM ({OLD_SQL}) UNION ALL SELECT * FROM ({NEW_SQL}) WHERE k % 3 = 2")
def insert_absent(spark, sf):
    return merge.insert_absent(*halves(spark, sf), ["k"], [F.col("k")])


@case("SELECT CAST(ts AS DATE) AS day, user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3", dates=("day",))
def additive_merge(spark, sf):
    e = read(spark, sf, "events")
    part = lambda rest: e.filter(f"event_id % 2 = {rest}").groupBy(F.to_date("ts").alias("day"), "user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return merge.additive(part(0), part(1), ["day", "user_id", "event_type"], ["n"])


@case("SELECT c_custkey AS k, c_custkey % 3 > 0 AS present FROM customer")
def soft_delete_merge(spark, sf):
    old, new = halves(spark, sf)
    return merge.soft_delete(old.select("k"), new, ["k"], "present")


@case("SELECT event_type, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16 00:00:00') AS purged, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16 00:00:00') AS left_over FROM events GROUP BY 1")
def retention_count(spark, sf):
    e = read(spark, sf, "events")
    kept = merge.retained(e, "ts", "2024-01-31 00:00:00", 15).groupBy("event_type").agg(F.count(F.lit(1)).alias("left_over"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).join(kept, "event_type", "left").select("event_type", (F.col("n") - F.coalesce("left_over", F.lit(0))).alias("purged"), F.coalesce("left_over", F.lit(0)).alias("left_over"))


@case(f"SELECT k, f AS field, CAST(CASE f WHEN 'v' THEN o.v END AS VARCHAR) AS before, CAST(CASE f WHEN 'v' THEN n.v END AS VARCHAR) AS after FROM ({OLD_SQL}) o JOIN ({NEW_SQL}) n USING (k), (VALUES ('v')) x(f) WHERE o.v <> n.v")
def field_change_log(spark, sf):
    old, new = halves(spark, sf)
    return merge.change_log(old.join(new, "k", "left_semi"), new.join(old, "k", "left_semi"), "k", ["name", "v"])


_ROUNDED = "SELECT event_id, user_id, ts, round(value / 20) AS price FROM events"


def prices(spark, sf):
    return read(spark, sf, "events").select("event_id", "user_id", "ts", F.round(F.col("value") / 20).alias("price"))


@case(f"SELECT event_id, user_id, price FROM (SELECT *, lag(price) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM ({_ROUNDED})) WHERE b IS DISTINCT FROM price")
def price_history_change_only(spark, sf):
    return state.change_history(prices(spark, sf), ["user_id"], "ts", "price", "event_id").select("event_id", "user_id", "price")


@case(f"WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ({_ROUNDED})), f AS (SELECT user_id, n, event_id, price, ts AS kept_at, price AS kept, true AS k FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.event_id, e.price, CASE WHEN e.price <> f.kept OR e.ts - f.kept_at >= INTERVAL 1 DAY THEN e.ts ELSE f.kept_at END, CASE WHEN e.price <> f.kept OR e.ts - f.kept_at >= INTERVAL 1 DAY THEN e.price ELSE f.kept END, e.price <> f.kept OR e.ts - f.kept_at >= INTERVAL 1 DAY FROM e JOIN f ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT event_id, user_id, price FROM f WHERE k")
def price_history_heartbeat(spark, sf):
    return state.change_history(prices(spark, sf), ["user_id"], "ts", "price", "event_id", 86_400).select("event_id", "user_id", "price")


@case("WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f AS (SELECT user_id, n, event_id, ts AS start, 1 AS nth FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN e.ts - f.start >= INTERVAL 6 HOUR THEN e.ts ELSE f.start END, CASE WHEN e.ts - f.start >= INTERVAL 6 HOUR THEN 1 ELSE f.nth + 1 END FROM e JOIN f ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT event_id, CAST(nth AS BIGINT) AS nth, nth > 2 AS refused FROM f")
def rate_limit_window(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "ts")
    return state.request_windows(e, ["user_id"], "ts", "event_id", 6 * 3600, 2).select("event_id", "nth", "refused")


@case("SELECT CAST(ts - INTERVAL 4 HOUR AS DATE) AS day, user_id, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1, 2", dates=("day",))
def usage_counter(spark, sf):
    return read(spark, sf, "events").groupBy(D.civil_day(F.col("ts")).alias("day"), "user_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"))


@case("SELECT * FROM (SELECT 'discount range' AS rule, count(*) FILTER (WHERE NOT l_discount BETWEEN 0 AND 0.05) AS violations FROM lineitem UNION ALL SELECT 'quantity positive', count(*) FILTER (WHERE NOT l_quantity > 0) FROM lineitem UNION ALL SELECT 'order exists', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'customer exists', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'line repeated', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'name format', count(*) FROM customer WHERE NOT regexp_matches(c_name, '^Customer#[0-9]{9}$'))")
def dq_report(spark, sf):
    l, o, c = (read(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    return quality.report(
        quality.checks(l, {"discount range": F.col("l_discount").between(0, 0.05), "quantity positive": F.col("l_quantity") > 0}),
        quality.orphans("order exists", l, "l_orderkey", o, "o_orderkey"), quality.orphans("customer exists", o, "o_custkey", c, "c_custkey"),
        quality.repeated("line repeated", l, "l_orderkey", "l_linenumber"), quality.checks(c, {"name format": F.col("c_name").rlike("^Customer#[0-9]{9}$")}),
    )


OFFERS_SQL = "SELECT l_partkey AS part, l_suppkey AS seller, min(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2"


def offers(spark, sf):
    return read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("seller")).agg(F.min("l_extendedprice").alias("price"))


_DOUBT_SQL = f"SELECT *, CASE WHEN n >= 3 THEN price < 0.4 * m OR price > 2.5 * m WHEN n = 2 THEN hi > 4 * lo ELSE false END AS doubtful FROM (SELECT *, count(*) OVER w AS n, median(price) OVER w AS m, max(price) OVER w AS hi, min(price) OVER w AS lo FROM ({OFFERS_SQL}) WINDOW w AS (PARTITION BY part))"


@case(f"SELECT part, seller, doubtful FROM ({_DOUBT_SQL})")
def doubtful_price(spark, sf):
    o = offers(spark, sf)
    return o.select("part", "seller", matching.doubtful(o, ["part"], "price").alias("doubtful"))


@case(f"SELECT DISTINCT ON (part) part, seller, price FROM ({_DOUBT_SQL}) ORDER BY part, doubtful, price, seller")
def best_offer(spark, sf):
    o = offers(spark, sf)
    return latest_per_key(o.withColumn("doubtful", matching.doubtful(o, ["part"], "price")), ["part"], [F.col("doubtful"), F.col("price"), F.col("seller")]).select("part", "seller", "price")


@case(f"SELECT p_type, part, low, high, low_seller FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY high / low DESC, part) AS r FROM (SELECT part, min(price) AS low, max(price) AS high, arg_min(seller, price) AS low_seller FROM ({OFFERS_SQL}) GROUP BY 1 HAVING count(*) >= 2 AND max(price) >= 1.03 * min(price)) JOIN part ON part = p_partkey) WHERE r = 1 ORDER BY high / low DESC, p_type LIMIT 4")
def spread_report(spark, sf):
    """Per product the cheapest and the dearest seller, the widest gap of each type, the four widest of all."""
    spread = offers(spark, sf).groupBy("part").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.min_by("seller", "price").alias("low_seller"), F.count(F.lit(1)).alias("n")).filter("n >= 2 AND high >= 1.03 * low")
    typed = spread.join(read(spark, sf, "part").select(F.col("p_partkey").alias("part"), "p_type"), "part")
    gap = F.col("high") / F.col("low")
    return latest_per_key(typed, ["p_type"], [gap.desc(), F.col("part")]).orderBy(gap.desc(), "p_type").limit(4).select("p_type", "part", "low", "high", "low_seller")


@case()
def offer_clusters(spark, sf):
    """Offers of one size and type as one search each; tests compare the clusters with brute force."""
    p = read(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_type")
    lines = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("seller")).distinct()
    asked = lines.join(p, "p_partkey").withColumn("query_id", F.xxhash64("p_size", "p_type"))
    named = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("kg"))
    return clusters_of(asked.select("query_id", (F.col("p_partkey") * 100_000 + F.col("seller")).alias("offer_id"), "seller", F.lit(None).cast("string").alias("ean"), named.alias("name")))


_SIGNALS_SQL = f"""SELECT p_partkey AS item, 'r' || (1 + rule % 4) AS rule, 0.95 AS weight FROM (WITH c AS ({CODES_SQL}), r AS ({RULES_SQL}) SELECT p_partkey, arg_max(rule, length(r.prefix)) AS rule FROM c JOIN r ON starts_with(c.code, r.prefix) GROUP BY 1)
UNION ALL SELECT p_partkey, rule, 0.75 FROM part, {NAME_RULES_SQL} WHERE regexp_matches(p_name, pattern)"""


def signals(spark, sf):
    found = longest_prefix(codes(spark, sf), "code", prefix_rules(spark, sf), "prefix", range(2, 7)).filter("rule IS NOT NULL")
    by_code = found.select(F.col("p_partkey").alias("item"), F.concat(F.lit("r"), (F.col("rule") % 4 + 1).cast("string")).alias("rule"), F.lit("code").alias("origin"))
    hits = F.array_compact(F.array(*[F.when(F.col("p_name").rlike(p), F.lit(r)) for r, p, *_ in RULES]))
    by_name = read(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.explode(hits).alias("rule"), F.lit("name").alias("origin"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in rules.WEIGHTS.items() for x in kv]), F.col("origin"))
    return by_code.unionByName(by_name).select("item", "rule", weight.alias("weight"))


@case(f"SELECT item, rule, CAST(w AS DOUBLE) AS weight, row_number() OVER (PARTITION BY item ORDER BY w DESC, priority DESC, rule) AS place FROM (SELECT item, s.rule, max(weight) AS w, any_value(r.priority) AS priority FROM ({_SIGNALS_SQL}) s JOIN {NAME_RULES_SQL} USING (rule) GROUP BY 1, 2)")
def classify_signals(spark, sf):
    return rules.rule_weights(signals(spark, sf), rule_table(spark)).select("item", "rule", "weight", "place")


def rule_table(spark):
    return spark.createDataFrame(RULES, "rule string, pattern string, priority int, percent int, category string")


@case(f"""WITH w AS (SELECT item, s.rule, max(weight) AS w FROM ({_SIGNALS_SQL}) s JOIN {NAME_RULES_SQL} USING (rule) GROUP BY 1, 2),
o AS (SELECT rule, category, NULL AS lim FROM {NAME_RULES_SQL} UNION ALL SELECT 'r1', 'exempt', 10),
l AS (SELECT item, rule, w, category FROM w JOIN o USING (rule) JOIN part ON p_partkey = item WHERE lim IS NULL OR p_size < lim),
s AS (SELECT item, count(DISTINCT rule) AS n, max(w) AS base, array_to_string(list_sort(list(DISTINCT rule)), ',') AS rules FROM l GROUP BY 1),
k AS (SELECT item, category, count(DISTINCT rule) AS m FROM l GROUP BY 1, 2),
c AS (SELECT item, count(*) FILTER (WHERE m = n) AS common, count(*) AS total, string_agg(category, ',' ORDER BY category) FILTER (WHERE m = n) AS shared, string_agg(category, ',' ORDER BY category) AS every FROM k JOIN s USING (item) GROUP BY 1)
SELECT item, CASE WHEN common > 0 THEN shared ELSE every END AS categories, rules, CASE WHEN (CASE WHEN common > 0 THEN common ELSE total END) = 1 THEN 'decided' ELSE 'conditional' END AS state,
least(0.99, floor(CAST(base AS DOUBLE) * CASE WHEN (CASE WHEN common > 0 THEN common ELSE total END) = 1 THEN 1.0 ELSE 0.8 END::DOUBLE * CASE WHEN n = 1 THEN 1.0 WHEN common > 0 THEN 1.05 ELSE 0.8 END::DOUBLE * 100 + 0.5) / 100) AS confidence FROM c JOIN s USING (item)""")
def classify_items(spark, sf):
    """Each item's categories, state and confidence; rule r1 also exempts items below size 10."""
    options = rule_table(spark).select("rule", "category", F.lit(None).cast("string").alias("condition"), F.lit(None).cast("string").alias("op"), F.lit(None).cast("int").alias("limit"))
    options = options.unionByName(spark.createDataFrame([("r1", "exempt", "small", "<", 10)], options.schema))
    context = read(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("value"))
    live = rules.live_options(rules.rule_weights(signals(spark, sf), rule_table(spark)), options, context)
    return rules.combined(live).select("item", F.array_join("categories", ",").alias("categories"), F.array_join("rules", ",").alias("rules"), "state", "confidence")


@case(f"SELECT l_orderkey, l_linenumber, l_partkey, rule, CAST(b AS DOUBLE) AS base, CAST(CAST(round(b * percent * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS DOUBLE) AS tax FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS b FROM lineitem) JOIN part ON p_partkey = l_partkey JOIN {NAME_RULES_SQL} ON regexp_matches(p_name, pattern)")
def options_with_amounts(spark, sf):
    hits = F.array_compact(F.array(*[F.when(F.col("p_name").rlike(p), F.struct(F.lit(r).alias("rule"), F.lit(pc).alias("percent"))) for r, p, _, pc, _ in RULES]))
    items = read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.explode(hits).alias("r"))
    joined = read(spark, sf, "lineitem").join(items, "l_partkey")
    base, tax, _ = N.invoice(cents("l_extendedprice"), F.col("r.percent"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "r.rule", base.cast("double").alias("base"), tax.cast("double").alias("tax"))


_STATE_SQL = f"SELECT item, w, lead(w) OVER (PARTITION BY item ORDER BY w DESC, rule) AS second, row_number() OVER (PARTITION BY item ORDER BY w DESC, rule) AS n FROM (SELECT item, rule, max(weight) AS w FROM ({_SIGNALS_SQL}) GROUP BY 1, 2)"


@case(f"SELECT item, CASE WHEN w >= 0.8 AND (second IS NULL OR second <= w - 0.25) THEN 'decided' ELSE 'conditional' END AS state FROM ({_STATE_SQL}) WHERE n = 1")
def candidate_state(spark, sf):
    best = signals(spark, sf).groupBy("item", "rule").agg(F.max("weight").alias("w"))
    o = Window.partitionBy("item").orderBy(F.desc("w"), "rule")
    first = best.select("item", "w", F.lead("w").over(o).alias("second"), F.row_number().over(o).alias("n")).filter("n = 1")
    sure = (F.col("w") >= 0.8) & (F.col("second").isNull() | (F.col("second") <= F.col("w") - 0.25))
    return first.select("item", F.when(sure, "decided").otherwise("conditional").alias("state"))


_REFORMS_SQL = "SELECT p_partkey AS k, 1 AS batch, p_size + 1 AS size FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 2, 0 FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey + 1000000, 3, 9 FROM part WHERE p_partkey < 10"


@case(f"SELECT coalesce(p_partkey, k) AS k, coalesce(size, p_size) AS size, coalesce(batch, 0) AS batch FROM part FULL JOIN (SELECT DISTINCT ON (k) * FROM ({_REFORMS_SQL}) ORDER BY k, batch DESC) ON k = p_partkey")
def apply_reforms(spark, sf):
    """Three ordered batches of changes over a table: the last change of a key holds."""
    p = read(spark, sf, "part")
    size, k = F.col("p_size"), F.col("p_partkey")
    changes = p.filter(k % 5 == 0).select(k.alias("k"), F.lit(1).alias("batch"), (size + 1).alias("size")).unionByName(p.filter(k % 7 == 0).select(k.alias("k"), F.lit(2).alias("batch"), F.lit(0).alias("size"))).unionByName(p.filter(k < 10).select((k + 1_000_000).alias("k"), F.lit(3).alias("batch"), F.lit(9).alias("size")))
    last = latest_per_key(changes, ["k"], [F.desc("batch")])
    out = merge.upsert(p.select(k.alias("k"), size.alias("size"), F.lit(0).alias("batch")), last.select("k", "size", "batch"), ["k"])
    return out.select("k", "size", "batch")


@case("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS last_week, arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY 1")
def report_activity(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("ts") >= F.lit("2024-01-24").cast("timestamp")).alias("last_week"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@case("SELECT CAST(ts - INTERVAL 4 HOUR AS DATE) AS day, count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'error') * 100.0::DOUBLE / count(*) AS error_share FROM events GROUP BY 1", dates=("day",))
def report_dashboard(spark, sf):
    g = read(spark, sf, "events").groupBy(D.civil_day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("e"))
    return g.select("day", "events", "users", (F.col("e") * F.lit(100.0) / F.col("events")).alias("error_share"))
