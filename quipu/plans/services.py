"""Notices, crawling, recipients, registers, options and lists over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quipu.functions import numbers as N
from quipu.functions import text as T
from quipu.operators import agenda, asof, rules
from quipu.operators.relational import longest_prefix, top_per_key
from quipu.plans.core import CODES_SQL, RULES_SQL, SERIES_SQL, cents, codes, prefix_rules, series
from quipu.plans.domain import R as DOMAIN
from quipu.plans.domain import mod11_check
from quipu.plans.registry import Registry, read
from quipu.plans.texts import _HOST, norm_sql

R = Registry()
case = R.case
MOD11_SQL = DOMAIN.sql["mod11_check"]


@case("SELECT l_orderkey, bool_and(l_quantity >= 5) AS every, bool_or(l_discount > 0.08) AS some FROM lineitem GROUP BY 1")
def agg_bool(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") >= 5).alias("every"), F.bool_or(F.col("l_discount") > 0.08).alias("some"))


@case("SELECT user_id, len(a) = len(list_intersect(a, ['view', 'click', 'purchase', 'signup'])) AS inside, len(a) BETWEEN 1 AND 4 AS sized FROM (SELECT user_id, list(DISTINCT event_type) AS a FROM events GROUP BY 1)")
def array_domain_check(spark, sf):
    """Arrays within a domain and of an allowed size, as check constraints ask."""
    kinds = read(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("a"))
    known = F.array(*map(F.lit, ["view", "click", "purchase", "signup"]))
    return kinds.select("user_id", (F.size(F.array_except("a", known)) == 0).alias("inside"), F.size("a").between(1, 4).alias("sized"))


@case("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice BETWEEN p_retailprice * 0.5 AND p_retailprice * 20 AND l_extendedprice > 0 AS plausible FROM lineitem JOIN part ON p_partkey = l_partkey")
def plausibility_bounds(spark, sf):
    j = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", (N.plausible(F.col("l_extendedprice"), F.col("p_retailprice"), 0.5, 20.0) & (F.col("l_extendedprice") > 0)).alias("plausible"))


@case(f"WITH s AS ({SERIES_SQL}), d AS (SELECT day, arg_max(flag, rate) AS flag, max(rate) AS rate FROM s GROUP BY 1) SELECT o_orderkey, d.day AS published, flag, rate FROM orders LEFT JOIN d ON d.day = (SELECT max(x.day) FROM d x WHERE x.day <= CAST(o_orderdate AS DATE))", dates=("published",))
def dearest_currency(spark, sf):
    """The currency of the highest rate in the publication that applies on each order's day.  The series is looked up by day, not by order."""
    best = series(spark, sf).groupBy("day").agg(F.max_by("flag", "rate").alias("flag"), F.max("rate").alias("rate"))
    orders = read(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    days = asof.asof_backward(orders.select("day").distinct(), best, "day", [], ["flag", "rate"]).select("day", F.col("matched_at").alias("published"), "flag", "rate")
    return orders.join(days, "day").select("o_orderkey", "published", "flag", "rate")


_REGISTER_SQL = "SELECT flag, day, round(rate, 2) AS rate FROM s WHERE day(day) % 3 > 0"


@case(f"WITH s AS ({SERIES_SQL}), old AS ({_REGISTER_SQL}), new AS (SELECT flag, day, CASE WHEN day(day) % 5 = 0 THEN round(rate, 2) + 1 ELSE round(rate, 2) END AS rate FROM s) SELECT n.flag, n.day, CASE WHEN o.rate IS NULL THEN 'new' WHEN o.rate = n.rate THEN 'unchanged' ELSE 'discrepancy' END AS outcome FROM new n LEFT JOIN old o USING (flag, day)", dates=("day",))
def register_rates(spark, sf):
    s = series(spark, sf).select("flag", "day", F.round("rate", 2).alias("rate"))
    incoming = s.withColumn("rate", F.when(F.dayofmonth("day") % 5 == 0, F.col("rate") + 1).otherwise(F.col("rate")))
    return agenda.registered(s.filter(F.dayofmonth("day") % 3 > 0), incoming, ["flag", "day"], "rate").select("flag", "day", "outcome")


def _duties(spark):
    """Two duties for each last digit in January 2026."""
    day = F.make_date(F.lit(2026), F.lit(1), (F.col("id") + 10).cast("int"))
    return spark.range(10).select(F.col("id").alias("digit"), F.explode(F.array(F.struct(F.lit("iva").alias("duty"), day.alias("due")), F.struct(F.lit("islr").alias("duty"), F.date_add(day, 3).alias("due")))).alias("d")).select("digit", "d.*")


_DUTIES_SQL = "SELECT digit, duty, DATE '2026-01-10' + CAST(digit AS INT) + extra AS due FROM range(0, 10) r(digit), (VALUES ('iva', 0), ('islr', 3)) v(duty, extra)"


@case(f"SELECT c_nationkey AS device, c_custkey AS id, duty, due, due - DATE '2026-01-15' AS moment FROM customer JOIN ({_DUTIES_SQL}) ON digit = c_custkey % 10 WHERE due - DATE '2026-01-15' IN (0, 3) AND NOT (duty = 'iva' AND c_custkey % 4 = 1)", dates=("due",))
def due_notices(spark, sf):
    """Notices of 15 January for duties due that day or three days later, but those sent already."""
    followed = read(spark, sf, "customer").select(F.col("c_nationkey").alias("device"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 10).alias("digit"))
    today = F.lit("2026-01-15").cast("date")
    sent = followed.filter("id % 4 = 1").join(F.broadcast(_duties(spark).filter("duty = 'iva'")), "digit").withColumn("moment", F.datediff("due", today))
    return agenda.due_notices(followed, _duties(spark), ["digit"], today, sent)


@case(f"SELECT due, string_agg(DISTINCT digit, ',' ORDER BY digit) AS digits, count(DISTINCT duty) AS duties FROM ({_DUTIES_SQL}) GROUP BY 1", dates=("due",))
def month_duties(spark, sf):
    """The days of a month with the last digits and the number of different duties due on each."""
    return _duties(spark).groupBy("due").agg(F.array_join(F.transform(F.array_sort(F.collect_set("digit")), lambda d: d.cast("string")), ",").alias("digits"), F.count_distinct("duty").alias("duties"))


@case("SELECT user_id, count(*) AS unread, arg_max(event_id, ts) AS latest FROM events e LEFT JOIN (SELECT user_id, max(ts) AS since FROM events WHERE event_type = 'view' GROUP BY 1) s USING (user_id) WHERE event_type <> 'view' AND (since IS NULL OR ts > since) GROUP BY 1")
def unread_digest(spark, sf):
    e = read(spark, sf, "events")
    seen = e.filter("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return agenda.unread(e.filter("event_type <> 'view'").select("user_id", "ts", "event_id"), seen, "user_id", "ts", "event_id")


@case("SELECT id, kind FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'first' ELSE 'follow_up' END AS kind, DATE '2024-01-01' + CAST(c_custkey % 50 AS INT) AS waits FROM customer WHERE c_mktsegment <> 'FURNITURE' AND c_custkey % 7 > 0 AND (c_custkey % 3 = 0 OR (c_custkey % 3 = 1 AND c_custkey % 2 = 1 AND c_custkey % 50 < 30))) ORDER BY kind = 'first', waits, id LIMIT 10")
def next_recipients(spark, sf):
    k = F.col("c_custkey")
    at = F.date_add(F.lit("2024-01-01").cast("date"), (k % 50).cast("int")).cast("timestamp")
    sector = F.when(F.col("c_mktsegment") == "FURNITURE", "consumer").otherwise(F.col("c_mktsegment"))
    state = F.element_at(F.array(F.lit("pending"), F.lit("contacted"), F.lit("closed")), (k % 3 + 1).cast("int"))
    people = read(spark, sf, "customer").select(k.alias("id"), F.concat(F.lit("A"), k.cast("string"), F.lit("@x.example")).alias("mail"), sector.alias("sector"), state.alias("state"), (k % 2).alias("sends"), F.when(k % 3 == 1, at).alias("last_sent"), at.alias("created"))
    stop = people.filter("id % 7 = 0").select(F.lower("mail").alias("mail"))
    return agenda.next_recipients(people, stop, F.lit("2024-02-10").cast("timestamp"), 10, 10).select("id", "kind")


_PATH = "regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1)"


@case(f"SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY {_HOST} ORDER BY nullif(page_id % 5, 0) DESC NULLS LAST, nullif(page_id % 7, 0) NULLS FIRST, url, page_id) AS n FROM (SELECT *, {_PATH} AS p FROM pages) WHERE regexp_matches(p, '^/en/.*1') OR NOT (starts_with(p, '/en/') OR regexp_matches(p, '2$'))) WHERE n <= 3")
def crawl_frontier(spark, sf):
    """The next three pages of each host under its robots rules."""
    p = read(spark, sf, "pages").withColumn("host", T.host(F.col("url")))
    k = F.col("page_id")
    urls = p.select("host", F.concat("url", F.lit(" "), F.lpad(k.cast("string"), 12, "0")).alias("url"), F.regexp_extract("url", "^https?://[^/?#]+([^#]*)", 1).alias("path"), F.nullif(k % 5, F.lit(0)).alias("priority"), F.nullif(k % 7, F.lit(0)).alias("last_try"), "page_id")
    said = F.array(*[F.struct(F.lit(a).alias("pattern"), F.lit(b).alias("allow")) for a, b in (("/en/", False), ("/en/*1", True), ("/*2$", False))])
    robots = p.select("host").distinct().select("host", F.explode(said).alias("r")).select("host", "r.*")
    return agenda.frontier(urls, robots, 3).select("page_id")


@case("WITH f AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error' AND (ok IS NULL OR ts > ok)) AS failures FROM events LEFT JOIN (SELECT user_id, max(ts) AS ok FROM events WHERE event_type <> 'error' GROUP BY 1) USING (user_id) GROUP BY 1) SELECT user_id, failures, CASE WHEN failures = 0 THEN 0 ELSE CAST(least(60, 2 ** least(failures - 1, 6)) AS INT) END AS minutes FROM f")
def crawl_back_off(spark, sf):
    return agenda.back_off(read(spark, sf, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error")


@case("SELECT event_id, least(ts, TIMESTAMP '2024-01-20') AS ts FROM events WHERE ts >= TIMESTAMP '2024-01-13'")
def late_events(spark, sf):
    return agenda.admitted(read(spark, sf, "events").select("event_id", "ts"), "ts", F.lit("2024-01-20").cast("timestamp"), 7)


@case("SELECT p_type AS item, category, array_to_string(list_sort(list(DISTINCT rule)), ',') AS rules, CASE WHEN count(DISTINCT condition) = 1 AND count(*) = count(condition) THEN min(condition) END AS condition FROM (SELECT p_type, 'r' || p_size % 6 AS rule, CASE p_size % 3 WHEN 0 THEN 'exempt' WHEN 1 THEN 'general' ELSE 'reduced' END AS category, CASE p_size % 3 WHEN 0 THEN 'small' WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'new' ELSE 'old' END END AS condition FROM part) GROUP BY 1, 2")
def merged_options(spark, sf):
    third, size = F.col("p_size") % 3, F.col("p_size") % 6
    category = F.when(third == 0, "exempt").when(third == 1, "general").otherwise("reduced")
    condition = F.when(third == 0, "small").when(third == 1, F.when(F.col("p_partkey") % 2 == 0, "new").otherwise("old"))
    options = read(spark, sf, "part").select(F.col("p_type").alias("item"), F.concat(F.lit("r"), size.cast("string")).alias("rule"), category.alias("category"), condition.alias("condition"))
    out = rules.merged_options(options)
    return out.withColumn("rules", F.array_join("rules", ","))


_TAGS = [("ECONOMY", "cheap", 10), ("Brand#5", "house", 20), ("PROMO", "promo", 20), ("Brand#13", "house", 20)]


@case("SELECT DISTINCT p_partkey, rule, priority FROM (SELECT *, rank() OVER (PARTITION BY p_partkey ORDER BY priority DESC) AS r FROM part JOIN (VALUES " + ", ".join(f"('{t}', '{r}', {p})" for t, r, p in _TAGS) + ") v(tag, rule, priority) ON tag IN (p_type, p_brand)) WHERE r = 1")
def tagged_rules(spark, sf):
    known = spark.createDataFrame(_TAGS, "tag string, rule string, priority int")
    return rules.tagged_rules(read(spark, sf, "part").select("p_partkey", F.array("p_type", "p_brand").alias("tags")), "tags", known)


@case(f"WITH c AS ({CODES_SQL}), r AS ({RULES_SQL}) SELECT p_partkey, max(rule) IS NULL AS fell, CASE WHEN max(rule) IS NULL THEN 16 END AS percent, CASE WHEN max(rule) IS NULL THEN 'conditional' END AS state FROM c LEFT JOIN r ON starts_with(c.code, r.prefix) GROUP BY 1")
def residual_rule(spark, sf):
    known = longest_prefix(codes(spark, sf), "code", prefix_rules(spark, sf), "prefix", range(2, 7)).filter("rule IS NOT NULL").select("code", "rule")
    return rules.residual(codes(spark, sf), known, "code", 16).select("p_partkey", F.col("rule").isNull().alias("fell"), "percent", "state")


@case("SELECT l_orderkey, CAST(coalesce(sum(b) FILTER (WHERE e), 0) AS DOUBLE) AS exempt, CAST(coalesce(sum(b) FILTER (WHERE NOT e), 0) AS DOUBLE) AS taxed, CAST(coalesce(sum(CAST(round(b * 16 * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2))) FILTER (WHERE NOT e), 0) AS DOUBLE) AS tax FROM (SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS b, regexp_matches(p_name, 'bolt|widget') AS e FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1")
def invoice_totals(spark, sf):
    """Exempt and taxed totals of each order and its tax, line by line."""
    lines = read(spark, sf, "lineitem").join(read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").rlike("bolt|widget").alias("e")), "l_partkey")
    base, tax, _ = N.invoice(cents("l_extendedprice"), F.lit(16))
    only = lambda c, holds: F.coalesce(F.sum(F.when(holds, c)), F.lit(0)).cast("double")
    return lines.groupBy("l_orderkey").agg(only(base, F.col("e")).alias("exempt"), only(base, ~F.col("e")).alias("taxed"), only(tax, ~F.col("e")).alias("tax"))


@case(f"SELECT device, id FROM (SELECT c_nationkey AS device, m.id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer JOIN ({MOD11_SQL}) m USING (c_custkey) WHERE m.valid) WHERE n <= 5")
def followed_ids(spark, sf):
    """The first five valid ids that a device follows."""
    checked = mod11_check(spark, sf).filter("valid").join(read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("device")), "c_custkey")
    return top_per_key(checked, ["device"], [F.col("c_custkey")], 5).select("device", "id")


@case(f"SELECT c_custkey, n_name, r_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS buys, CASE WHEN c_acctbal > 5000 THEN 'special' WHEN c_acctbal > 0 THEN 'ordinary' ELSE 'none' END AS segment FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE contains({norm_sql('c_name')}, 'customer') AND contains({norm_sql('c_name')}, '7')")
def directory_search(spark, sf):
    """Entries with all words of a search, their place, whether they buy and the segment to suggest."""
    c, n, r = (read(spark, sf, t) for t in ("customer", "nation", "region"))
    for word in ("customer", "7"):
        c = c.filter(T.normal(F.col("c_name")).contains(word))
    buyers = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_b", F.lit(True))
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    segment = F.when(F.col("c_acctbal") > 5000, "special").when(F.col("c_acctbal") > 0, "ordinary").otherwise("none")
    return c.join(places, "c_nationkey").join(buyers, "c_custkey", "left").select("c_custkey", "n_name", "r_name", F.coalesce("_b", F.lit(False)).alias("buys"), segment.alias("segment"))
