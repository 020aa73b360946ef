"""The load validations over the driver's tables in the shapes of rates, duties and a directory; each rule finds something."""

from __future__ import annotations

from pyspark.sql import functions as F

from quipu.operators import validations
from quipu.plans.registry import Registry, read

R = Registry()
case = R.case


def _report_sql(ctes: str, rules: dict[str, str]) -> str:
    return f"WITH {ctes} " + " UNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) AS violations, min(CAST(k AS VARCHAR)) AS first FROM ({sql}) AS v(k)" for rule, sql in rules.items())


_RATES_SQL = """rates AS (SELECT CAST(l_shipdate AS DATE) AS day, CASE l_returnflag WHEN 'A' THEN 'USD' WHEN 'R' THEN 'EUR' ELSE 'CNY' END AS currency, min(l_extendedprice) AS buy, max(l_extendedprice) AS sell FROM lineitem GROUP BY 1, 2),
pubs AS (SELECT DISTINCT day, day - 1 AS traded FROM rates), old AS (SELECT day, currency, CASE WHEN day(day) % 5 > 0 THEN buy + CASE WHEN day(day) = 7 THEN 1 ELSE 0 END END AS buy, sell + CASE WHEN day(day) = 13 THEN 1 ELSE 0 END AS sell FROM rates WHERE year(day) < 2000),
oldp AS (SELECT day, traded - CASE WHEN dayofyear(day) % 50 = 0 THEN 1 ELSE 0 END AS traded FROM pubs WHERE year(day) < 2000), src AS (SELECT strftime(day, '%Y-%m') AS file, md5(CAST(count(*) AS VARCHAR)) AS sha256 FROM rates GROUP BY 1)"""


@case(_report_sql(_RATES_SQL, {
    "V1 counts": "SELECT 'publications'", "V2 rate contradicts": "SELECT CAST(day AS VARCHAR) || ' ' || currency FROM rates n JOIN old o USING (day, currency) WHERE n.sell <> o.sell OR (o.buy IS NOT NULL AND n.buy <> o.buy)", "V2 trading day contradicts": "SELECT day FROM pubs n JOIN oldp o USING (day) WHERE n.traded <> o.traded",
    "V3 leading currency missing": "SELECT day FROM pubs LEFT JOIN rates USING (day) GROUP BY day HAVING count(DISTINCT currency) FILTER (WHERE currency IN ('USD', 'EUR')) < 2", "V4 last rate": "SELECT m.day FROM (SELECT max(day) AS day, -1.0 AS sell FROM rates) m LEFT JOIN rates r ON r.day = m.day AND currency = 'USD' WHERE m.sell IS DISTINCT FROM r.sell",
    "V5 file with other content": "SELECT file FROM src WHERE file LIKE '%-03'", "V6 silent day with a publication": "SELECT day FROM pubs WHERE day(day) = 29",
}))
def load_rates(spark, sf):
    """Daily prices as a load of rates against an older one that differs on some days; the manifest counts one publication too many."""
    l = read(spark, sf, "lineitem")
    currency = F.when(F.col("l_returnflag") == "A", "USD").when(F.col("l_returnflag") == "R", "EUR").otherwise("CNY")
    rates = l.groupBy(F.to_date("l_shipdate").alias("day"), currency.alias("currency")).agg(F.min("l_extendedprice").alias("buy"), F.max("l_extendedprice").alias("sell"))
    pubs = rates.select("day").distinct().withColumn("traded", F.date_sub("day", 1))
    before, d = F.year("day") < 2000, F.dayofmonth("day")
    old = rates.filter(before).select("day", "currency", F.when(d % 5 > 0, F.col("buy") + F.when(d == 7, 1).otherwise(0)).alias("buy"), (F.col("sell") + F.when(d == 13, 1).otherwise(0)).alias("sell"))
    oldp = pubs.filter(before).select("day", F.date_sub("traded", F.when(F.dayofyear("day") % 50 == 0, 1).otherwise(0)).alias("traded"))
    src = rates.groupBy(F.date_format("day", "yyyy-MM").alias("file")).agg(F.md5(F.count(F.lit(1)).cast("string")).alias("sha256"))
    olds = src.withColumn("sha256", F.when(F.col("file").endswith("-03"), "other").otherwise(F.col("sha256")))
    counts = rates.agg(F.lit("rates").alias("name"), F.count(F.lit(1)).alias("rows")).unionByName(pubs.agg(F.lit("publications").alias("name"), (F.count(F.lit(1)) + 1).alias("rows")))
    silent = pubs.select("day").filter(d == 29)
    return validations.rates_load(rates, pubs, src, silent, old, oldp, olds, counts, rates.agg(F.max("day").alias("day"), F.lit(-1.0).alias("sell")))


_DUE_SQL = """h AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, c_nationkey % 2 = 0 AS national FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 97 = 0), hd AS (SELECT day, bool_or(national) AS national FROM h GROUP BY 1),
due AS (SELECT 'duty' || o_orderpriority[1] AS duty, o_custkey % 10 AS terminal, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 1 + CAST(o_orderkey % 2 AS INTEGER) END AS extended, CAST(date_trunc('month', o_orderdate) AS DATE) - CASE WHEN o_orderkey % 4 = 0 THEN 20 ELSE 0 END AS since,
  CAST(date_trunc('month', o_orderdate) AS DATE) - 1 - CASE WHEN o_orderkey % 5 = 0 THEN 40 ELSE 0 END AS until FROM orders),
nx AS (SELECT day, (SELECT min(CAST(x AS DATE)) FROM range(day + 1, day + 32, INTERVAL 1 DAY) r(x) WHERE isodow(x) < 6 AND CAST(x AS DATE) NOT IN (SELECT day FROM hd)) AS open FROM hd),
pd AS (SELECT DISTINCT day, until FROM due WHERE duty = 'duty3'), po AS (SELECT until, (SELECT min(CAST(x AS DATE)) FROM range(until + 15, until + 46, INTERVAL 1 DAY) r(x) WHERE isodow(x) < 6 AND CAST(x AS DATE) NOT IN (SELECT day FROM hd)) AS open FROM (SELECT DISTINCT until FROM pd))"""
_KEY = "duty || ' ' || terminal || ' ' || CAST(day AS VARCHAR)"


@case(_report_sql(_DUE_SQL, {
    "V1 counts": "SELECT 'due'", "V2 due on a closed day": f"SELECT {_KEY} FROM due LEFT JOIN hd USING (day) WHERE isodow(day) > 5 OR coalesce(national, false)", "V3 two a terminal and month": "SELECT duty || ' ' || terminal || ' ' || CAST(m AS VARCHAR) FROM (SELECT duty, terminal, CAST(date_trunc('month', day) AS DATE) AS m FROM due GROUP BY ALL HAVING count(*) > 1)",
    "V4 terminals missing": "SELECT duty FROM (SELECT duty FROM due WHERE duty <> 'duty4' GROUP BY duty, date_trunc('month', day) HAVING count(DISTINCT terminal) <> 10 UNION SELECT duty FROM due WHERE duty = 'duty4' GROUP BY duty HAVING count(DISTINCT terminal) <> 10 OR count(*) <> 10)",
    "V5 half months": f"SELECT {_KEY} FROM due WHERE (duty = 'duty1' AND (day(day) < 16 OR date_trunc('month', since) <> date_trunc('month', day))) OR (duty = 'duty2' AND (day(day) > 16 OR date_trunc('month', until) + INTERVAL 1 MONTH <> date_trunc('month', day)))",
    "V6 ordinary due day": "SELECT day FROM pd JOIN po USING (until) WHERE open IS DISTINCT FROM day", "V7 twins differ": "SELECT terminal || ' ' || CAST(day AS VARCHAR) FROM ((SELECT terminal, day FROM due WHERE duty = 'duty5' EXCEPT SELECT terminal, day FROM due WHERE duty = 'duty4') UNION ALL (SELECT terminal, day FROM due WHERE duty = 'duty4' EXCEPT SELECT terminal, day FROM due WHERE duty = 'duty5'))",
    "V8 extension": f"SELECT {_KEY} FROM due LEFT JOIN hd USING (day) LEFT JOIN nx USING (day) WHERE (extended IS NOT NULL) <> (national IS NOT NULL) OR extended <> open",
}))
def load_calendar(spark, sf):
    """Orders as due days of five duties; some order days are holidays, of some of them only of banks."""
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer")
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    holidays = o.filter(k % 97 == 0).join(c, F.col("c_custkey") == F.col("o_custkey")).groupBy(day.alias("day")).agg(F.bool_or(F.col("c_nationkey") % 2 == 0).alias("national"))
    start = F.trunc("o_orderdate", "month")
    due = o.select(
        F.concat(F.lit("duty"), F.substring("o_orderpriority", 1, 1)).alias("duty"), (F.col("o_custkey") % 10).alias("terminal"), day.alias("day"), F.when(k % 3 == 0, F.date_add(day, (1 + k % 2).cast("int"))).alias("extended"),
        F.date_sub(start, F.when(k % 4 == 0, 20).otherwise(0)).alias("since"), F.date_sub(start, F.when(k % 5 == 0, 41).otherwise(1)).alias("until"),
    )
    manifest = due.agg(F.lit("due").alias("name"), (F.count(F.lit(1)) - 1).alias("rows"))
    return validations.calendar_load(due, holidays, manifest, ["duty4"], ["duty1"], ["duty2"], "duty3", [("duty5", "duty4")])


_DIR_SQL = """payer AS (SELECT o_custkey AS id, sum(CAST(round(o_totalprice * 100) AS BIGINT)) + CASE WHEN o_custkey % 17 = 0 THEN 1 ELSE 0 END AS cents, count(DISTINCT o_orderpriority) + CASE WHEN o_custkey % 19 = 0 THEN 1 ELSE 0 END AS regions FROM orders GROUP BY o_custkey),
reg AS (SELECT o_custkey AS id, o_orderpriority AS region, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1, 2)"""


@case(_report_sql(_DIR_SQL, {
    "V1 counts": "SELECT 'software'", "V2 address twice": "SELECT k FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier) AND c_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = c_custkey) AND c_custkey % 2 = 0)",
    "V3 source without its row": "SELECT c_custkey FROM customer WHERE (c_nationkey < 10) <> (c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) OR (c_acctbal > 5000) <> (c_custkey IN (SELECT s_suppkey FROM supplier))", "V4 totals": "SELECT id FROM payer LEFT JOIN (SELECT id, sum(cents) AS s, count(*) AS n FROM reg GROUP BY id) USING (id) WHERE cents IS DISTINCT FROM s OR regions <> n",
}))
def load_directory(spark, sf):
    """Customers as a directory of two sources, their nations as addresses, orders as payments by region."""
    c, s, o = (read(spark, sf, t) for t in ("customer", "supplier", "orders"))
    sources = F.array_compact(F.array(F.when(F.col("c_nationkey") < 10, "importers"), F.when(F.col("c_acctbal") > 5000, "software")))
    taxpayers = c.select(F.col("c_custkey").alias("id"), sources.alias("sources"))
    listed = {"importers": o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).distinct(), "software": s.select(F.col("s_suppkey").alias("id"))}
    street = lambda n, even: F.concat(F.when(even, "Street ").otherwise("street no "), n.cast("string"))
    addresses = c.select(F.col("c_custkey").alias("id"), street(F.col("c_nationkey"), F.lit(True)).alias("street"), F.lit(None).cast("string").alias("phone"))
    k = F.col("s_suppkey")
    addresses = addresses.unionByName(s.select(k.alias("id"), F.upper(street(F.col("s_nationkey"), k % 2 == 0)).alias("street"), F.lit("").alias("phone")))
    cents, k = F.round(F.col("o_totalprice") * 100).cast("long"), F.col("o_custkey")
    payers = o.groupBy(k.alias("id")).agg((F.sum(cents) + F.when(F.col("o_custkey") % 17 == 0, 1).otherwise(0)).alias("cents"), (F.count_distinct("o_orderpriority") + F.when(F.col("o_custkey") % 19 == 0, 1).otherwise(0)).alias("regions"))
    regions = o.groupBy(k.alias("id"), F.col("o_orderpriority").alias("region")).agg(F.sum(cents).alias("cents"))
    tables = {"taxpayers": taxpayers, "addresses": addresses, "payers": payers, "regions": regions, "importers": listed["importers"]}
    manifest = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
        manifest = row if manifest is None else manifest.unionByName(row)
    return validations.directory_load(taxpayers, listed, addresses, payers, regions, manifest)
