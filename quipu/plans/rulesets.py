"""Data-quality rule sets over the driver tables: each rule is the query of its violating keys, beside the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quipu.operators import merge, quality
from quipu.plans.registry import Registry, read

R = Registry()
case = R.case
Rule = tuple[str, Callable[[Callable[[str], DataFrame]], DataFrame], str]


def rule_set(name: str, doc: str, rules: list[Rule]) -> None:
    """Registers a report with a row per rule: violations and the first violating key."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        table = lambda t: read(spark, sf, t)
        return quality.report(*(quality.found(rule, query(table)) for rule, query, _ in rules))

    run.__name__, run.__doc__ = name, doc
    case(" UNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) AS violations, min(CAST(k AS VARCHAR)) AS first FROM ({sql}) AS v(k)" for rule, _, sql in rules))(run)


def lost(t, child: str, key: str, parent: str, parent_key: str) -> DataFrame:
    """Keys of the child that the parent does not have."""
    return t(child).filter(F.col(key).isNotNull()).select(key).join(t(parent).select(F.col(parent_key).alias(key)), key, "left_anti")


def many(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1").select(keys[0])


rule_set("dq_tariff", "The catalogue of parts as a tariff: range, parents, leaves, nulls, shares, leakage, coverage.", [
    ("code range", lambda t: t("part").filter("NOT p_partkey BETWEEN 0 AND 999999").select("p_partkey"), "SELECT p_partkey FROM part WHERE NOT p_partkey BETWEEN 0 AND 999999"),
    ("orphan line", lambda t: lost(t, "lineitem", "l_partkey", "part", "p_partkey"), "SELECT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)"),
    ("leaf without price", lambda t: t("part").filter("p_retailprice IS NULL OR p_retailprice <= 0").select("p_partkey"), "SELECT p_partkey FROM part WHERE p_retailprice IS NULL OR p_retailprice <= 0"),
    ("null description", lambda t: t("part").filter("p_name IS NULL OR trim(p_name) = ''").select("p_partkey"), "SELECT p_partkey FROM part WHERE p_name IS NULL OR trim(p_name) = ''"),
    ("over 40 percent of a brand unsold", lambda t: t("part").join(t("lineitem").select("l_partkey").distinct(), F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("p_brand").agg(F.avg(F.col("l_partkey").isNull().cast("int")).alias("s")).filter("s > 0.4").select("p_brand"),
     "SELECT p_brand FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem) ON p_partkey = l_partkey GROUP BY 1 HAVING avg(CASE WHEN l_partkey IS NULL THEN 1 ELSE 0 END) > 0.4"),
    ("text leakage", lambda t: t("part").filter(F.col("p_name").rlike("[0-9]|page")).select("p_partkey"), "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '[0-9]|page')"),
    ("column leakage", lambda t: t("part").filter(F.contains(F.col("p_name"), F.lower("p_type"))).select("p_partkey"), "SELECT p_partkey FROM part WHERE contains(p_name, lower(p_type))"),
    ("name of two brands", lambda t: t("part").groupBy("p_name").agg(F.count_distinct("p_brand").alias("n")).filter("n > 1").select("p_name"), "SELECT p_name FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1"),
    ("history against tree", lambda t: t("part").select("p_partkey").join(t("lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti"), "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)"),
    ("gap in the codes", lambda t: t("part").agg(F.max("p_partkey").alias("m"), F.count(F.lit(1)).alias("n")).filter("m + 1 <> n").select("m"), "SELECT max(p_partkey) FROM part HAVING max(p_partkey) + 1 <> count(*)"),
])

DAILY = "(SELECT l_returnflag AS flag, CAST(l_shipdate AS DATE) AS day, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1, 2)"


def daily(t) -> DataFrame:
    return t("lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


rule_set("dq_rates", "The daily series: positive, bid below ask, both series present, one publication a day, gaps.", [
    ("not positive", lambda t: t("lineitem").filter("NOT l_extendedprice > 0").select("l_orderkey"), "SELECT l_orderkey FROM lineitem WHERE NOT l_extendedprice > 0"),
    ("bid above ask", lambda t: daily(t).filter("low > high").select("day"), f"SELECT day FROM {DAILY} WHERE low > high"),
    ("day without both", lambda t: daily(t).groupBy("day").agg(F.count_if(F.col("flag").isin("A", "R")).alias("c")).filter("c < 2").select("day"), f"SELECT day FROM {DAILY} GROUP BY 1 HAVING count(*) FILTER (WHERE flag IN ('A', 'R')) < 2"),
    ("published twice", lambda t: many(t("lineitem"), "l_orderkey", "l_linenumber"), "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"),
    ("far from the day before", lambda t: daily(t).withColumn("b", F.lag("high").over(Window.partitionBy("flag").orderBy("day"))).filter("high > 3 * b").select("day"), f"SELECT day FROM (SELECT *, lag(high) OVER (PARTITION BY flag ORDER BY day) AS b FROM {DAILY}) WHERE high > 3 * b"),
    ("gap over a week", lambda t: daily(t).withColumn("b", F.lag("day").over(Window.partitionBy("flag").orderBy("day"))).filter("datediff(day, b) > 7").select("day"), f"SELECT day FROM (SELECT *, lag(day) OVER (PARTITION BY flag ORDER BY day) AS b FROM {DAILY}) WHERE day - b > 7"),
])

rule_set("dq_calendar", "Order dates as a calendar: weekends, bounds, every month, one priority set a year.", [
    ("weekend", lambda t: t("orders").filter("dayofweek(o_orderdate) IN (1, 7)").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE dayofweek(o_orderdate) IN (0, 6)"),
    ("null date", lambda t: t("orders").filter("o_orderdate IS NULL").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderdate IS NULL"),
    ("month missing in a year", lambda t: t("orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count_distinct(F.month("o_orderdate")).alias("m")).filter("m < 12").select("y"), "SELECT year(o_orderdate) FROM orders GROUP BY 1 HAVING count(DISTINCT month(o_orderdate)) < 12"),
    ("second half without orders", lambda t: t("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg(F.count_if(F.dayofmonth("o_orderdate") > 15).alias("c")).filter("c = 0").select("ym"), "SELECT strftime(o_orderdate, '%Y-%m') FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE day(o_orderdate) > 15) = 0"),
    ("priority not every year", lambda t: t("orders").groupBy("o_orderpriority").agg(F.count_distinct(F.year("o_orderdate")).alias("c")).filter("c < 2").select("o_orderpriority"), "SELECT o_orderpriority FROM orders GROUP BY 1 HAVING count(DISTINCT year(o_orderdate)) < 2"),
    ("shipped before ordered", lambda t: t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).filter("l_shipdate < o_orderdate").select("l_orderkey"), "SELECT l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate"),
])

rule_set("dq_transcription", "Each last digit of the customer's key, 0 to 9, is covered in every month.", [
    ("digit missing in a month", lambda t: t("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg(F.count_distinct(F.col("o_custkey") % 10).alias("c")).filter("c < 10").select("ym"), "SELECT strftime(o_orderdate, '%Y-%m') FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey % 10) < 10"),
    ("half-month bound", lambda t: t("orders").filter("dayofmonth(o_orderdate) NOT BETWEEN 1 AND 31").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE day(o_orderdate) NOT BETWEEN 1 AND 31"),
])

rule_set("dq_directory", "Customers and suppliers as a directory: counts, duplicates, sources, totals by region.", [
    ("repeated name", lambda t: many(t("customer"), "c_name"), "SELECT c_name FROM customer GROUP BY 1 HAVING count(*) > 1"),
    ("customer of no nation", lambda t: lost(t, "customer", "c_nationkey", "nation", "n_nationkey"), "SELECT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)"),
    ("supplier of no nation", lambda t: lost(t, "supplier", "s_nationkey", "nation", "n_nationkey"), "SELECT s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)"),
    ("nation of no region", lambda t: lost(t, "nation", "n_regionkey", "region", "r_regionkey"), "SELECT n_regionkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)"),
    ("name against key", lambda t: t("customer").filter("c_name <> concat('Customer#', lpad(CAST(c_custkey AS STRING), 9, '0'))").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_name <> 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')"),
    ("region without suppliers", lambda t: t("nation").join(t("supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_regionkey").agg(F.count("s_suppkey").alias("c")).filter("c = 0").select("n_regionkey"), "SELECT n_regionkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1 HAVING count(s_suppkey) = 0"),
])

rule_set("dq_vat_catalogue", "Line taxes as a catalogue of rates: allowed rates, one rate a line, every rate used, flags, statuses.", [
    ("rate not allowed", lambda t: t("lineitem").filter("NOT l_tax IN (0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08)").select("l_orderkey"), "SELECT l_orderkey FROM lineitem WHERE NOT l_tax IN (0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08)"),
    ("discount above rate", lambda t: t("lineitem").filter("l_discount > 0.09 AND l_tax < 0.01").select("l_orderkey"), "SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09 AND l_tax < 0.01"),
    ("part of one rate only", lambda t: t("lineitem").groupBy("l_partkey").agg(F.count_distinct("l_tax").alias("c"), F.count(F.lit(1)).alias("n")).filter("c = 1 AND n > 5").select("l_partkey"), "SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_tax) = 1 AND count(*) > 5"),
    ("unknown flag", lambda t: t("lineitem").filter("NOT l_returnflag IN ('A', 'N', 'R')").select("l_orderkey"), "SELECT l_orderkey FROM lineitem WHERE NOT l_returnflag IN ('A', 'N', 'R')"),
    ("status against flag", lambda t: t("lineitem").filter("l_linestatus = 'O' AND l_returnflag = 'R'").select("l_orderkey"), "SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'R'"),
    ("order without lines", lambda t: t("orders").select("o_orderkey").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti"), "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"),
])

WORDS = "(SELECT DISTINCT p_type, unnest(string_split(p_name, ' ')) AS w FROM part)"


def type_words(t) -> DataFrame:
    return t("part").select("p_type", F.explode(F.split("p_name", " ")).alias("w")).distinct()


rule_set("dq_dictionary", "Words of names as a dictionary of types: length, form, words of several types, plurals, type without words.", [
    ("short term", lambda t: type_words(t).filter("length(w) < 4").select("w"), f"SELECT w FROM {WORDS} WHERE length(w) < 4"),
    ("not plain", lambda t: type_words(t).filter("NOT w RLIKE '^[a-z]+$'").select("w"), f"SELECT w FROM {WORDS} WHERE NOT regexp_matches(w, '^[a-z]+$')"),
    ("term of several types", lambda t: many(type_words(t), "w"), f"SELECT w FROM {WORDS} GROUP BY 1 HAVING count(*) > 1"),
    ("term with its plural", lambda t: type_words(t).select("w").distinct().alias("a").join(type_words(t).select(F.col("w").alias("p")).distinct(), F.concat("w", F.lit("s")) == F.col("p")).select("w"), f"SELECT a.w FROM (SELECT DISTINCT w FROM {WORDS}) a JOIN (SELECT DISTINCT w FROM {WORDS}) b ON a.w || 's' = b.w"),
])

rule_set("dq_third_party", "Another source's prices against one's own: exactness, conflicts, duplicates, truncation, missing values.", [
    ("price against list", lambda t: t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).filter("abs(l_extendedprice - l_quantity * p_retailprice) > 0.05 * l_extendedprice").select("l_orderkey"), "SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE abs(l_extendedprice - l_quantity * p_retailprice) > 0.05 * l_extendedprice"),
    ("order twice on a part", lambda t: many(t("lineitem"), "l_orderkey", "l_partkey"), "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1"),
    ("conflicting discounts", lambda t: t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count_distinct("l_discount").alias("c")).filter("c > 1").select("l_orderkey"), "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(DISTINCT l_discount) > 1"),
    ("cut name", lambda t: t("part").filter("length(p_name) >= 40").select("p_partkey"), "SELECT p_partkey FROM part WHERE length(p_name) >= 40"),
    ("missing regime", lambda t: t("lineitem").filter("l_returnflag IS NULL OR l_linestatus IS NULL").select("l_orderkey"), "SELECT l_orderkey FROM lineitem WHERE l_returnflag IS NULL OR l_linestatus IS NULL"),
])

rule_set("dq_extraction", "Extracted events: dates, headers, positive values, publications, monotone order.", [
    ("without time", lambda t: t("events").filter("ts IS NULL").select("event_id"), "SELECT event_id FROM events WHERE ts IS NULL"),
    ("not an object", lambda t: t("events").filter("NOT props LIKE '{%}'").select("event_id"), "SELECT event_id FROM events WHERE NOT props LIKE '{%}'"),
    ("not positive", lambda t: t("events").filter("value <= 0").select("event_id"), "SELECT event_id FROM events WHERE value <= 0"),
    ("published twice", lambda t: many(t("events"), "user_id", "ts"), "SELECT user_id FROM events GROUP BY user_id, ts HAVING count(*) > 1"),
    ("value out of falling order", lambda t: quality.unordered(t("events"), ["user_id"], "event_id", "value").select("event_id"), "SELECT event_id FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE value > b"),
])

FORMATS = {("customer", "c_custkey", "c_name"): "^Customer#[0-9]{9}$", ("supplier", "s_suppkey", "s_name"): "^Supplier#[0-9]{9}$", ("part", "p_partkey", "p_brand"): "^Brand#[0-9]+$", ("part", "p_partkey", "p_type"): "^[A-Z ]+$", ("orders", "o_orderkey", "o_orderpriority"): "^[1-5]-[A-Z ]+$", ("nation", "n_nationkey", "n_name"): "^NATION_[0-9]+$"}
rule_set("dq_formats", "Fields by their patterns.", [
    (column, lambda t, table=table, key=key, column=column, pattern=pattern: t(table).filter(~F.col(column).rlike(pattern)).select(key), f"SELECT {key} FROM {table} WHERE NOT regexp_matches({column}, '{pattern}')")
    for (table, key, column), pattern in FORMATS.items()
])


@case("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE NOT s_nationkey < 5 UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_nationkey < 5")
def partial_replace(spark, sf):
    """The suppliers of five nations give way to their customers."""
    batch = read(spark, sf, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"), F.col("c_nationkey").alias("s_nationkey"), F.col("c_acctbal").alias("s_acctbal"))
    return merge.replace_part(read(spark, sf, "supplier"), batch, F.col("s_nationkey") < 5)


@case("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 0, 1.0 FROM orders WHERE o_orderstatus = 'P'")
def replace_children(spark, sf):
    """The lines of pending orders give way to one line each."""
    batch = read(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"))
    return merge.replace_children(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), batch, ["l_orderkey"])


@case("SELECT p_partkey, p_brand, CASE WHEN p_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 15) THEN 0.0 ELSE p_retailprice END AS p_retailprice FROM part")
def update_ranked_subset(spark, sf):
    """The 15 dearest small parts are read anew."""
    p = read(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    return merge.update_first(p, F.col("p_size") < 10, [F.desc("p_retailprice"), F.col("p_partkey")], 15, ["p_partkey"], {"p_retailprice": F.lit(0.0)}).drop("p_size")


QUOTES_SQL = "SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag AS currency, round(avg(CAST(l_extendedprice AS DECIMAL(18,2))), 2) AS rate FROM lineitem GROUP BY 1, 2"


@case(f"WITH q AS ({QUOTES_SQL}) SELECT q.day, q.currency, abs(q.rate / u.rate - round(q.rate / u.rate, 3)) > 0.0005 * (q.rate / u.rate) AS deviates FROM q JOIN q u ON u.day = q.day AND u.currency = 'A' WHERE q.currency <> 'A'", dates=("day",))
def cross_rates(spark, sf):
    """Does a published cross rate (three places) stay within 0.05 % of the quotient of two rates?"""
    q = read(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"), F.col("l_returnflag").alias("currency")).agg(F.round(F.avg("l_extendedprice"), 2).alias("rate"))
    lead = q.filter("currency = 'A'").select("day", F.col("rate").alias("usd"))
    cross = F.col("rate") / F.col("usd")
    return q.filter("currency <> 'A'").join(lead, "day").select("day", "currency", (F.abs(cross - F.round(cross, 3)) > 0.0005 * cross).alias("deviates"))


@case("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_returnflag = 'A' THEN p_retailprice ELSE l_extendedprice / l_quantity END, l_extendedprice) AS price, l_returnflag <> 'A' AND p_size > 40 AS warned FROM lineitem JOIN part ON p_partkey = l_partkey")
def threshold_price(spark, sf):
    """The price that a threshold is held against: the list price of sales, the unit price of purchases; large parts bought are warned of."""
    l = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    price = F.when(F.col("l_returnflag") == "A", F.col("p_retailprice")).otherwise(F.col("l_extendedprice") / F.col("l_quantity"))
    return l.select("l_orderkey", "l_linenumber", F.coalesce(price, "l_extendedprice").alias("price"), ((F.col("l_returnflag") != "A") & (F.col("p_size") > 40)).alias("warned"))


@case("WITH w AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 400 DAY) SELECT p_partkey, p_name, l_extendedprice AS last_price FROM part JOIN w ON l_partkey = p_partkey AND n = 1 WHERE contains(p_name, 'small') AND contains(p_name, 'ring')")
def index_search(spark, sf):
    """Products whose names have all words, with their last price of the last 400 days."""
    l = read(spark, sf, "lineitem")
    latest = l.agg(F.max("l_shipdate").alias("m"))
    recent = l.crossJoin(F.broadcast(latest)).filter("l_shipdate >= m - INTERVAL 400 DAYS")
    found = read(spark, sf, "part").filter(F.forall(F.array(F.lit("small"), F.lit("ring")), lambda w: F.contains(F.col("p_name"), w)))
    last = recent.join(found.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").groupBy("l_partkey").agg(F.max_by("l_extendedprice", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("last_price"))
    return found.join(last, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_name", "last_price")
