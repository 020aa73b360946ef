"""Relational core: filters, joins, aggregates, windows, sorting, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quipu.functions.dates import civil_day
from quipu.functions.numbers import dec
from quipu.operators import asof, relational
from quipu.plans.registry import Registry, read

R = Registry()
case = R.case
cents = lambda c: dec(F.col(c), 2)

#: Daily mean price per return flag, standing for a rate series by date and currency.
SERIES_SQL = "SELECT l_returnflag AS flag, CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS rate FROM lineitem GROUP BY 1, 2"


def series(spark, sf):
    daily = read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("day"))
    return daily.agg((F.sum(cents("l_extendedprice")).cast("double") / F.count(F.lit(1))).alias("rate"))


def dated_orders(spark, sf):
    """Orders with a flag that picks a series."""
    flag = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return read(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), flag.alias("flag"))


ORDERS_SQL = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, ['A','N','R'][CAST(o_orderkey % 3 + 1 AS INT)] AS flag FROM orders"


@case("SELECT o_orderkey AS order_key, o_totalprice AS price, o_orderpriority AS priority FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW'")
def scan_project_filter(spark, sf):
    o = read(spark, sf, "orders").filter(F.col("o_totalprice").between(1000, 200000) & F.col("o_orderstatus").isin("F", "O") & (F.col("o_orderpriority") != "5-LOW"))
    return o.select(F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))


@case("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_optional(spark, sf, segment="BUILDING", nation=None):
    out = read(spark, sf, "customer")
    for column, value in (("c_mktsegment", segment), ("c_nationkey", nation)):
        out = out if value is None else out.filter(F.col(column) == value)
    return out.select("c_custkey", "c_mktsegment")


@case("SELECT d.doc_id, l.quality, d.lang IS NOT DISTINCT FROM CASE WHEN d.doc_id % 2 = 0 THEN 'en' END AS same_lang FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM 1")
def filter_null_safe(spark, sf):
    d, l = read(spark, sf, "documents").select("doc_id", "lang"), read(spark, sf, "labels").select("doc_id", "quality")
    out = d.join(l, "doc_id", "left").filter(~F.col("quality").eqNullSafe(F.lit(1)))
    return out.select("doc_id", "quality", F.col("lang").eqNullSafe(F.when(F.col("doc_id") % 2 == 0, "en")).alias("same_lang"))


@case("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, nullif(c_mktsegment, 'MACHINERY') AS segment, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'other') AS named FROM customer WHERE CASE WHEN c_nationkey < 10 THEN c_acctbal > 0 ELSE true END")
def filter_case(spark, sf):
    c, segment = read(spark, sf, "customer"), F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY"))
    band = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") < 5000, "low").otherwise("high")
    kept = c.filter(F.when(F.col("c_nationkey") < 10, F.col("c_acctbal") > 0).otherwise(True))
    return kept.select("c_custkey", band.alias("band"), segment.alias("segment"), F.coalesce(segment, F.lit("other")).alias("named"))


@case("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%red%' AND p_name LIKE '%ring%'")
def filter_like_all_words(spark, sf, wanted=("red", "ring")):
    return read(spark, sf, "part").filter(F.forall(F.array(*map(F.lit, wanted)), lambda w: F.contains(F.col("p_name"), w))).select("p_partkey", "p_name")


@case("SELECT p_partkey FROM part WHERE lpad(CAST(p_partkey AS VARCHAR), 6, '0') LIKE '0001%' OR lpad(CAST(p_partkey AS VARCHAR), 6, '0') LIKE '00005%'")
def filter_like_any_prefix(spark, sf):
    code = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    return read(spark, sf, "part").filter(F.exists(F.array(F.lit("0001"), F.lit("00005")), lambda p: F.startswith(code, p))).select("p_partkey")


@case(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\b(license|licensed)\b') AND NOT regexp_matches(text, '\d{6}')")
def filter_regex_word(spark, sf):
    return read(spark, sf, "documents").filter(F.col("text").rlike(r"(?i)\b(license|licensed)\b") & ~F.col("text").rlike(r"\d{6}")).select("doc_id")


@case("SELECT user_id, array_to_string(list_sort(types), ',') AS types FROM (SELECT user_id, list(DISTINCT event_type) AS types FROM events GROUP BY 1) WHERE list_contains(types, 'error') AND NOT list_has_all(['click', 'error', 'view'], types)")
def filter_array_contains(spark, sf):
    e = read(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("t"))
    outside = F.size(F.array_except("t", F.array(F.lit("click"), F.lit("error"), F.lit("view")))) > 0
    return e.filter(F.array_contains("t", "error") & outside).select("user_id", F.array_join("t", ",").alias("types"))


@case("SELECT user_id, day, array_to_string(list_sort(types), ',') AS types FROM (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, list(DISTINCT event_type) AS types FROM events GROUP BY 1, 2) WHERE list_has_all(types, ['error', 'purchase']) AND NOT list_contains(types, 'view')")
def filter_array_contains_by_day(spark, sf):
    """The set of kinds of each user and day over all events: errors and purchases, no views."""
    e = read(spark, sf, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("t"))
    kept = F.array_contains("t", "error") & F.array_contains("t", "purchase") & ~F.array_contains("t", "view")
    return e.filter(kept).select("user_id", "day", F.array_join("t", ",").alias("types"))


@case("SELECT t AS topic, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS t FROM part) GROUP BY 1")
def explode_count(spark, sf):
    return read(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@case("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 50")
def json_field_filter(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf, "events").select("event_id", k.alias("k")).filter("k >= 50")


@case("SELECT r_regionkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS ordinal, n_nationkey AS id, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_rows_expand(spark, sf):
    """Rows packed as one JSON array per region, read back as typed rows with their place."""
    packed = read(spark, sf, "nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))))).alias("j"))
    rows = packed.select(F.col("n_regionkey").alias("r_regionkey"), F.posexplode(F.from_json("j", "array<struct<id:int,name:string>>")).alias("i", "row"))
    return rows.select("r_regionkey", (F.col("i") + 1).alias("ordinal"), "row.id", "row.name")


@case("SELECT n_name, r_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= DATE '1997-01-01' GROUP BY 1, 2")
def join_inner_4way(spark, sf):
    l, o, c, n, r = (read(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    placed = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")
    bought = o.filter("o_orderdate >= DATE'1997-01-01'").select("o_orderkey", "o_custkey").join(placed, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name", "r_name")
    joined = l.select("l_orderkey", cents("l_extendedprice").alias("price")).join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("n_name", "r_name").agg(F.sum("price").cast("double").alias("total"), F.count(F.lit(1)).alias("lines"))


@case("SELECT c_custkey, count(o_orderkey) AS orders, bool_or(o_orderkey IS NOT NULL) AS active FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY 1")
def join_left_flag(spark, sf):
    o = read(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))
    return read(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.col("orders").isNotNull().alias("active"))


@case("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_semi(spark, sf):
    o = read(spark, sf, "orders").filter("o_totalprice > 400000")
    return read(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@case("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def join_anti(spark, sf):
    o = read(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    return read(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@case("SELECT s_suppkey, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal < 0) AS debtors, (s_acctbal > 0) = EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal < 0) AS agrees FROM supplier")
def join_exists_flag(spark, sf):
    c = read(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("s_nationkey")).distinct().withColumn("d", F.lit(True))
    flag = F.coalesce("d", F.lit(False))
    return read(spark, sf, "supplier").join(c, "s_nationkey", "left").select("s_suppkey", flag.alias("debtors"), ((F.col("s_acctbal") > 0) == flag).alias("agrees"))


TREE_SQL = "SELECT 'R' || r_regionkey AS code, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, c_name FROM customer"


def tree(spark, sf):
    code = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    r = read(spark, sf, "region").select(code("R", "r_regionkey").alias("code"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = read(spark, sf, "nation").select(code("N", "n_nationkey").alias("code"), code("R", "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    c = read(spark, sf, "customer").select(code("C", "c_custkey").alias("code"), code("N", "c_nationkey").alias("parent"), F.col("c_name").alias("name"))
    return r.unionByName(n).unionByName(c)


@case(f"WITH t AS ({TREE_SQL}) SELECT p.code AS parent, count(*) AS children FROM t p JOIN t c ON c.parent = p.code GROUP BY 1")
def join_self_parent(spark, sf):
    t = tree(spark, sf)
    return t.alias("p").join(t.alias("c"), F.col("c.parent") == F.col("p.code")).groupBy(F.col("p.code").alias("parent")).agg(F.count(F.lit(1)).alias("children"))


@case(f"WITH RECURSIVE t AS ({TREE_SQL}), p AS (SELECT code, name AS path, 1 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.code, p.path || ' > ' || t.name, p.depth + 1 FROM t JOIN p ON t.parent = p.code) SELECT * FROM p")
def tree_path_recursive(spark, sf):
    return relational.tree_paths(tree(spark, sf), "code", "parent", "name", " > ")


@case(f"WITH s AS ({SERIES_SQL}), o AS ({ORDERS_SQL}) SELECT o.o_orderkey, o.day, o.flag, s.day AS matched_at, s.rate FROM o LEFT JOIN s ON s.flag = o.flag AND s.day = (SELECT min(x.day) FROM s x WHERE x.flag = o.flag AND x.day >= o.day AND x.day <= o.day + 10)", dates=("day", "matched_at"))
def join_asof_forward(spark, sf):
    """The rate that applies to each order: the first at or after its day, at most 10 days later."""
    return asof.asof_forward(dated_orders(spark, sf), series(spark, sf), "day", ["flag"], ["rate"], tolerance_days=10)


@case(f"WITH s AS ({SERIES_SQL}), o AS ({ORDERS_SQL}) SELECT o.o_orderkey, o.day, o.flag, s.day AS matched_at, s.rate FROM o LEFT JOIN s ON s.flag = o.flag AND s.day = (SELECT max(x.day) FROM s x WHERE x.flag = o.flag AND x.day < o.day)", dates=("day", "matched_at"))
def join_asof_backward(spark, sf):
    return asof.asof_backward(dated_orders(spark, sf), series(spark, sf), "day", ["flag"], ["rate"], strict=True)


@case(f"WITH s AS ({SERIES_SQL}), o AS ({ORDERS_SQL}), m AS (SELECT flag, max(day) AS last FROM s GROUP BY 1) SELECT o.o_orderkey, coalesce((SELECT min(x.day) FROM s x WHERE x.flag = o.flag AND x.day >= o.day), m.last) AS applied FROM o JOIN m USING (flag)", dates=("applied",))
def asof_or_latest(spark, sf):
    s = series(spark, sf)
    last = s.groupBy("flag").agg(F.max("day").alias("last"))
    found = asof.asof_forward(dated_orders(spark, sf), s, "day", ["flag"], [])
    return found.join(F.broadcast(last), "flag").select("o_orderkey", F.coalesce("matched_at", "last").alias("applied"))


@case(f"WITH s AS ({SERIES_SQL}), p AS (SELECT *, lag(rate) OVER (PARTITION BY flag ORDER BY day) AS before FROM s) SELECT flag, day, (rate / before - 1) * 100 AS change FROM p WHERE before IS NOT NULL", dates=("day",))
def prev_change_pct(spark, sf):
    before = F.lag("rate").over(Window.partitionBy("flag").orderBy("day"))
    return series(spark, sf).withColumn("before", before).filter("before IS NOT NULL").select("flag", "day", ((F.col("rate") / F.col("before") - 1) * 100).alias("change"))


@case(f"WITH s AS ({SERIES_SQL}), p AS (SELECT *, lag(rate) OVER (PARTITION BY flag ORDER BY day) AS before FROM s) SELECT flag, day FROM p WHERE abs(rate / before - 1) > 0.2", dates=("day",))
def jump_detector(spark, sf):
    before = F.lag("rate").over(Window.partitionBy("flag").orderBy("day"))
    return series(spark, sf).withColumn("before", before).filter(F.abs(F.col("rate") / F.col("before") - 1) > 0.2).select("flag", "day")


@case(f"WITH s AS ({SERIES_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY day DESC) AS n FROM s) SELECT flag, min(rate) AS low, max(rate) AS high, arg_min(rate, day) AS first_rate, arg_max(rate, day) AS last_rate FROM r WHERE n <= 30 GROUP BY 1")
def last_n_per_series(spark, sf):
    top = relational.top_per_key(series(spark, sf), ["flag"], [F.desc("day")], 30)
    return top.groupBy("flag").agg(F.min("rate").alias("low"), F.max("rate").alias("high"), F.min_by("rate", "day").alias("first_rate"), F.max_by("rate", "day").alias("last_rate"))


@case("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) o ON c_custkey = o_custkey AND n = 1")
def join_lateral_top1(spark, sf):
    last = relational.latest_per_key(read(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return read(spark, sf, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@case("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def latest_per_key(spark, sf):
    return relational.latest_per_key(read(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@case("SELECT o_custkey, o_orderkey, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def top_n_per_group(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(spark, sf, "orders").withColumn("place", F.row_number().over(w)).filter("place <= 3").select("o_custkey", "o_orderkey", "place")


@case("SELECT l_orderkey, arg_max(l_linenumber, l_extendedprice * 100000 - l_linenumber) AS dearest, arg_min(l_linenumber, l_extendedprice * 100000 + l_linenumber) AS cheapest FROM (SELECT l_orderkey, l_linenumber, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def argmin_argmax(spark, sf):
    l = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_extendedprice").alias("p"))
    return l.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("p", -F.col("l_linenumber"))).alias("dearest"), F.min_by("l_linenumber", F.struct("p", "l_linenumber")).alias("cheapest"))


PERIODS_SQL = "SELECT flag, make_date(CAST(y AS INT), 1, 1) AS since, CASE WHEN y < (SELECT max(year(day)) FROM s) THEN make_date(CAST(y AS INT), 12, 31) END AS until, percent FROM (SELECT flag, year(day) AS y, CAST(count(*) % 17 AS INT) AS percent FROM s GROUP BY 1, 2)"


@case(f"WITH s AS ({SERIES_SQL}), o AS ({ORDERS_SQL}), p AS ({PERIODS_SQL}) SELECT o_orderkey, percent FROM o JOIN p ON p.flag = o.flag AND since <= day AND (until IS NULL OR until >= day)")
def join_valid_time(spark, sf):
    s = series(spark, sf)
    years = s.groupBy("flag", F.year("day").alias("y")).agg((F.count(F.lit(1)) % 17).cast("int").alias("percent"))
    last = s.agg(F.max(F.year("day")).alias("last"))
    periods = years.crossJoin(F.broadcast(last)).select("flag", F.make_date("y", F.lit(1), F.lit(1)).alias("since"), F.when(F.col("y") < F.col("last"), F.make_date("y", F.lit(12), F.lit(31))).alias("until"), "percent")
    return asof.join_in_force(dated_orders(spark, sf), "day", periods, ["flag"]).select("o_orderkey", "percent")


CODES_SQL = "SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS code FROM part"
RULES_SQL = "SELECT DISTINCT substr(code, 1, n) AS prefix, n * 7 AS rule FROM (SELECT code, unnest([2, 4, 5]) AS n FROM c WHERE p_partkey % 3 = 0 AND p_partkey % 100 < 50)"


def codes(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("code"))


def prefix_rules(spark, sf):
    cut = F.explode(F.array(F.lit(2), F.lit(4), F.lit(5)))
    some = codes(spark, sf).filter("p_partkey % 3 = 0 AND p_partkey % 100 < 50").select("code", cut.alias("n"))
    return some.select(F.expr("substr(code, 1, n)").alias("prefix"), (F.col("n") * 7).alias("rule")).distinct()


@case(f"WITH c AS ({CODES_SQL}), r AS ({RULES_SQL}) SELECT p_partkey, arg_max(r.prefix, length(r.prefix)) AS prefix, arg_max(rule, length(r.prefix)) AS rule FROM c LEFT JOIN r ON starts_with(c.code, r.prefix) GROUP BY 1")
def join_longest_prefix(spark, sf):
    return relational.longest_prefix(codes(spark, sf), "code", prefix_rules(spark, sf), "prefix", range(2, 7)).select("p_partkey", "prefix", "rule")


@case(f"WITH c AS ({CODES_SQL}), r AS ({RULES_SQL}) SELECT r.prefix, count(*) AS codes FROM r JOIN c ON starts_with(c.code, r.prefix) GROUP BY 1")
def join_prefix_expand(spark, sf):
    opened = codes(spark, sf).select(F.explode(relational.prefixes(F.col("code"), range(2, 7))).alias("prefix"))
    return opened.join(prefix_rules(spark, sf), "prefix").groupBy("prefix").agg(F.count(F.lit(1)).alias("codes"))


@case(f"WITH c AS ({CODES_SQL}), r AS ({RULES_SQL}) SELECT p_partkey FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE length(prefix) > 4 AND c.code LIKE r.prefix || '%')")
def anti_prefix(spark, sf):
    c = codes(spark, sf)
    rules = prefix_rules(spark, sf).filter("length(prefix) > 4")
    covered = c.select("p_partkey", F.explode(relational.prefixes(F.col("code"), range(2, 7))).alias("prefix")).join(rules, "prefix", "left_semi")
    return c.join(covered, "p_partkey", "left_anti").select("p_partkey")


@case("SELECT p_partkey, band FROM part JOIN (VALUES (1, 10, 'small'), (11, 30, 'middle'), (31, 50, 'large')) b(low, high, band) ON p_size BETWEEN low AND high")
def join_range_containment(spark, sf):
    bands = spark.createDataFrame([(1, 10, "small"), (11, 30, "middle"), (31, 50, "large")], "low int, high int, band string")
    return read(spark, sf, "part").join(F.broadcast(bands), F.col("p_size").between(F.col("low"), F.col("high"))).select("p_partkey", "band")


@case("SELECT count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT user_id) AS users, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT max(c_acctbal) FROM customer) AS best FROM events")
def kpi_record(spark, sf):
    e = read(spark, sf, "events").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("user_id").alias("users"))
    o = read(spark, sf, "orders").filter("o_orderstatus = 'O'").agg(F.count(F.lit(1)).alias("open_orders"))
    return e.crossJoin(F.broadcast(o)).crossJoin(F.broadcast(read(spark, sf, "customer").agg(F.max("c_acctbal").alias("best"))))


@case("SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS lines, coalesce((SELECT CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) FROM lineitem WHERE l_suppkey = s_suppkey), 0) AS quantity FROM supplier")
def correlated_counts(spark, sf):
    l = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("lines"), F.sum(cents("l_quantity")).cast("double").alias("quantity"))
    return read(spark, sf, "supplier").join(l, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"))


@case("SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_tax) AS taxed, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_price, min(l_shipdate) AS first_day, max(l_discount) AS most FROM lineitem GROUP BY 1, 2")
def agg_basic(spark, sf):
    price = F.sum(cents("l_extendedprice")).cast("double") / F.count(F.lit(1))
    return read(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count("l_tax").alias("taxed"), F.sum(cents("l_quantity")).cast("double").alias("quantity"), price.alias("mean_price"), F.min("l_shipdate").alias("first_day"), F.max("l_discount").alias("most"))


@case("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts - INTERVAL 4 HOUR AS DATE)) AS days FROM events GROUP BY 1")
def agg_distinct(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(civil_day(F.col("ts"))).alias("days"))


@case("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 20 AND event_type <> 'error') AS large, max(value) FILTER (WHERE event_type = 'purchase') AS best FROM events GROUP BY 1")
def agg_filter(spark, sf):
    kind = F.col("event_type")
    return read(spark, sf, "events").groupBy("user_id").agg(F.count_if(kind == "error").alias("errors"), F.count_if((F.col("value") > 20) & (kind != "error")).alias("large"), F.max(F.when(kind == "purchase", F.col("value"))).alias("best"))


@case("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3 AND max(l_extendedprice) > 20 * min(l_extendedprice)")
def agg_having(spark, sf):
    g = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_returnflag").alias("f"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"))
    return g.filter("f = 3 AND high > 20 * low").select("l_suppkey", "n")


@case("SELECT l_partkey, min(m) AS low, max(m) AS high, count(*) AS suppliers FROM (SELECT l_partkey, l_suppkey, min(l_extendedprice) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 2")
def agg_two_level(spark, sf):
    per = read(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_extendedprice").alias("m"))
    return per.groupBy("l_partkey").agg(F.min("m").alias("low"), F.max("m").alias("high"), F.count(F.lit(1)).alias("suppliers")).filter("suppliers >= 2")


@case("SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS nations, bool_or(n_nationkey = 0) AS has_first, bool_and(n_nationkey > 3) AS all_late FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def agg_listagg(spark, sf):
    j = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("nations"), F.bool_or(F.col("n_nationkey") == 0).alias("has_first"), F.bool_and(F.col("n_nationkey") > 3).alias("all_late"))


@case("SELECT r_regionkey, '[' || string_agg('{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS nested FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def agg_nested_array(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))))
    return read(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.to_json(rows).alias("nested"))


@case("SELECT date_trunc('month', o_orderdate)::DATE AS month, lower(o_orderpriority) AS priority, split_part(o_orderpriority, '-', 1) AS rank, count(*) AS n FROM orders GROUP BY 1, 2, 3", dates=("month",))
def agg_expr_key(spark, sf):
    return read(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month"), F.lower("o_orderpriority").alias("priority"), F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@case("SELECT CAST(ts - INTERVAL 4 HOUR AS DATE) AS day, max(value) FILTER (WHERE event_type = 'click') AS click, max(value) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1", dates=("day",))
def pivot_conditional(spark, sf):
    return read(spark, sf, "events").groupBy(civil_day(F.col("ts")).alias("day")).pivot("event_type", ["click", "view"]).agg(F.max("value"))


@case("SELECT d::DATE AS day, coalesce(n, 0) AS n FROM generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY) g(d) LEFT JOIN (SELECT CAST(ts - INTERVAL 4 HOUR AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1) f ON f.day = d::DATE", dates=("day",))
def zero_filled_series(spark, sf):
    from quipu.functions.dates import calendar

    facts = read(spark, sf, "events").filter("event_type = 'signup'").groupBy(civil_day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return relational.zero_filled(calendar(spark, "2023-12-25", "2024-02-05"), facts, ["day"], ["n"])


@case("SELECT event_type, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS share FROM events GROUP BY 1")
def share_of_total(spark, sf):
    g = read(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select("event_type", "n", (F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy())).alias("share"))


@case("SELECT c_nationkey, c_mktsegment, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total, min(c_name) AS first_name, count(DISTINCT c_acctbal > 0) > 1 AS conflict FROM customer GROUP BY 1, 2")
def consolidate_duplicates(spark, sf):
    return read(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum(cents("c_acctbal")).cast("double").alias("total"), F.min("c_name").alias("first_name"), (F.count_distinct(F.col("c_acctbal") > 0) > 1).alias("conflict"))


GAPPY_SQL = "SELECT c_custkey % 40 AS k, c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name, CASE WHEN c_custkey % 5 > 1 THEN c_mktsegment END AS segment FROM customer"


@case(f"SELECT DISTINCT ON (k) k, c_custkey FROM ({GAPPY_SQL}) ORDER BY k, (name IS NOT NULL)::INT + (segment IS NOT NULL)::INT DESC, c_custkey")
def keep_most_complete(spark, sf):
    c = F.col("c_custkey")
    gappy = read(spark, sf, "customer").select((c % 40).alias("k"), "c_custkey", F.when(c % 3 > 0, F.col("c_name")).alias("name"), F.when(c % 5 > 1, F.col("c_mktsegment")).alias("segment"))
    return relational.most_complete(gappy, ["k"], ["name", "segment"], [c]).select("k", "c_custkey")


@case("SELECT l_suppkey, median(l_extendedprice) AS median_price FROM lineitem GROUP BY 1")
def median_by_group(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.median("l_extendedprice").alias("median_price"))


@case("SELECT o_custkey, total, rank() OVER (ORDER BY total DESC) AS rank FROM (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1)")
def rank_total(spark, sf):
    totals = read(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(cents("o_totalprice")).cast("double").alias("total"))
    return relational.rank_total(totals, "total")


@case("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ordinal FROM orders")
def dense_ordinal(spark, sf):
    return read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("ordinal"))


@case("WITH w AS (SELECT event_id, user_id, event_type AS t, lag(event_type) OVER x AS a, lag(event_type, 2) OVER x AS b, lead(event_type) OVER x AS c, lead(event_type, 2) OVER x AS d FROM events WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id FROM w WHERE a = b AND c = d AND a = c AND t <> a")
def neighbour_outlier(spark, sf):
    w, t = Window.partitionBy("user_id").orderBy("ts", "event_id"), F.col("event_type")
    near = read(spark, sf, "events").select("event_id", t.alias("t"), F.lag(t).over(w).alias("a"), F.lag(t, 2).over(w).alias("b"), F.lead(t).over(w).alias("c"), F.lead(t, 2).over(w).alias("d"))
    return near.filter("a = b AND c = d AND a = c AND t <> a").select("event_id")


@case("SELECT l_orderkey, s AS missing FROM (SELECT l_orderkey, unnest(range(1, max(l_linenumber) + 1)) AS s FROM lineitem GROUP BY 1) q WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = q.l_orderkey AND l.l_linenumber = s)")
def sequence_gaps(spark, sf):
    g = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("have"), F.max("l_linenumber").alias("most"))
    return g.select("l_orderkey", F.explode(F.array_except(F.sequence(F.lit(1), F.col("most")), "have")).alias("missing"))


@case("SELECT doc_id, n AS turn FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 2")
def diversity_pick(spark, sf):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return read(spark, sf, "documents").select("doc_id", F.row_number().over(w).alias("turn")).filter("turn <= 2")


@case("SELECT event_id, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > ts - INTERVAL 1 MINUTE IS TRUE AS duplicate FROM events")
def dup_within_minute(spark, sf):
    before = F.lag("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return read(spark, sf, "events").select("event_id", F.coalesce(before > F.col("ts") - F.expr("INTERVAL 1 MINUTE"), F.lit(False)).alias("duplicate"))


@case("SELECT p_partkey, p_type FROM part ORDER BY list_position(['SMALL', 'ECONOMY'], p_type) NULLS LAST, p_size DESC, p_partkey LIMIT 25")
def sort_nulls_custom(spark, sf):
    place = F.nullif(F.array_position(F.array(F.lit("SMALL"), F.lit("ECONOMY")), F.col("p_type")), F.lit(0))
    return read(spark, sf, "part").orderBy(place.asc_nulls_last(), F.desc("p_size"), "p_partkey").limit(25).select("p_partkey", "p_type")


@case("SELECT p_partkey FROM part ORDER BY md5(p_partkey || '2026-01-01') LIMIT 1")
def sort_hash_pick(spark, sf):
    return read(spark, sf, "part").orderBy(F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit("2026-01-01")))).limit(1).select("p_partkey")


@case("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def paginate_with_total(spark, sf):
    return relational.page(read(spark, sf, "orders").filter("o_orderstatus = 'F'"), [F.desc("o_orderdate"), F.col("o_orderkey")], 20, 3).select("o_orderkey", "total")


@case("SELECT 'customer' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part")
def set_union_all(spark, sf):
    one = lambda t: read(spark, sf, t).agg(F.lit(t).alias("kind"), F.count(F.lit(1)).alias("n"))
    return one("customer").unionByName(one("supplier")).unionByName(one("part"))


@case("WITH c AS (SELECT c_nationkey * 100 + CAST(floor(c_acctbal / 1000) AS INTEGER) AS k FROM customer), s AS (SELECT s_nationkey * 100 + CAST(floor(s_acctbal / 1000) AS INTEGER) AS k FROM supplier) SELECT *, 'a' AS side FROM (SELECT k FROM c EXCEPT SELECT k FROM s) UNION ALL SELECT *, 'b' FROM (SELECT k FROM s EXCEPT SELECT k FROM c)")
def set_except_both_ways(spark, sf):
    """Nations and thousands of balance that occur among customers or among suppliers alone."""
    key = lambda t, x: read(spark, sf, t).select((F.col(f"{x}_nationkey") * 100 + F.floor(F.col(f"{x}_acctbal") / 1000)).cast("int").alias("k"))
    return relational.differences(key("customer", "c"), key("supplier", "s"))


@case("SELECT *, 'a' AS side FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT *, 'b' FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def set_except_by_status(spark, sf):
    """Customers with finished orders against customers with open ones, over all orders."""
    having = lambda status: read(spark, sf, "orders").filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k"))
    return relational.differences(having("F"), having("O"))


@case("SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS both_flags FROM (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1")
def set_intersect_arrays(spark, sf):
    kinds = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("l_partkey"))).alias("a"), F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_partkey"))).alias("f"))
    return kinds.select("l_orderkey", F.array_join(F.array_sort(F.array_intersect("a", "f")), ",").alias("both_flags")).filter("both_flags <> ''")


@case("SELECT n_regionkey, CAST(map_keys(m) AS VARCHAR) AS names, CAST(list_sum(map_values(m)) AS BIGINT) AS keys FROM (SELECT n_regionkey, map_from_entries(list(struct_pack(k := n_name, v := n_nationkey) ORDER BY n_name)) AS m FROM nation GROUP BY 1)")
def agg_object(spark, sf):
    """An object of names and keys for each region, shown by its names in order and the sum of its values."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("k"), F.col("n_nationkey").cast("long").alias("v"))))
    m = read(spark, sf, "nation").groupBy("n_regionkey").agg(F.map_from_entries(entries).alias("m"))
    names = F.concat(F.lit("["), F.array_join(F.map_keys("m"), ", "), F.lit("]"))
    return m.select("n_regionkey", names.alias("names"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("keys"))


@case("SELECT min(event_id) AS event_id, user_id, event_type, ts, value FROM events GROUP BY user_id, event_type, ts, value")
def distinct_but_one_column(spark, sf):
    """Exact duplicates but for the event's id: the smallest id stays."""
    return read(spark, sf, "events").groupBy("user_id", "event_type", "ts", "value").agg(F.min("event_id").alias("event_id")).select("event_id", "user_id", "event_type", "ts", "value")


@case("SELECT id, row_number() OVER (ORDER BY CAST(substr(id, 2) AS BIGINT), id) AS place FROM (SELECT 'S' || s_suppkey AS id FROM supplier)")
def sort_numeric_ids(spark, sf):
    """Ids of a letter and a number in numeric order: S2 comes before S10."""
    ids = read(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"))
    number = F.substring("id", 2, 30).cast("long")
    ranked = relational.rank_total(ids.withColumn("_key", -number), "_key")
    return ranked.select("id", F.col("rank").cast("long").alias("place"))


@case("SELECT c_nationkey, substr(a, 1, list_max(list_filter(range(0, CAST(least(length(a), length(z)) AS BIGINT) + 1), lambda n: substr(a, 1, n) = substr(z, 1, n)))) AS prefix FROM (SELECT c_nationkey, min(c_phone) AS a, max(c_phone) AS z FROM (SELECT c_nationkey, c_name AS c_phone FROM customer) GROUP BY 1)")
def common_prefixes(spark, sf):
    """What the names of a nation's customers begin with."""
    return relational.common_prefix(read(spark, sf, "customer"), ["c_nationkey"], "c_name")


@case("SELECT p_partkey, regexp_replace(p_name, '^' || prefix, '') AS rest FROM (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS prefix FROM part)")
def without_common_prefix(spark, sf):
    """Names without the word that all names of their first word begin with."""
    return read(spark, sf, "part").select("p_partkey", F.expr("substr(p_name, length(split_part(p_name, ' ', 1)) + 1)").alias("rest"))
