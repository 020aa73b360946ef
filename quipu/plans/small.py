"""Small queries of the service: lists without nulls, orders by lower case, extracts, expanded groups, conditional updates, scopes and states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quipu.plans.registry import Registry, read

R = Registry()
case = R.case


@case("SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT 'p_' || o_orderpriority) FILTER (WHERE o_orderpriority IS NOT NULL)), ',') AS priorities FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")
def agg_array_without_null(spark, sf):
    """What a left join finds, as a sorted list without the nulls of those that find nothing; null where there is nothing at all."""
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders").filter("o_orderstatus = 'P'")
    found = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_nationkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("p_"), "o_orderpriority"))).alias("p"))
    return found.select("c_nationkey", F.when(F.size("p") > 0, F.array_join("p", ",")).alias("priorities"))


@case("SELECT p_type, name, row_number() OVER (PARTITION BY p_type ORDER BY lower(name), name) AS place FROM (SELECT DISTINCT p_type, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part)")
def sort_lower(spark, sf):
    """Names in the order of their lower case; of names that differ by case alone the capital one is first."""
    p = read(spark, sf, "part").select("p_type", F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name")).distinct()
    return p.withColumn("place", F.row_number().over(Window.partitionBy("p_type").orderBy(F.lower("name"), "name")))


@case(r"SELECT p_partkey, nullif(regexp_extract(p_name, '\b(ring|gear|bolt|widget)s?\b', 1), '') AS category FROM part")
def regex_category(spark, sf):
    """The category that a name says as a word; null without one."""
    return read(spark, sf, "part").select("p_partkey", F.nullif(F.regexp_extract("p_name", r"\b(ring|gear|bolt|widget)s?\b", 1), F.lit("")).alias("category"))


@case("SELECT p_partkey, CAST(t AS INTEGER) AS terminal FROM (SELECT p_partkey, unnest(string_split(CAST(p_size % 10 AS VARCHAR) || ',' || CAST((p_size + 5) % 10 AS VARCHAR), ',')) AS t FROM part)")
def terminal_groups(spark, sf):
    """Groups of terminals as `0,8`, a row for each terminal."""
    group = F.concat_ws(",", (F.col("p_size") % 10).cast("string"), ((F.col("p_size") + 5) % 10).cast("string"))
    return read(spark, sf, "part").select("p_partkey", F.explode(F.split(group, ",")).alias("t")).select("p_partkey", F.col("t").cast("int").alias("terminal"))


@case("SELECT event_id, epoch_us(ts) // 1000000 AS seconds, strftime(make_timestamp((epoch_us(ts) // 1000000) * 1000000), '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def epoch_and_text(spark, sf):
    """Times as seconds since 1970, and those seconds as ISO text."""
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    return read(spark, sf, "events").select("event_id", seconds.alias("seconds")).select("event_id", "seconds", F.date_format(F.timestamp_seconds("seconds"), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@case("SELECT user_id, event_id, CASE WHEN event_type = 'error' AND fails + 1 >= 3 THEN 0 WHEN event_type = 'error' THEN fails + 1 ELSE 0 END AS failures, event_type = 'error' AND fails + 1 >= 3 AS blocked FROM (SELECT *, event_id % 4 AS fails FROM events) WHERE event_type IN ('error', 'signup')")
def conditional_update(spark, sf):
    """What an update with cases leaves and returns: a failure counts up, the third blocks and starts anew, a success clears."""
    e = read(spark, sf, "events").filter("event_type IN ('error', 'signup')").withColumn("fails", F.col("event_id") % 4)
    failed, third = F.col("event_type") == "error", F.col("fails") + 1 >= 3
    return e.select("user_id", "event_id", F.when(failed & third, 0).when(failed, F.col("fails") + 1).otherwise(0).alias("failures"), (failed & third).alias("blocked"))


@case("SELECT s_suppkey, CASE WHEN t.k IS NOT NULL THEN NOT (s_acctbal > 0) ELSE s_acctbal > 0 END AS active, t.k IS NOT NULL AS toggled FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R') t ON t.k = s_suppkey")
def toggle_flag(spark, sf):
    """The flag of the suppliers that an edit names is turned round."""
    named = read(spark, sf, "lineitem").filter("l_quantity = 50 AND l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey")).distinct().withColumn("hit", F.lit(True))
    s = read(spark, sf, "supplier").join(named, "s_suppkey", "left")
    toggled, active = F.col("hit").isNotNull(), F.col("s_acctbal") > 0
    return s.select("s_suppkey", F.when(toggled, ~active).otherwise(active).alias("active"), toggled.alias("toggled"))


@case("SELECT 'wide' AS role, o_orderkey FROM orders UNION ALL SELECT 'own', o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'MACHINERY')")
def scoped_rows(spark, sf):
    """What each of two roles sees: all orders, or those of its own accounts."""
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    accounts = read(spark, sf, "customer").filter("c_nationkey = 3 AND c_mktsegment = 'MACHINERY'").select("c_custkey")
    seen = lambda role: o if role == "wide" else o.join(accounts, "c_custkey", "left_semi")
    wide, own = (seen(role).select(F.lit(role).alias("role"), "o_orderkey") for role in ("wide", "own"))
    return wide.unionByName(own)


@case("SELECT c_custkey, array_to_string(list_filter([CASE WHEN coalesce(c_acctbal > 0, false) THEN 'active' END, CASE WHEN coalesce(last > TIMESTAMP '2001-06-01', false) THEN 'blocked' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'temporary' END, CASE WHEN coalesce(n, 0) = 0 THEN 'unused' END], lambda x: x IS NOT NULL), ',') AS states FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def derived_states(spark, sf):
    """The states that an account is in, each a condition of its own; what is unknown is not so."""
    used = read(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.count(F.lit(1)).alias("n"))
    so = lambda c: F.coalesce(c, F.lit(False))
    states = {"active": so(F.col("c_acctbal") > 0), "blocked": so(F.col("last") > F.lit("2001-06-01").cast("timestamp_ntz")), "temporary": F.col("c_mktsegment") == "BUILDING", "unused": F.coalesce("n", F.lit(0)) == 0}
    joined = read(spark, sf, "customer").join(used, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", F.array_join(F.array_compact(F.array(*[F.when(c, name) for name, c in states.items()])), ",").alias("states"))
