"""Reference images, ranked index search, records of several sources, totals with their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quipu.operators import consolidate, lookup
from quipu.plans.registry import Registry, read
from quipu.plans.texts import norm_sql, set_sql, trigrams_sql

R = Registry()
case = R.case

_PRODUCTS_SQL = """SELECT l_partkey * 100000 + l_suppkey AS id, any_value(p_name || ' ' || p_brand || ' ' || p_type) AS text, CASE WHEN l_partkey % 3 > 0 THEN 'e' || (l_partkey // 2) END AS ean,
  CASE WHEN (l_partkey + l_suppkey) % 4 > 0 THEN 'i' || l_partkey END AS image, max(l_shipdate) AS seen, any_value(s_acctbal) > 0 AS active, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber)) <> 'R' AS available
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey, l_suppkey"""
_QUERIES_SQL = "SELECT p_partkey AS query_id, p_name || ' ' || p_type AS text, CASE WHEN p_size <= 25 THEN ['e' || (p_partkey + 1000000), 'e' || (p_partkey // 2)] ELSE [] END AS codes FROM part"


def products(spark, sf):
    """One product for each part and seller: name, code, image, when it was last read, whether its seller is active and has it in stock."""
    l, p, s = (read(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    listed = l.groupBy("l_partkey", "l_suppkey").agg(F.max("l_shipdate").alias("seen"), (F.max_by("l_returnflag", F.struct("l_shipdate", "l_orderkey", "l_linenumber")) != "R").alias("available"))
    k = F.col("l_partkey")
    named = listed.join(p, k == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return named.select(
        (k * 100_000 + F.col("l_suppkey")).alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"), F.when(k % 3 > 0, F.concat(F.lit("e"), F.expr("l_partkey DIV 2").cast("string"))).alias("ean"),
        F.when((k + F.col("l_suppkey")) % 4 > 0, F.concat(F.lit("i"), k.cast("string"))).alias("image"), "seen", (F.col("s_acctbal") > 0).alias("active"), "available",
    )


_WORDS_SQL = f"list_slice(list_filter({set_sql('text')}, lambda w: length(w) >= 2), 1, {lookup.WORDS})"
_SIM_SQL = "CAST(len(list_intersect(qt, pt)) AS DOUBLE) / (len(qt) + len(pt) - len(list_intersect(qt, pt)))"


@case(f"""WITH p AS (SELECT *, {norm_sql('text')} AS norm, {trigrams_sql('text')} AS pt FROM ({_PRODUCTS_SQL}) WHERE active AND image IS NOT NULL),
q AS ({_QUERIES_SQL}), c AS (SELECT query_id, unnest(codes) AS ean, generate_subscripts(codes, 1) AS place FROM q),
bc AS (SELECT DISTINCT ON (query_id) query_id, id FROM c JOIN p USING (ean) ORDER BY query_id, place, seen DESC, id),
t AS (SELECT DISTINCT text, {_WORDS_SQL} AS ws, {trigrams_sql('text')} AS qt FROM q WHERE query_id NOT IN (SELECT query_id FROM bc)),
bn AS (SELECT DISTINCT ON (t.text) t.text, id FROM t JOIN p ON len(list_filter(ws, lambda w: NOT contains(norm, w))) = 0 WHERE {_SIM_SQL} >= {lookup.THRESHOLD} ORDER BY t.text, {_SIM_SQL} DESC, seen DESC, id)
SELECT query_id, id, 'code' AS by FROM bc UNION ALL SELECT query_id, id, 'name' FROM q JOIN bn USING (text) WHERE query_id NOT IN (SELECT query_id FROM bc)""")
def reference_image(spark, sf):
    """For every part, the product whose image stands for it: by its codes, else by name and similarity."""
    p = read(spark, sf, "part")
    code = lambda n: F.concat(F.lit("e"), n.cast("string"))
    codes = F.when(F.col("p_size") <= 25, F.array(code(F.col("p_partkey") + 1_000_000), code(F.expr("p_partkey DIV 2")))).otherwise(F.array().cast("array<string>"))
    queries = p.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"), codes.alias("codes"))
    return lookup.reference_images(queries, products(spark, sf))


@case(f"""WITH p AS (SELECT *, {norm_sql('text')} AS norm, {trigrams_sql('text')} AS pt FROM ({_PRODUCTS_SQL}) WHERE seen > (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 90 DAY),
t AS (SELECT *, {_WORDS_SQL} AS ws, {trigrams_sql('text')} AS qt FROM (SELECT DISTINCT p_type || ' ' || split_part(p_name, ' ', 2) AS text FROM part))
SELECT * FROM (SELECT t.text, id, CAST(row_number() OVER (PARTITION BY t.text ORDER BY available DESC, {_SIM_SQL} DESC, id) AS INTEGER) AS place FROM t JOIN p ON len(list_filter(ws, lambda w: NOT contains(norm, w))) = 0) WHERE place <= 24""")
def index_search_ranked(spark, sf):
    """For every type and kind of part, the first 24 products read in the last 90 days whose names have all words."""
    p = products(spark, sf)
    newest = read(spark, sf, "lineitem").agg(F.max("l_shipdate").alias("newest"))
    recent = p.crossJoin(newest).filter("seen > newest - INTERVAL 90 DAYS")
    texts = read(spark, sf, "part").select(F.concat_ws(" ", "p_type", F.split_part("p_name", F.lit(" "), F.lit(2))).alias("text"))
    return lookup.index_search(texts, recent)


_SOURCES_SQL = """SELECT c_custkey AS k, 1 AS src, 'registry' AS source, c_name AS name, CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment, NULL AS period FROM customer
UNION ALL SELECT s_suppkey, 2, 'importers', CASE WHEN s_acctbal > 0 THEN s_name END, 'TRADE', NULL FROM supplier
UNION ALL SELECT o_custkey, 3, 'orders', NULL, CASE WHEN o_orderstatus = 'F' THEN 'TRADE' ELSE '' END, strftime(o_orderdate, '%Y-%m') FROM orders"""


@case(f"""WITH r AS ({_SOURCES_SQL}), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src, coalesce(period, ''), coalesce(name, ''), segment) AS n FROM r),
nm AS (SELECT k, name, first_value(name) OVER (PARTITION BY k ORDER BY n) AS f FROM o WHERE name <> ''), sg AS (SELECT k, segment, first_value(segment) OVER (PARTITION BY k ORDER BY n) AS f FROM o WHERE segment <> ''),
pd AS (SELECT k, period, max(period) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM o WHERE period <> '')
SELECT k, a.name, b.segment, c.period, coalesce(a.x, 0) AS name_conflicts, coalesce(b.x, 0) AS segment_conflicts, coalesce(c.x, 0) AS period_conflicts, sources
FROM (SELECT k, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM r GROUP BY k) LEFT JOIN (SELECT k, any_value(f) AS name, count(*) FILTER (WHERE name <> f) AS x FROM nm GROUP BY k) a USING (k)
LEFT JOIN (SELECT k, any_value(f) AS segment, count(*) FILTER (WHERE segment <> f) AS x FROM sg GROUP BY k) b USING (k) LEFT JOIN (SELECT k, max(period) AS period, count(*) FILTER (WHERE period <> f) AS x FROM pd GROUP BY k) c USING (k)""")
def consolidated_records(spark, sf):
    """One record a taxpayer of three sources: first name and segment that say something, latest period, disagreements."""
    c, s, o = (read(spark, sf, t) for t in ("customer", "supplier", "orders"))
    none = F.lit(None).cast("string")
    rows = c.select(F.col("c_custkey").alias("k"), F.lit(1).alias("src"), F.lit("registry").alias("source"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"), none.alias("period"))
    rows = rows.unionByName(s.select(F.col("s_suppkey").alias("k"), F.lit(2).alias("src"), F.lit("importers").alias("source"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("name"), F.lit("TRADE").alias("segment"), none.alias("period")))
    rows = rows.unionByName(o.select(F.col("o_custkey").alias("k"), F.lit(3).alias("src"), F.lit("orders").alias("source"), none.alias("name"), F.when(F.col("o_orderstatus") == "F", "TRADE").otherwise("").alias("segment"), F.date_format("o_orderdate", "yyyy-MM").alias("period")))
    rows = rows.withColumns({"o1": F.coalesce("period", F.lit("")), "o2": F.coalesce("name", F.lit("")), "o3": F.col("segment")})
    return consolidate.consolidated(rows, "k", ["src", "o1", "o2", "o3"], first=["name", "segment"], latest=["period"]).withColumn("sources", F.array_join("sources", ","))


_PAID_SQL = "SELECT o_custkey AS payer, o_orderpriority AS region, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders"


@case(f"""WITH parts AS (SELECT payer, region, sum(cents) AS cents, count(*) - 1 AS repeated FROM ({_PAID_SQL}) GROUP BY ALL), totals AS (SELECT payer, sum(cents) AS total, count(*) AS regions FROM parts GROUP BY payer)
SELECT payer, region, CAST(cents AS BIGINT) AS cents, repeated, CAST(total AS BIGINT) AS total, regions FROM parts JOIN totals USING (payer)""")
def payer_breakdown(spark, sf):
    """What a payer paid in all and by region, the regions that occur, and how often a region was repeated."""
    paid = read(spark, sf, "orders").select(F.col("o_custkey").alias("payer"), F.col("o_orderpriority").alias("region"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    totals, parts = consolidate.breakdown(paid, "payer", "region", "cents")
    return parts.join(totals.select("payer", F.col("cents").alias("total"), F.col("parts").alias("regions")), "payer")
