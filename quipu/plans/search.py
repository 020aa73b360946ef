"""Full-text scores, tariff detection, versions, lock-outs, golden cases and page formats over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quipu.operators import detection, merge, rules, search, state
from quipu.plans.domain import classify_items, halves, NEW_SQL, OLD_SQL
from quipu.plans.registry import Registry, read
from quipu.plans.texts import norm_sql
from quipu.sources import readers

R = Registry()
case = R.case

_W = lambda c: f"list_filter(string_split({norm_sql(c)}, ' '), lambda w: w <> '')"


def part_index(spark, sf, language=None):
    p = read(spark, sf, "part").withColumn("code", F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    return search.index(p, "code", [F.col("p_type"), F.col("p_name"), F.col("p_brand")], language), p.select("code")


@case(f"""WITH q AS (SELECT *, list_distinct(w) AS u FROM (SELECT query, {_W('query')} AS w FROM (SELECT DISTINCT lower(p_type) || ' ' || p_name AS query FROM part))),
d AS (SELECT *, a || b || c AS v FROM (SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS code, {_W('p_type')} AS a, {_W('p_name')} AS b, {_W('p_brand')} AS c FROM part)),
s AS (SELECT query, code, contains(' ' || array_to_string(v, ' ') || ' ', ' ' || array_to_string(w, ' ') || ' ') AS phrase, round(len(list_intersect(u, v))::DOUBLE / len(u), 3) AS coverage, CAST(len(list_intersect(u, a)) AS INT) AS in_a, CAST(len(list_intersect(u, b)) AS INT) AS in_b,
list_sum([CASE WHEN list_contains(a, x) THEN 10 WHEN list_contains(b, x) THEN 4 WHEN list_contains(c, x) THEN 2 ELSE 0 END FOR x IN u])::DOUBLE / 10.0::DOUBLE / len(v) AS rank FROM q, d WHERE list_has_any(u, v))
SELECT query, code, phrase, coverage, in_a, in_b, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY phrase DESC, coverage DESC, in_a DESC, in_b DESC, rank DESC, code) AS n FROM s) WHERE n <= 8""")
def fulltext_score(spark, sf):
    """The eight best parts for each different kind and name, by weighted words (type A, name B, brand C)."""
    p = read(spark, sf, "part").withColumn("code", F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    asked = p.select(F.concat(F.lower("p_type"), F.lit(" "), "p_name").alias("query")).distinct()
    return search.best_items(search.terms(asked, ["query"], F.col("query")), ["query"], p, "code", ["p_type", "p_name", "p_brand"], 8)


@case(f"SELECT item_id, w AS lex, count(*) AS n, min(pos) AS first FROM (SELECT item_id, unnest({_W('text')}) AS w, generate_subscripts({_W('text')}, 1) AS pos FROM benchmark) GROUP BY 1, 2")
def weighted_vector(spark, sf):
    """Words of each benchmark text with how often and where first they stand."""
    postings = search.index(read(spark, sf, "benchmark"), "item_id", [F.col("text")])
    return postings.select("item_id", "lex", F.size("spots").cast("long").alias("n"), F.array_min("spots").cast("long").alias("first"))


@case()
def fulltext_spanish(spark, sf):
    """Different stems of each document without stop words; tests compare stems with known ones."""
    lex = F.array_sort(F.array_distinct(F.transform(search.lexemes(F.col("text"), "spanish"), lambda z: z["lex"])))
    return read(spark, sf, "documents").select("doc_id", lex.alias("l")).select("doc_id", F.size("l").alias("n_stems"), F.md5(F.array_join("l", " ")).alias("stems_md5"))


@case()
def tariff_detection(spark, sf):
    """Codes of each different part name; tests compare the steps with hand-made cases."""
    postings, codes = part_index(spark, sf)
    groups = spark.createDataFrame([("rings", ["ring", "steel ... ring"], ["hot"], ["000000", "000001"], 50), ("gears", ["gear"], [], ["0000001"], 50), ("first", ["widget"], [], ["00000000"], 40)], "group string, terms array<string>, excluded array<string>, prefixes array<string>, priority int")
    names = read(spark, sf, "part").select(F.col("p_name").alias("query"), F.col("p_name").alias("text")).distinct()
    return detection.detect(names, groups, postings, codes, [6, 7, 8], {"small": "economy"})




@case("SELECT k, 2 AS version FROM (" + OLD_SQL + ") o JOIN (" + NEW_SQL + ") n USING (k) WHERE o.v <> n.v UNION ALL SELECT k, 1 FROM (" + NEW_SQL + ") WHERE k % 3 = 2")
def versioned_history(spark, sf):
    """Versions that a new load adds to a history: contents that changed, keys that are new."""
    old, new = halves(spark, sf)
    none = spark.createDataFrame([], "k long, version int, after string")
    first = merge.new_versions(none, old, "k", "2024.1").select("k", "version", "after")
    return merge.new_versions(first, new, "k", "2024.2").select("k", "version")


@case(f"SELECT k, version, '2024.1+e' || k || 'v' || version AS catalogue FROM (SELECT k, 2 AS version FROM ({OLD_SQL}) o JOIN ({NEW_SQL}) n USING (k) WHERE o.v <> n.v)")
def versioned_edit(spark, sf):
    old, new = halves(spark, sf)
    none = spark.createDataFrame([], "k long, version int, after string")
    first = merge.new_versions(none, old, "k", "2024.1").select("k", "version", "after")
    return merge.edited(first, new.join(old, "k", "left_semi"), "k", "2024.1+e7v1").select("k", "version", "catalogue")


@case("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('error', 'purchase')),
f AS (SELECT user_id, n, event_id, CASE WHEN bad THEN 'failed' ELSE 'in' END AS outcome, CAST(bad AS BIGINT) AS failures, CAST(NULL AS TIMESTAMP) AS until FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN e.ts < f.until THEN 'locked' WHEN bad THEN 'failed' ELSE 'in' END, CASE WHEN e.ts < f.until THEN f.failures WHEN bad THEN f.failures + 1 ELSE 0 END,
CASE WHEN e.ts < f.until THEN f.until WHEN bad AND f.failures + 1 >= 3 THEN e.ts + INTERVAL 12 HOUR END FROM e JOIN f ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT event_id, outcome, failures FROM f""")
def lock_out(spark, sf):
    """Errors as failed and purchases as successful sign-ins; three failures lock for twelve hours."""
    e = read(spark, sf, "events").filter("event_type IN ('error', 'purchase')").select("event_id", "user_id", "ts", "event_type")
    return state.lock_outs(e, ["user_id"], "ts", "event_id", F.col("event_type") == "error", 3, 12 * 3600).select("event_id", "outcome", "failures")


@case("SELECT p_partkey AS item FROM part WHERE regexp_matches(p_name, 'bolt')")
def golden_gate(spark, sf):
    """Golden cases (today's answers) that an edit of the rules breaks: here the edit turns what is known of bolts to another state."""
    answers = classify_items(spark, sf)
    named = read(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").contains("bolt").alias("_b"))
    edit = answers.join(named, "item").withColumn("state", F.when(F.col("_b"), F.lit("edited")).otherwise(F.col("state"))).drop("_b")
    return rules.broken_cases(answers, edit, "item").select("item")


@case("SELECT p_partkey AS page, 'sku' || p_partkey AS id, p_name AS name, p_retailprice AS price, p_size > 25 AS in_stock FROM part WHERE p_retailprice > 0")
def page_flow_offers(spark, sf):
    """Products read back from pages that carry them in two escaped pieces."""
    p = read(spark, sf, "part")
    text = F.concat(F.lit('0:["{",{"name":"'), "p_name", F.lit('","slug":"s-'), F.col("p_partkey").cast("string"), F.lit('","sku":"sku'), F.col("p_partkey").cast("string"), F.lit('","price":'), F.col("p_retailprice").cast("string"), F.lit(',"ean":["1"],"note":"a } b","stock":'), F.when(F.col("p_size") > 25, F.lit("3")).otherwise(F.lit("0")), F.lit("}]"))
    quoted = lambda x: F.concat(F.lit('<script>self.__next_f.push([1,"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"])</script>'))
    html = F.concat(quoted(F.substring(text, 1, 20)), quoted(F.substr(text, F.lit(21))))
    return readers.flow_offers(p.select(F.col("p_partkey").alias("page"), html.alias("html"))).select("page", "id", "name", "price", "in_stock")


@case("SELECT p_partkey AS page, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_retailprice AS price, p_size > 25 AS in_stock FROM part WHERE p_retailprice > 0")
def html_page_offers(spark, sf):
    p = read(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    shown = F.concat(F.lit('<span class="price"><bdi>$'), F.replace(F.format_string("%.2f", "p_retailprice"), F.lit("."), F.lit(",")), F.lit("</bdi></span>"))
    html = F.concat(F.lit('<ul><li class="product type-product'), F.when(F.col("p_size") > 25, F.lit("")).otherwise(F.lit(" outofstock")), F.lit('"><h2 class="woocommerce-loop-product__title">'), "p_name", F.lit("</h2>"), shown, F.lit('<a data-product_id="'), key, F.lit('"></a></li></ul>'))
    return readers.html_offers(p.select(F.col("p_partkey").alias("page"), html.alias("html")), "woocommerce").select("page", "id", "name", "price", "in_stock")


@case("SELECT p_brand, '1000.' || substr(k, 1, 2) || '.' || substr(k, 3, 2) || '.' || substr(k, 5, 2) AS code, 'Part ' || p_name || ' of any size' AS description, CAST(p_size AS VARCHAR) AS rate, 'kg' AS unit FROM (SELECT *, lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '0') AS k FROM part)")
def printed_tariff(spark, sf):
    """Rows read back from texts printed in columns, one text a brand and thousand of parts."""
    k = F.lpad((F.col("p_partkey") % 1_000_000).cast("string"), 6, "0")
    code = F.concat(F.lit("1000."), F.substring(k, 1, 2), F.lit("."), F.substring(k, 3, 2), F.lit("."), F.substring(k, 5, 2))
    row = F.concat(F.lit("  "), code, F.lit("   Part "), "p_name", F.lit("    "), F.col("p_size").cast("string"), F.lit("    kg\n      of any size\n\n"))
    p = read(spark, sf, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 1000).alias("t")).agg(F.array_join(F.collect_list(row), "").alias("text"))
    return readers.printed_tariff(p.select("p_brand", "text"))
