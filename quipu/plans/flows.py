"""Streams, readers and writers over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quipu.plans.domain import _ROUNDED
from quipu.plans.registry import Registry, read
from quipu.sources import readers, writers
from quipu.sources.shared import materialized, shared_folder
from quipu.streaming import streams

R = Registry()
case = R.case


def event_stream(spark, sf):
    return streams.file_stream(spark, f"{sf}/events.parquet*", read(spark, sf, "events").schema)


@case("SELECT CAST(ts - INTERVAL 4 HOUR AS DATE) AS day, user_id, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1, 2", dates=("day",))
def stream_usage_counter(spark, sf):
    return streams.drained(streams.usage_counts(event_stream(spark, sf)), "usage", "complete")


@case("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_of_key(spark, sf):
    return streams.drained(streams.first_of_key(event_stream(spark, sf).select("user_id", "event_type"), "user_id", "event_type"), "first")


@case("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_tumbling_counts(spark, sf):
    """Windows that the watermark has passed when the source is drained."""
    return streams.drained(streams.tumbling_counts(event_stream(spark, sf), "6 hours", "1 hour"), "tumbling")


@case(f"WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ({_ROUNDED})), f AS (SELECT user_id, n, event_id, price, ts AS kept_at, price AS kept, true AS k FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.event_id, e.price, CASE WHEN e.price <> f.kept OR e.ts - f.kept_at >= INTERVAL 1 DAY THEN e.ts ELSE f.kept_at END, CASE WHEN e.price <> f.kept OR e.ts - f.kept_at >= INTERVAL 1 DAY THEN e.price ELSE f.kept END, e.price <> f.kept OR e.ts - f.kept_at >= INTERVAL 1 DAY FROM e JOIN f ON e.user_id = f.user_id AND e.n = f.n + 1) SELECT event_id, user_id, price FROM f WHERE k")
def stream_price_history(spark, sf):
    prices = event_stream(spark, sf).select("event_id", "user_id", "ts", F.round(F.col("value") / 20).alias("price"))
    return streams.drained(streams.changed_prices(prices, 86_400), "prices")


@case("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, sf):
    """Written as guarded CSV, read again into declared types."""
    path = shared_folder(spark, "nation")
    writers.write_csv(read(spark, sf, "nation"), path)
    return readers.typed_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@case("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def materialized_view(spark, sf):
    """The rows that a stored view holds."""
    return materialized(read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), "statuses")


@case("SELECT c_custkey, regexp_replace(c_name || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' x' END, '^(C)', '''\\1') AS shown FROM customer WHERE false UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '''=' || c_name WHEN c_custkey % 3 = 1 THEN '''-' || c_name ELSE c_name END FROM customer")
def csv_formula_guard(spark, sf):
    k = F.col("c_custkey")
    shown = F.when(k % 3 == 0, F.concat(F.lit("="), "c_name")).when(k % 3 == 1, F.concat(F.lit("-"), "c_name")).otherwise(F.col("c_name"))
    return writers.guarded(read(spark, sf, "customer").select("c_custkey", shown.alias("shown")))


@case("SELECT o_orderkey, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || o_orderkey || chr(13) || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(o_orderdate, '%Y%m%d') || chr(13) || chr(10) || 'DTEND;VALUE=DATE:' || strftime(o_orderdate + INTERVAL 1 DAY, '%Y%m%d') || chr(13) || chr(10) || 'SUMMARY:Order\\, ' || o_orderpriority || chr(13) || chr(10) || 'END:VEVENT' AS ics FROM orders")
def calendar_export(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.concat(F.lit("Order, "), "o_orderpriority").alias("title"))
    return writers.calendar_events(o, "o_orderkey", "day", "title")


@case("SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def table_manifest(spark, sf):
    return writers.manifest(read(spark, sf, "customer"), "customer").unionByName(writers.manifest(read(spark, sf, "orders"), "orders")).select("name", "rows")


@case("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"<> ]+)\"', 1)) AS link FROM pages")
def page_links(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"<> ]+)"'), F.lit(1))).alias("link"))


@case("SELECT DISTINCT url FROM pages WHERE regexp_matches(url, '/en/')")
def sitemap_urls(spark, sf):
    """Locations read back from sitemaps that hold the pages' addresses."""
    maps = read(spark, sf, "pages").groupBy((F.col("page_id") % 16).alias("m")).agg(F.concat_ws("", F.transform(F.collect_list("url"), lambda u: F.concat(F.lit("<url><loc> "), u, F.lit("</loc></url>")))).alias("xml"))
    return readers.sitemap_urls(maps, "/en/")


@case("SELECT page_id, url AS link, 'Entry ' || page_id AS title FROM pages")
def rss_entries(spark, sf):
    p = read(spark, sf, "pages")
    xml = F.concat(F.lit("<rss><channel><title>x</title><item><title><![CDATA[Entry <b>"), F.col("page_id").cast("string"), F.lit("</b>]]></title><link>"), F.col("url"), F.lit("</link></item></channel></rss>"))
    return readers.rss_entries(p.select("page_id", xml.alias("xml"))).select("page_id", "link", "title")
