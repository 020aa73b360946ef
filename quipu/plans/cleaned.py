"""Directory fields cleaned, over the driver's tables with the faults that such fields have."""

from __future__ import annotations

from pyspark.sql import functions as F

from quipu.functions import clean
from quipu.plans.registry import Registry, read

R = Registry()
case = R.case

_N = "c_custkey"


@case(f"""SELECT c_custkey, CASE {_N} % 4 WHEN 0 THEN NULL ELSE c_name END AS name, CASE WHEN {_N} % 5 > 0 THEN 'c' || {_N} || '@mail.org' END AS mail, CASE {_N} % 3 WHEN 0 THEN NULL ELSE '0414-' || lpad(CAST(1000000 + {_N} AS VARCHAR), 7, '0') END AS phone,
  CASE WHEN {_N} % 13 < 12 THEN '2026' || lpad(CAST({_N} % 13 + 1 AS VARCHAR), 2, '0') END AS period, CAST(CAST({_N} * 1000 AS BIGINT) + 0.25 AS DOUBLE) AS cents, 'Customer ' || {_N} || ' de ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || CASE WHEN {_N} % 2 = 0 THEN ' C.A.' ELSE ' S.R.L.' END AS company,
  'CUSTOMER' || lpad(CAST({_N} AS VARCHAR), 9, '0') || c_mktsegment AS key FROM customer""")
def directory_cleaned(spark, sf):
    """Names, addresses, telephones, periods, amounts and company names as a source writes them, cleaned."""
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    raw = read(spark, sf, "customer").select(
        "c_custkey", F.when(k % 4 == 0, " No  Indica ").otherwise(F.concat(F.lit(" "), "c_name", F.lit("  "))).alias("name"), F.when(k % 5 == 0, F.concat(F.lit("at home"), text)).otherwise(F.concat(F.lit(" C"), text, F.lit(" @mail.ORG"))).alias("mail"),
        F.when(k % 3 == 0, "0000-0000000").when(k % 3 == 1, F.concat(F.lit("(414) "), (k + 1_000_000).cast("string"))).otherwise(F.concat(F.lit("0414."), (k + 1_000_000).cast("string"))).alias("phone"),
        F.concat(F.lit("2026"), F.lpad((k % 13 + 1).cast("string"), 2, "0")).alias("period"), F.concat(F.lit("Bs. "), F.regexp_replace(F.format_number(k * 1000, 0), ",", "."), F.lit(",25")).alias("amount"),
        F.concat(F.lit("CUSTOMER  "), text, F.lit(" DE "), "c_mktsegment", F.when(k % 2 == 0, " C A").otherwise(" s.r.l")).alias("company"), F.concat_ws(" - ", "c_name", F.initcap("c_mktsegment")).alias("key"),
    )
    return raw.select("c_custkey", clean.said(F.col("name")).alias("name"), clean.mail(F.col("mail")).alias("mail"), clean.phone(F.col("phone")).alias("phone"), clean.period(F.col("period")).alias("period"), clean.money(F.regexp_replace("amount", "^Bs. ", "")).cast("double").alias("cents"), clean.company(F.col("company")).alias("company"), clean.comparison_key(F.col("key")).alias("key"))


@case("SELECT page_id, 'https://' || regexp_extract(url, '^https?://([^/]+)', 1) || '/img/' || page_id || '.png' AS rooted, CASE WHEN page_id % 3 > 0 THEN regexp_replace(url, '^http://', 'https://') END AS own FROM pages")
def page_images(spark, sf):
    """Image addresses of pages made safe: rooted ones under the page's host, the page's own address, data left out."""
    p = read(spark, sf, "pages")
    rooted = clean.image_url(F.concat(F.lit("/img/"), F.col("page_id").cast("string"), F.lit(".png")), F.col("url"))
    own = clean.image_url(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("data:"), "url")).otherwise(F.col("url")), F.col("url"))
    return p.select("page_id", rooted.alias("rooted"), own.alias("own"))
