"""Notices, crawl order, recipients, registers of rates: selections that scheduled jobs make, each as one DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.operators.relational import top_per_key


def registered(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """incoming with `outcome`: new, unchanged or discrepancy (with the `stored` value, which stays as it is)."""
    known = existing.select(*keys, F.col(value).alias("stored"), F.lit(True).alias("_known"))
    outcome = F.when(F.col("_known").isNull(), "new").when(F.col("stored").eqNullSafe(F.col(value)), "unchanged").otherwise("discrepancy")
    return incoming.join(known, list(keys), "left").withColumn("outcome", outcome).drop("_known")


def due_notices(followed: DataFrame, duties: DataFrame, on: Sequence[str], today: Column, sent: DataFrame, ahead: Sequence[int] = (0, 3)) -> DataFrame:
    """followed: device, id, `on`; duties: `on`, duty, due.  One notice for each (device, id, duty, due, moment) that is due in `ahead` days and not yet sent."""
    moment = F.datediff("due", today)
    near = duties.withColumn("moment", moment).filter(F.col("moment").isin(*ahead))
    keys = ["device", "id", "duty", "due", "moment"]
    return followed.join(near, list(on)).select(*keys).distinct().join(sent.select(*keys), keys, "left_anti")


def unread(items: DataFrame, seen: DataFrame, key: str, ts: str, title: str) -> DataFrame:
    """Per key the number of items since it was last seen and the latest of them; keys without unread items have no row."""
    later = items.join(seen.select(key, F.col(ts).alias("_since")), key, "left").filter(F.col("_since").isNull() | (F.col(ts) > F.col("_since")))
    return later.groupBy(key).agg(F.count(F.lit(1)).alias("unread"), F.max_by(title, F.struct(ts, title)).alias("latest"))


def next_recipients(people: DataFrame, suppressed: DataFrame, now: Column, follow_up_days: int, n: int) -> DataFrame:
    """people: id, mail, sector, state, sends, last_sent, created -> the first n with the `kind` of mail.

    Follow-ups (one mail sent, that many days ago) go before first mails, then who has waited longest; suppressed addresses and
    natural persons get none.
    """
    old = F.col("last_sent") < now - F.make_dt_interval(F.lit(follow_up_days))
    follow = (F.col("state") == "contacted") & (F.col("sends") == 1) & old
    open_ = people.filter((F.col("sector") != "consumer") & ((F.col("state") == "pending") | follow)).withColumn("_mail", F.lower("mail"))
    left = open_.join(suppressed.select(F.lower("mail").alias("_mail")), "_mail", "left_anti").drop("_mail")
    kind = F.when(F.col("state") == "contacted", "follow_up").otherwise("first")
    return left.withColumn("kind", kind).orderBy(F.col("kind") == "first", F.coalesce("last_sent", "created"), "id").limit(n)


def allowed(path: Column, rules: Column) -> Column:
    """robots.txt: the longest pattern that fits decides, of equal ones the one that allows; without any the path is allowed.

    rules: array<struct<pattern, allow>>; `*` stands for anything, `$` at the end ends the path.
    """
    regex = lambda p: F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"([.+?^{}()|\[\]\\])", r"\\$1"), r"\*", ".*"), r"\$(?!$)", r"\\\$"))
    fits = F.filter(rules, lambda r: (r["pattern"] != "") & F.regexp_like(path, regex(r["pattern"])))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def frontier(urls: DataFrame, robots: DataFrame, n: int) -> DataFrame:
    """urls: host, url, path, priority, last_try -> the next n of each host: priority falling and nulls last, never tried first, then oldest.

    robots: host, pattern, allow.  A host's few rules are gathered; the pages are joined with them once.
    """
    rules = robots.groupBy("host").agg(F.collect_list(F.struct("pattern", "allow")).alias("_rules"))
    free = urls.join(rules, "host", "left").filter(F.col("_rules").isNull() | allowed(F.col("path"), F.col("_rules"))).drop("_rules")
    return top_per_key(free, ["host"], [F.desc_nulls_last("priority"), F.asc_nulls_first("last_try"), F.col("url")], n)


def back_off(results: DataFrame, key: str, ts: str, tie: str, failed: Column) -> DataFrame:
    """Per key the failures since its last success and the minutes to wait: 1, 2, 4 … up to 60; 0 after a success."""
    marked = results.select(key, F.struct(ts, tie).alias("_at"), failed.alias("_f"))
    last = marked.filter("NOT _f").groupBy(key).agg(F.max("_at").alias("_ok"))
    later = marked.join(last, key, "left").groupBy(key).agg(F.count_if(F.col("_f") & (F.col("_ok").isNull() | (F.col("_at") > F.col("_ok")))).alias("failures"))
    wait = F.when(F.col("failures") == 0, 0).otherwise(F.least(F.lit(60), F.pow(F.lit(2.0), F.least(F.col("failures") - 1, F.lit(6))).cast("int")))
    return later.withColumn("minutes", wait)


def admitted(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows at most `days` old; times in the future become now."""
    return df.filter(F.col(ts) >= now - F.make_dt_interval(F.lit(days))).withColumn(ts, F.least(F.col(ts), now))
