"""Streams with state of their own: kept lookups, tables by version, mailbox cursors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quipu.plans.registry import Registry, read
from quipu.sources.shared import shared_folder
from quipu.streaming import cached, dimension, mailbox, streams

R = Registry()
case = R.case


#: The first hour of the events' month, counted from 1970.
START_HOUR = 473_352


def sliced(events, path: str, place, slices: range) -> None:
    """The events as files that arrive one after the other, by slice."""
    for n in slices:
        events.filter(place == n).repartition(1).write.mode("append").parquet(path)


_REQUESTS_SQL = "SELECT event_id AS request_id, user_id AS code, ts AS t, event_type = 'error' AS failed, CASE WHEN event_type NOT IN ('error', 'signup') THEN event_type || '-' || CAST(event_id AS VARCHAR) END AS value FROM events"
_VALID = "r.t < f.kept_at + CASE WHEN f.kept IS NULL THEN INTERVAL 12 HOUR ELSE INTERVAL 3 DAY END"


@case(f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY t, request_id) AS n FROM ({_REQUESTS_SQL})),
f AS (SELECT code, n, request_id, t, CASE WHEN NOT failed THEN t END AS kept_at, value AS kept, false AS from_cache, false AS stale FROM r WHERE n = 1
  UNION ALL SELECT r.code, r.n, r.request_id, r.t, CASE WHEN coalesce({_VALID}, false) OR r.failed THEN f.kept_at ELSE r.t END, CASE WHEN coalesce({_VALID}, false) OR r.failed THEN f.kept ELSE r.value END,
  coalesce({_VALID}, false), r.failed AND NOT coalesce({_VALID}, false) AND f.kept_at IS NOT NULL FROM f JOIN r ON r.code = f.code AND r.n = f.n + 1)
SELECT request_id, code, kept AS value, from_cache, stale FROM f WHERE epoch_ms(t) < (SELECT epoch_ms(max(ts) - INTERVAL 1 DAY) FROM events)""")
def stream_cached_lookups(spark, sf):
    """Lookups by user, kept three days if found and half a day if not; sign-ups find nothing, errors fail.  Six files, out of order by up to 16 hours."""
    e = read(spark, sf, "events")
    hours = (F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600 + (F.col("event_id") % 3) * 8).cast("long")
    path = shared_folder(spark, "requests")
    sliced(e, path, F.greatest(F.lit(0), F.least(F.lit(5), F.floor((hours - START_HOUR) / 128))), range(6))
    stream = streams.file_stream(spark, path, e.schema, 1)
    kind = F.col("event_type")
    value = F.when(~kind.isin("error", "signup"), F.concat_ws("-", kind, F.col("event_id").cast("string")))
    requests = stream.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("code"), F.col("ts").alias("at"), (kind == "error").alias("failed"), value.alias("value"))
    return streams.drained(cached.cached_lookups(requests, 3 * 86_400, 43_200, "1 day"), "lookups")


@case("""SELECT event_id, user_id, half + 1 AS version, CASE WHEN half = 0 THEN c_mktsegment WHEN user_id % 2 = 0 THEN 'moved ' || c_mktsegment END AS segment
FROM (SELECT event_id, user_id, CASE WHEN day(ts) > 15 THEN 1 ELSE 0 END AS half FROM events) LEFT JOIN customer ON c_custkey = user_id""")
def stream_versioned_dimension(spark, sf):
    """Events of the first half of the month see the first version of the customers' segments, later ones a second one, put in between two runs."""
    e, c = read(spark, sf, "events"), read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    source, table, out, state = (shared_folder(spark, n) for n in ("source", "table", "out", "state"))
    half = (F.dayofmonth("ts") > 15).cast("int")
    sliced(e, source, half, range(1))
    stream = streams.file_stream(spark, source, e.schema, 1).select("event_id", "user_id")
    dimension.put_version(c, table, 1)
    dimension.joined_by_version(stream, table, ["user_id"], out, state)
    dimension.put_version(c.filter("user_id % 2 = 0").withColumn("segment", F.concat(F.lit("moved "), "segment")), table, 2)
    sliced(e, source, half, range(1, 2))
    dimension.joined_by_version(stream, table, ["user_id"], out, state)
    return spark.read.parquet(out).select("event_id", "user_id", F.col("version").cast("long").alias("version"), "segment")


@case("""WITH m AS (SELECT user_id AS mailbox, event_id AS uid, CASE WHEN day(ts) <= 10 THEN 1 WHEN day(ts) <= 20 THEN 2 ELSE 3 END AS run FROM events WHERE NOT (user_id % 5 = 0 AND day(ts) BETWEEN 11 AND 20)),
t AS (SELECT *, (row_number() OVER (PARTITION BY mailbox, run ORDER BY uid) + 9) // 10 AS nth FROM m), n AS (SELECT run, max(nth) AS n FROM (SELECT run, nth FROM t UNION ALL SELECT 2, 1) GROUP BY run)
SELECT mailbox, uid, nth + coalesce((SELECT sum(n) FROM n WHERE n.run < t.run), 0)::BIGINT AS pass FROM t""")
def stream_mailbox_cursor(spark, sf):
    """Three runs over growing mailboxes, ten messages a pass; before the second one every fifth mailbox is numbered anew."""
    e, folder = read(spark, sf, "events"), shared_folder(spark, "mailboxes")
    renumbered = F.when(F.col("user_id") % 5 == 0, 2).otherwise(1)
    box = lambda upto, validity: e.filter(F.dayofmonth("ts") <= upto).select(F.col("user_id").alias("mailbox"), validity.cast("int").alias("validity"), F.col("event_id").alias("uid"))
    for upto, validity in ((10, F.lit(1)), (20, renumbered), (31, renumbered)):
        mailbox.read_all(box(upto, validity), folder, 10)
    return mailbox.taken(spark, folder).select("mailbox", "uid", F.col("pass").cast("long").alias("pass"))
