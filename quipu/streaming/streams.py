"""Micro-batch and stateful streams over an event source; each works on any streaming DataFrame with the columns it names."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quipu.functions.dates import civil_day
from quipu.sources.shared import shared_folder


def file_stream(spark: SparkSession, path: str, schema: Any, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there now and returns what it wrote.

    Append mode goes to a Parquet sink with a checkpoint; complete mode writes each batch over the last one, so a repeated batch changes nothing.
    """
    spark = stream.sparkSession
    out, state = shared_folder(spark, name), shared_folder(spark, f"{name}-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def usage_counts(events: DataFrame) -> DataFrame:
    """Calls and errors by civil day and user."""
    return events.groupBy(civil_day(F.col("ts")).alias("day"), "user_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"))


def tumbling_counts(events: DataFrame, window: str, lateness: str) -> DataFrame:
    """Events by type in tumbling windows; a window is given out when the watermark has passed it."""
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def first_of_key(events: DataFrame, *keys: str) -> DataFrame:
    """One winner per key, over batches too."""
    return events.dropDuplicates(list(keys))


def changed_prices(prices: DataFrame, heartbeat_seconds: int) -> DataFrame:
    """Change-only history with a heartbeat, per user; the state is the last stored price and time.  A null price is a price like others.

    Rows are ordered within a micro-batch, which holds a user's rows of `files_per_trigger` files: the source must bring a user's rows of
    different batches in order.
    """

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_price, last_at = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        chosen = []
        for event_id, at, price in zip(rows["event_id"], rows["ts"], rows["price"], strict=True):
            same = price == last_price or (pd.isna(price) and pd.isna(last_price))
            if last_at is None or not same or (at.timestamp() - last_at) >= heartbeat_seconds:
                chosen.append((event_id, key[0], price))
                last_price, last_at = price, at.timestamp()
        state.update((None if pd.isna(last_price) else float(last_price), float(last_at)))
        yield pd.DataFrame(chosen, columns=["event_id", "user_id", "price"])

    grouped = prices.groupBy("user_id")
    return grouped.applyInPandasWithState(keep, "event_id long, user_id long, price double", "price double, at double", "append", GroupStateTimeout.NoTimeout)
