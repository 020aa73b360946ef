"""A stream joined with a small table that is read anew when its version changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put_version(table: DataFrame, path: str, version: int) -> None:
    """Stores a whole version of a table; a version that is written again replaces itself."""
    table.write.mode("overwrite").parquet(f"{path}/version={version}")


def latest_version(spark: SparkSession, path: str) -> int:
    """The highest version there is, from the folders' names; no rows are read."""
    return int(spark.read.parquet(path).agg(F.max("version")).first()[0])


def joined_by_version(stream: DataFrame, path: str, keys: Sequence[str], out: str, checkpoint: str, how: str = "left") -> None:
    """Runs the stream over what is there now; every micro-batch is joined with the version that is the latest when it begins.

    The table is planned anew only for another version.  A micro-batch is one folder `batch=<n>` of `out` and names its version, so a batch
    that is repeated after a failure replaces its own rows.  A version appears at once, as its folder is committed.
    """
    spark, held = stream.sparkSession, {}

    def write(batch: DataFrame, n: int) -> None:
        version = latest_version(spark, path)
        if version not in held:
            held.clear()
            held[version] = spark.read.parquet(f"{path}/version={version}").withColumn("version", F.lit(version))
        batch.join(held[version], list(keys), how).withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
