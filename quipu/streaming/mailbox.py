"""Mailboxes read pass by pass with cursors of our own: validity of the numbering, high-water mark, a bounded number of messages a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

CURSOR = "pass int, mailbox long, validity int, uid long"
#: Of a message: how many passes after the one that its folder is named after.
LATER = "_later"


def cursors(spark: SparkSession, folder: str) -> DataFrame:
    """(mailbox, validity, uid, pass): where each mailbox stands after the passes that were committed."""
    try:
        rows = spark.read.schema(CURSOR).parquet(f"{folder}/cursors")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CURSOR)
    last = F.max_by(F.struct("validity", "uid"), "pass").alias("c")
    return rows.groupBy("mailbox").agg(last, F.max("pass").alias("pass")).select("mailbox", "c.validity", "c.uid", "pass")


def taken(spark: SparkSession, folder: str) -> DataFrame:
    """All messages that passes have taken, with their pass."""
    return spark.read.parquet(f"{folder}/taken").withColumn("pass", F.col("pass") + F.col(LATER)).drop(LATER)


def mailbox_pass(messages: DataFrame, folder: str, most: int = 100, whole: bool = False) -> bool:
    """One pass over messages (mailbox, validity, uid, ...): the next ones of each mailbox, at most `most`.  False if there was nothing to do.

    A mailbox without a cursor is read from the start.  If the server has numbered it anew (another validity), the cursor goes to its last
    message and what is there is not read again.  The messages are written first, in a folder of the pass, then the cursors in one commit;
    a pass that fails in between is done again over its own folder, so no message is taken twice or lost.

    whole: as many passes as it takes until nothing is left, in one job: a message's pass follows from its place in its mailbox.  They are
    committed together, by the last cursor of each mailbox.
    """
    spark = messages.sparkSession
    now = cursors(spark, folder)
    turn = (now.agg(F.max("pass")).first()[0] or 0) + 1
    held = now.select("mailbox", F.col("validity").alias("held"), F.col("uid").alias("mark"))
    there = messages.join(held, "mailbox", "left")
    known = F.col("held") == F.col("validity")
    fresh = there.filter(F.col("held").isNull() | (known & (F.col("uid") > F.col("mark"))))
    place = F.row_number().over(Window.partitionBy("mailbox").orderBy("uid"))
    fresh = fresh.withColumn(LATER, F.floor((place - 1) / most).cast("int")).filter(F.lit(whole) | (F.col(LATER) == 0)).select(*messages.columns, LATER)
    fresh.write.mode("overwrite").parquet(f"{folder}/taken/pass={turn}")
    read = spark.read.schema(fresh.schema).parquet(f"{folder}/taken/pass={turn}")
    moved = read.groupBy("mailbox", "validity").agg(F.max("uid").alias("uid"), F.max(LATER).alias("later"))
    reset = there.filter(~known).groupBy("mailbox", "validity").agg(F.max("uid").alias("uid"), F.lit(0).alias("later"))
    after = moved.unionByName(reset).select((turn + F.col("later")).cast("int").alias("pass"), "mailbox", F.col("validity").cast("int"), F.col("uid").cast("long"))
    if after.isEmpty():
        return False
    after.write.mode("append").parquet(f"{folder}/cursors")
    return True


def read_all(messages: DataFrame, folder: str, most: int = 100) -> None:
    """Passes until nothing is left, in one job whatever their number."""
    mailbox_pass(messages, folder, most, whole=True)
