"""Civil days, half months, business days.  A civil day is that of UTC-4, which has no daylight saving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def civil_day(ts: Column) -> Column:
    return F.to_date(ts - F.expr("INTERVAL 4 HOURS"))


def half_month(day: Column) -> list[Column]:
    """First and last day of the half month."""
    first = F.dayofmonth(day) <= 15
    middle = F.date_add(F.trunc(day, "month"), 14)
    return [F.when(first, F.trunc(day, "month")).otherwise(F.date_add(middle, 1)).alias("period_from"), F.when(first, middle).otherwise(F.last_day(day)).alias("period_to")]


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(day) for each day of the range."""
    return spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 1 DAY)) AS day")


def business_days(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Days that are neither a weekend nor in holidays(day)."""
    return days.filter(F.weekday("day") < 5).join(F.broadcast(holidays), "day", "left_anti")


def next_business_day(days: DataFrame, holidays: DataFrame, within: int = 30) -> DataFrame:
    """(day, next_day): the first business day from each day on, at most `within` days later, else null.

    Each business day is offered to the days before it; the calendar is small whatever the facts are.
    """
    open_ = business_days(days, holidays).select(F.col("day").alias("next_day"))
    offered = open_.select("next_day", F.explode(F.sequence(F.date_sub("next_day", within), F.col("next_day"))).alias("day"))
    return days.join(offered.groupBy("day").agg(F.min("next_day").alias("next_day")), "day", "left")
