"""Writers: guarded CSV, NDJSON, calendars, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded(df: DataFrame) -> DataFrame:
    """Texts that a spreadsheet would take as a formula get an apostrophe before them."""
    return df.withColumns({c: F.regexp_replace(c, r"^([=+\-@\t\r])", "'$1") for c, t in df.dtypes if t == "string"})


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    guarded(df).write.mode(mode).option("header", True).option("lineSep", "\r\n").option("escape", '"').csv(path)


def write_ndjson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def folded(line: Column, width: int = 74) -> Column:
    """A calendar line folded: pieces of at most `width` characters, each after the first begun with a blank."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(line) - 1) / width), F.lit(0))), lambda i: F.substr(line, (i * width + 1).cast("int"), F.lit(width)))
    return F.array_join(pieces, "\r\n ")


def calendar_events(df: DataFrame, uid: str, day: str, title: str) -> DataFrame:
    """One all-day event per row as iCalendar text in column `ics`.  Lines are folded by characters, below 75 octets for ASCII titles."""
    escaped = F.regexp_replace(F.regexp_replace(title, r"([\;,])", r"\\$1"), "\n", r"\\n")
    stamp = F.date_format(day, "yyyyMMdd")
    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col(uid).cast("string")), F.concat(F.lit("DTSTART;VALUE=DATE:"), stamp), F.concat(F.lit("DTEND;VALUE=DATE:"), F.date_format(F.date_add(day, 1), "yyyyMMdd")), folded(F.concat(F.lit("SUMMARY:"), escaped)), F.lit("END:VEVENT")]
    return df.select(uid, F.array_join(F.array(*lines), "\r\n").alias("ics"))


def manifest(df: DataFrame, name: str) -> DataFrame:
    """(name, rows, digest): the digest does not depend on the order of the rows."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    part = lambda at: F.sum(F.conv(F.substring(row, at, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("-", part(1), part(13), part(25)), 256).alias("digest"))
