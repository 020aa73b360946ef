"""What must hold before a load is kept: rates, the calendar of duties, the directory.  Each returns (rule, violations, first).

`first` is the least violating key as text.  Rules about single rows of a table are counted in one scan of it; the others are one shuffle each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.operators import quality

#: The currencies that every publication has, the terminals of a duty, how far the next business day may lie.
LEADING, TERMINALS, REACH = ("USD", "EUR"), 10, 30


def row_rules(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """Rules that hold of each row by itself (null passes), all in one scan."""
    bad = {name: F.coalesce(~rule, F.lit(False)) for name, rule in rules.items()}
    sums = [c for name, b in bad.items() for c in (F.count_if(b).alias(f"n_{name}"), F.min(F.when(b, key.cast("string"))).alias(f"k_{name}"))]
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"n_{name}").alias("violations"), F.col(f"k_{name}").alias("first")) for name in rules])
    return df.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")


def counts_match(rule: str, manifest: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """manifest: name, rows.  A table that is missing in the manifest, or has another count, is a violation."""
    counted = quality.report(*(df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in tables.items()))
    return quality.found(rule, counted.join(manifest, "name", "left").filter(~F.col("n").eqNullSafe(F.col("rows"))).select("name"))


def rates_load(rates: DataFrame, publications: DataFrame, sources: DataFrame, silent: DataFrame, loaded_rates: DataFrame, loaded_publications: DataFrame, loaded_sources: DataFrame, manifest: DataFrame, last: DataFrame) -> DataFrame:
    """rates: day, currency, buy, sell; publications: day, traded; sources: file, sha256; silent: day; loaded_* alike; last: day, sell.

    V1 counts; V2 a rate or trading day that contradicts what is loaded (a loaded rate without `buy` contradicts by `sell` alone); V3 a
    publication without the leading currencies; V4 the last rate; V5 a file of a known name with other content; V6 a silent day that has
    a publication.
    """
    both = rates.alias("n").join(loaded_rates.alias("o"), ["day", "currency"])
    contradicts = ~F.col("n.sell").eqNullSafe(F.col("o.sell")) | (F.col("o.buy").isNotNull() & ~F.col("n.buy").eqNullSafe(F.col("o.buy")))
    traded = publications.alias("n").join(loaded_publications.alias("o"), "day").filter("n.traded <> o.traded").select("day")
    leading = rates.filter(F.col("currency").isin(*LEADING)).groupBy("day").agg(F.count_distinct("currency").alias("n"))
    final = last.alias("m").join(rates.filter(F.col("currency") == LEADING[0]).alias("r"), "day", "left").filter(~F.col("m.sell").eqNullSafe(F.col("r.sell"))).select("day")
    return quality.report(
        counts_match("V1 counts", manifest, {"rates": rates, "publications": publications}), quality.found("V2 rate contradicts", both.filter(contradicts).select(F.concat_ws(" ", F.col("day").cast("string"), "currency"))), quality.found("V2 trading day contradicts", traded),
        quality.found("V3 leading currency missing", publications.select("day").join(leading, "day", "left").filter(F.coalesce("n", F.lit(0)) < len(LEADING)).select("day")), quality.found("V4 last rate", final),
        quality.found("V5 file with other content", sources.alias("n").join(loaded_sources.alias("o"), "file").filter("n.sha256 <> o.sha256").select("file")), quality.found("V6 silent day with a publication", silent.join(publications, "day", "left_semi").select("day")),
    )


def business_day_from(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """days: day -> (day, open): the first day from it on that is neither a weekend nor a holiday, null beyond REACH days."""
    ahead = days.select("day").distinct().select("day", F.explode(F.sequence("day", F.date_add("day", REACH))).alias("open")).filter("dayofweek(open) BETWEEN 2 AND 6")
    return ahead.join(holidays.select(F.col("day").alias("open")), "open", "left_anti").groupBy("day").agg(F.min("open").alias("open"))


def calendar_load(due: DataFrame, holidays: DataFrame, manifest: DataFrame, annual: Sequence[str], first_half: Sequence[str], second_half: Sequence[str], ordinary: str, twins: Sequence[tuple[str, str]]) -> DataFrame:
    """due: duty, terminal, day, extended, since, until (dates); holidays: day, national.

    V1 counts; V2 no due day on a weekend or a national holiday; V3 one a terminal and month; V4 all terminals in each month, of annual duties
    once each; V5 first halves fall due from the 16th of their month, second halves up to the 16th of the next; V6 the ordinary duty on the
    15th after its period or the next business day; V7 twins are the same table; V8 extended if and only if the day is a holiday, to the
    next business day.
    """
    key = F.concat_ws(" ", "duty", F.col("terminal").cast("string"), F.col("day").cast("string"))
    month = F.trunc("day", "month")
    marked = due.join(holidays.select("day", "national").distinct(), "day", "left")
    rows = row_rules(marked, key, {
        "V2 due on a closed day": ~(F.dayofweek("day").isin(1, 7) | F.coalesce("national", F.lit(False))),
        "V5 half months": ~((F.col("duty").isin(*first_half) & ((F.dayofmonth("day") < 16) | (F.trunc("since", "month") != month))) | (F.col("duty").isin(*second_half) & ((F.dayofmonth("day") > 16) | (F.add_months(F.trunc("until", "month"), 1) != month)))),
    })
    monthly, yearly = due.filter(~F.col("duty").isin(*annual)), due.filter(F.col("duty").isin(*annual))
    covered = monthly.groupBy("duty", month.alias("m")).agg(F.count_distinct("terminal").alias("t")).filter(F.col("t") != TERMINALS).select("duty")
    once = yearly.groupBy("duty").agg(F.count_distinct("terminal").alias("t"), F.count(F.lit(1)).alias("n")).filter((F.col("t") != TERMINALS) | (F.col("n") != TERMINALS)).select("duty")
    periods = due.filter(F.col("duty") == ordinary).select("day", F.date_add("until", 15).alias("from")).distinct()
    opens = business_day_from(periods.select(F.col("from").alias("day")), holidays).withColumnRenamed("day", "from")
    late = periods.join(opens, "from", "left").filter(~F.col("open").eqNullSafe(F.col("day"))).select("day")
    after = business_day_from(holidays.select(F.date_add("day", 1).alias("day")), holidays).select(F.date_sub("day", 1).alias("day"), "open")
    extended = marked.join(after, "day", "left").filter((F.col("extended").isNotNull() != F.col("national").isNotNull()) | (F.col("extended") != F.col("open"))).select(key)
    table = lambda duty: due.filter(F.col("duty") == duty).select("terminal", "day").distinct()
    apart = [table(a).exceptAll(table(b)).unionByName(table(b).exceptAll(table(a))) for a, b in twins]
    differs = apart[0]
    for more in apart[1:]:
        differs = differs.unionByName(more)
    return quality.report(
        counts_match("V1 counts", manifest, {"due": due}), rows, quality.found("V3 two a terminal and month", due.groupBy("duty", "terminal", month.alias("m")).count().filter("count > 1").select(F.concat_ws(" ", "duty", F.col("terminal").cast("string"), F.col("m").cast("string")))),
        quality.found("V4 terminals missing", covered.unionByName(once).distinct()), quality.found("V6 ordinary due day", late), quality.found("V7 twins differ", differs.select(F.concat_ws(" ", F.col("terminal").cast("string"), F.col("day").cast("string")))), quality.found("V8 extension", extended),
    )


def directory_load(taxpayers: DataFrame, listed: dict[str, DataFrame], addresses: DataFrame, payers: DataFrame, regions: DataFrame, manifest: DataFrame) -> DataFrame:
    """taxpayers: id, sources (array); listed: source -> id; addresses: id and fields; payers: id, cents, regions; regions: id, region, cents.

    V1 counts; V2 an address twice, whatever its case, null like empty; V3 a source that is named without its row, or the other way; V4 a total
    or a number of regions that is not that of the regions.
    """
    fields = [c for c in addresses.columns if c != "id"]
    twice = addresses.groupBy("id", *[F.upper(F.coalesce(c, F.lit(""))).alias(c) for c in fields]).count().filter("count > 1").select("id")
    there = taxpayers.select("id", "sources")
    for source, rows in listed.items():
        there = there.join(rows.select("id").distinct().withColumn(f"in_{source}", F.lit(True)), "id", "left")
    wrong = F.lit(False)
    for source in listed:
        wrong = wrong | (F.array_contains("sources", source) != F.coalesce(f"in_{source}", F.lit(False)))
    sums = regions.groupBy("id").agg(F.sum("cents").alias("sum"), F.count(F.lit(1)).alias("n"))
    unequal = payers.join(sums, "id", "left").filter(~F.col("cents").eqNullSafe(F.col("sum")) | (F.col("regions") != F.coalesce("n", F.lit(0)))).select("id")
    return quality.report(
        counts_match("V1 counts", manifest, {"taxpayers": taxpayers, "addresses": addresses, "payers": payers, "regions": regions, **listed}), quality.found("V2 address twice", twice),
        quality.found("V3 source without its row", there.filter(wrong).select("id")), quality.found("V4 totals", unequal),
    )
