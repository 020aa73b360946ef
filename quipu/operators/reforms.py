"""Ordered reforms of a table: each instrument changes what the ones before it left; every changed field and every conflict is kept.

A code's history depends on no other code's, so all instruments are applied in one pass: one shuffle brings a code's record and its changes
together, and a fold over the sorted changes carries the record, the field log and the conflicts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quipu.sources.shared import materialized

LOG = "array<struct<step:int,article:int,kind:string,field:string,before:string,after:string>>"
CONFLICT = "array<struct<step:int,article:int,kind:string,detail:string>>"
STATE = f"struct<record:array<string>,step:int,log:{LOG},conflicts:{CONFLICT}>"


@dataclass
class Reformed:
    """state: key, fields, step (of the last change, 0: the base's).  log: key, seq and what changed.  conflicts: key, seq, step, article, kind, detail."""

    state: DataFrame
    log: DataFrame
    conflicts: DataFrame


def _tight(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")


def _there(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull())


def _differ(a: Column, b: Column) -> Column:
    """Empty and null are one value."""
    return F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit(""))


def events(changes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One sorted array of changes a key.

    changes: key, step, article, line, action, the fields as text, and `named`, the fields that a list sets.  Actions: `says` (what the
    instrument takes to be there), `set` and `add` (what shall be there), `list` (new values of some fields of a code that is there).
    Of one article, `says` without `set` or `add` deletes; lists come after all articles of their instrument.  Repeated rows count once.
    Of rows of one line the one with the least `place` goes first, if there is such a column, then that with the smaller values.
    """
    values = F.array(*[F.col(f).cast("string") for f in fields])
    place = F.col("place") if "place" in changes.columns else F.lit(0)
    rows = changes.select(key, "step", "article", "line", "action", values.alias("values"), "named", place.alias("place"))
    rows = rows.groupBy(key, "step", "article", "line", "action", "values", "named").agg(F.min("place").alias("place"))
    first, last = F.struct("line", "place", "values"), F.struct(-F.col("line"), "place", "values")
    articles = rows.filter("action <> 'list'").groupBy(key, "step", "article").agg(
        F.bool_or(F.col("action") == "says").alias("said"), F.min_by("values", F.when(F.col("action") == "says", first)).alias("claimed"),
        F.min_by(F.struct("action", "values"), F.when(F.col("action") != "says", last)).alias("put"),
    )
    none = F.array().cast("array<string>")
    nomenclature = articles.select(key, F.struct("step", F.lit(0).alias("stage"), "article", F.lit(0).alias("line"), F.lit(None).alias("place"), F.coalesce("put.action", F.lit("delete")).alias("act"), "said", "claimed", F.col("put.values").alias("values"), none.alias("named")).alias("e"))
    lists = rows.filter("action = 'list'").select(key, F.struct("step", F.lit(1).alias("stage"), "article", "line", "place", F.lit("list").alias("act"), F.lit(False).alias("said"), F.lit(None).cast("array<string>").alias("claimed"), "values", "named").alias("e"))
    return nomenclature.unionByName(lists).groupBy(key).agg(F.sort_array(F.collect_list("e")).alias("events"))


def reformed(base: DataFrame, changes: DataFrame, key: str, fields: Sequence[str], checked: Sequence[str], loose: Sequence[str] = ()) -> Reformed:
    """base: key and fields.  `checked`: fields whose claimed values are held against the record; `loose`: texts that differ in white space
    alone keep the old form.

    Conflicts: `said_missing` and `said_differs` (the change is made all the same), `added_exists` and `listed_missing` (it is not).
    A null key joins with nothing.  The log's values are text, null where there is none; a created or deleted code has one log row with
    the first field's value.
    """
    names, empty_log, empty_conflicts = list(fields), F.array().cast(LOG), F.array().cast(CONFLICT)
    start = base.select(key, F.array(*[F.col(f).cast("string") for f in names]).alias("record"))
    joined = start.join(events(changes, key, names), key, "full_outer")

    def step(s: Column, e: Column) -> Column:
        record, there = s["record"], s["record"].isNotNull()
        at = lambda kind, field, before, after: F.struct(e["step"].alias("step"), e["article"].alias("article"), kind.alias("kind"), field.alias("field"), before.alias("before"), after.alias("after"))
        clash = lambda kind, detail: F.struct(e["step"].alias("step"), e["article"].alias("article"), F.lit(kind).alias("kind"), detail.alias("detail"))
        nothing = F.lit(None).cast("string")
        claims = [F.when(e["said"] & there & e["claimed"][i].isNotNull() & record[i].isNotNull() & (e["claimed"][i] != record[i]), clash("said_differs", F.concat(F.lit(f"{n}: "), e["claimed"][i], F.lit(" / "), record[i]))) for i, n in enumerate(names) if n in checked]
        found = _there(F.array(
            F.when(e["said"] & ~there, clash("said_missing", nothing)), *claims,
            F.when((e["act"] == "add") & there, clash("added_exists", nothing)), F.when((e["act"] == "list") & ~there, clash("listed_missing", nothing)),
        )).cast(CONFLICT)
        new = [
            F.when(e["act"] == "list", F.when(F.array_contains(e["named"], n), e["values"][i]).otherwise(record[i]))
            .when(there & F.lit(n in loose) & (_tight(record[i]) == _tight(e["values"][i])), record[i]).otherwise(e["values"][i])
            for i, n in enumerate(names)
        ]
        writes = F.when(e["act"] == "list", there).when(e["act"] == "add", ~there).otherwise(e["act"] == "set")
        kind = F.when(e["act"] == "list", F.lit("list")).otherwise(F.lit("modify"))
        changed = _there(F.array(*[F.when(writes & there & _differ(record[i], new[i]), at(kind, F.lit(n), record[i], new[i])) for i, n in enumerate(names)]))
        made = F.when(writes & ~there, F.array(at(F.lit("create"), F.lit(""), nothing, new[0]))).when((e["act"] == "delete") & there, F.array(at(F.lit("delete"), F.lit(""), record[0], nothing))).otherwise(F.array()).cast(LOG)
        logged = F.concat(changed.cast(LOG), made)
        after = F.when(e["act"] == "delete", F.lit(None).cast("array<string>")).when(writes, F.array(*new)).otherwise(record)
        last = F.when(F.size(logged) > 0, e["step"]).otherwise(s["step"])
        return F.struct(after.alias("record"), last.alias("step"), F.concat(s["log"], logged).alias("log"), F.concat(s["conflicts"], found).alias("conflicts")).cast(STATE)

    first = F.struct(F.col("record").alias("record"), F.lit(0).alias("step"), empty_log.alias("log"), empty_conflicts.alias("conflicts")).cast(STATE)
    folded = materialized(joined.select(key, F.aggregate(F.coalesce("events", F.array()), first, step).alias("s")), "reformed").select(key, "s.*")
    types = {f.name: f.dataType for f in base.schema}
    state = folded.filter("record IS NOT NULL").select(key, *[F.col("record")[i].cast(types[n]).alias(n) for i, n in enumerate(names)], "step")
    listed = lambda c: folded.select(key, F.posexplode(c).alias("seq", "c")).select(key, "seq", "c.*")
    return Reformed(state, listed("log"), listed("conflicts"))
