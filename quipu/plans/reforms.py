"""Reforms of a table by three instruments, with their field log and their conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quipu.operators.reforms import Reformed, reformed
from quipu.plans.registry import Registry, read

R = Registry()
case = R.case

FIELDS = ["name", "size", "brand"]

_ROWS_SQL = """SELECT l_partkey + CASE WHEN l_suppkey % 5 = 0 THEN 1000000 ELSE 0 END AS code, l_linenumber AS step, 1 + l_suppkey % 2 AS article, l_orderkey AS line,
  CASE WHEN l_returnflag = 'R' THEN 'says' WHEN l_returnflag = 'A' THEN 'add' WHEN l_linestatus = 'O' AND l_quantity <= 10 THEN 'list' ELSE 'set' END AS action,
  CASE WHEN l_quantity % 2 = 0 THEN p_name ELSE replace(p_name, ' ', '  ') END AS name, CAST(CASE WHEN l_discount < 0.05 THEN p_size ELSE l_quantity END AS INTEGER) AS size, CASE WHEN l_tax < 0.04 THEN p_brand ELSE 'new' END AS brand
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 3"""


def _steps_sql() -> str:
    """The state after each instrument's article and lists, one CTE after the other: s0 is the base, then articles 1 and 2 and the lists."""
    out = [f"rows AS ({_ROWS_SQL})", "s0 AS (SELECT p_partkey AS code, p_name AS name, CAST(p_size AS VARCHAR) AS size, p_brand AS brand, 0 AS step FROM part)"]
    logs, clashes, n = [], [], 0
    differ = lambda a, b: f"coalesce({a}, '') <> coalesce({b}, '')"
    tight = lambda x: f"regexp_replace({x}, '\\s', '', 'g')"
    for step in (1, 2, 3):
        for article in (1, 2):
            n += 1
            out.append(f"""c{n} AS (SELECT code, bool_or(action = 'says') AS said, arg_min(size, line) FILTER (WHERE action = 'says') AS claim, arg_max(action, line) FILTER (WHERE action <> 'says') AS act,
  arg_max(name, line) FILTER (WHERE action <> 'says') AS name, arg_max(size, line) FILTER (WHERE action <> 'says') AS size, arg_max(brand, line) FILTER (WHERE action <> 'says') AS brand
  FROM (SELECT * REPLACE (CAST(size AS VARCHAR) AS size) FROM rows WHERE step = {step} AND article = {article} AND action <> 'list') GROUP BY code)""")
            out.append(f"""m{n} AS (SELECT coalesce(s.code, c.code) AS code, s.code IS NOT NULL AS there, c.code IS NOT NULL AS hit, coalesce(c.said, false) AS said, c.claim, coalesce(c.act, 'delete') AS act, s.step AS was,
  s.name AS o1, s.size AS o2, s.brand AS o3, CASE WHEN s.code IS NOT NULL AND {tight('s.name')} = {tight('c.name')} THEN s.name ELSE c.name END AS n1, c.size AS n2, c.brand AS n3 FROM s{n - 1} s FULL JOIN c{n} c USING (code))""")
            writes = "hit AND (act = 'set' OR (act = 'add' AND NOT there))"
            changed = f"(NOT there OR {differ('o1', 'n1')} OR {differ('o2', 'n2')} OR {differ('o3', 'n3')})"
            out.append(f"""s{n} AS (SELECT code, CASE WHEN {writes} THEN n1 ELSE o1 END AS name, CASE WHEN {writes} THEN n2 ELSE o2 END AS size, CASE WHEN {writes} THEN n3 ELSE o3 END AS brand, CASE WHEN {writes} AND {changed} THEN {step} ELSE was END AS step
  FROM m{n} WHERE CASE WHEN hit AND act = 'delete' THEN false WHEN hit AND act IN ('set', 'add') THEN true ELSE there END)""")
            for i, f in enumerate(FIELDS, 1):
                logs.append(f"SELECT code, {step} AS step, {article} AS article, 'modify' AS kind, '{f}' AS field, o{i} AS before, n{i} AS after FROM m{n} WHERE {writes} AND there AND {differ(f'o{i}', f'n{i}')}")
            logs.append(f"SELECT code, {step}, {article}, 'create', '', NULL, n1 FROM m{n} WHERE {writes} AND NOT there")
            logs.append(f"SELECT code, {step}, {article}, 'delete', '', o1, NULL FROM m{n} WHERE hit AND act = 'delete' AND there")
            clashes.append(f"SELECT code, {step} AS step, {article} AS article, 'said_missing' AS kind, NULL AS detail FROM m{n} WHERE hit AND said AND NOT there")
            clashes.append(f"SELECT code, {step}, {article}, 'said_differs', 'size: ' || claim || ' / ' || o2 FROM m{n} WHERE hit AND said AND there AND claim <> o2")
            clashes.append(f"SELECT code, {step}, {article}, 'added_exists', NULL FROM m{n} WHERE hit AND act = 'add' AND there")
        n += 1
        out.append(f"""l{n} AS (SELECT code, article, line, CAST(size AS VARCHAR) AS size, lag(CAST(size AS VARCHAR)) OVER w AS last, row_number() OVER w AS nth, row_number() OVER (PARTITION BY code ORDER BY article DESC, line DESC) AS back FROM rows WHERE step = {step} AND action = 'list' WINDOW w AS (PARTITION BY code ORDER BY article, line))""")
        out.append(f"""s{n} AS (SELECT code, name, coalesce(l.size, s.size) AS size, brand, CASE WHEN EXISTS (SELECT 1 FROM l{n} e WHERE e.code = s.code AND {differ('CASE WHEN e.nth = 1 THEN s.size ELSE e.last END', 'e.size')}) THEN {step} ELSE step END AS step FROM s{n - 1} s LEFT JOIN (SELECT code, size FROM l{n} WHERE back = 1) l USING (code))""")
        logs.append(f"SELECT code, {step}, article, 'list', 'size', CASE WHEN nth = 1 THEN s.size ELSE last END, l.size FROM l{n} l JOIN s{n - 1} s USING (code) WHERE {differ('CASE WHEN nth = 1 THEN s.size ELSE last END', 'l.size')}")
        clashes.append(f"SELECT code, {step}, article, 'listed_missing', NULL FROM l{n} ANTI JOIN s{n - 1} USING (code)")
    return f"WITH {', '.join(out)}", f"s{n}", " UNION ALL ".join(logs), " UNION ALL ".join(clashes)


_WITH, _LAST, _LOG, _CLASHES = _steps_sql()


def _reformed(spark, sf) -> Reformed:
    """Order lines as changes: returned ones say what is there, accepted ones add, the rest set all fields or, if small, the size alone.

    An order can name a part twice on one line number; then the row that stands first in the table goes first.
    """
    p = read(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    l = read(spark, sf, "lineitem").withColumn("place", F.struct("_metadata.file_path", "_metadata.row_index")).filter("l_linenumber <= 3").join(p, F.col("l_partkey") == F.col("p_partkey"))
    action = F.when(F.col("l_returnflag") == "R", "says").when(F.col("l_returnflag") == "A", "add").when((F.col("l_linestatus") == "O") & (F.col("l_quantity") <= 10), "list").otherwise("set")
    changes = l.select(
        (F.col("l_partkey") + F.when(F.col("l_suppkey") % 5 == 0, 1_000_000).otherwise(0)).alias("code"), F.col("l_linenumber").alias("step"), (1 + F.col("l_suppkey") % 2).cast("int").alias("article"), F.col("l_orderkey").alias("line"), action.alias("action"),
        F.when(F.col("l_quantity") % 2 == 0, F.col("p_name")).otherwise(F.regexp_replace("p_name", " ", "  ")).alias("name"), F.when(F.col("l_discount") < 0.05, F.col("p_size")).otherwise(F.col("l_quantity").cast("int")).alias("size"),
        F.when(F.col("l_tax") < 0.04, F.col("p_brand")).otherwise(F.lit("new")).alias("brand"), F.array(F.lit("size")).alias("named"), "place",
    )
    base = p.select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    return reformed(base, changes, "code", FIELDS, checked=["size"], loose=["name"])


@case(f"{_WITH} SELECT code, name, CAST(size AS INTEGER) AS size, brand, step FROM {_LAST}")
def reform_state(spark, sf):
    """A table after three instruments."""
    return _reformed(spark, sf).state


@case(f"{_WITH} {_LOG}")
def reform_log(spark, sf):
    """Every field that an instrument changed, with what was there before."""
    return _reformed(spark, sf).log.drop("seq")


@case(f"{_WITH} {_CLASHES}")
def reform_conflicts(spark, sf):
    """Where an instrument speaks of codes that are not there, adds ones that are, or claims another value."""
    return _reformed(spark, sf).conflicts.drop("seq")
