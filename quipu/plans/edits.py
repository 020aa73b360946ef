"""Edits and what follows from them: holidays, suspended exemptions, narrowing rules, rebuilt trees, mailbox cursors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quipu.functions import dates as D
from quipu.operators import rules, tree
from quipu.plans.domain import CAL_SQL, OPEN_SQL, working_calendar
from quipu.plans.registry import Registry, read

R = Registry()
case = R.case

_DUE_SQL = "SELECT CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + INTERVAL 14 DAY AS DATE) AS due FROM orders"
_EDITED_SQL = f"SELECT day FROM ({OPEN_SQL}) WHERE day <> DATE '1997-04-15' UNION SELECT day FROM ({CAL_SQL}) WHERE day = DATE '1996-05-24'"


@case(f"WITH old AS ({OPEN_SQL}), new AS ({_EDITED_SQL}), moved AS (SELECT day, (SELECT min(o.day) FROM old o WHERE o.day >= c.day AND o.day <= c.day + 30) AS before, (SELECT min(n.day) FROM new n WHERE n.day >= c.day AND n.day <= c.day + 30) AS after FROM ({CAL_SQL}) c WHERE day BETWEEN DATE '1996-05-01' AND DATE '1997-04-30') SELECT day AS due, before, after, (SELECT count(*) FROM ({_DUE_SQL}) d WHERE d.due = m.day) AS orders FROM moved m WHERE before <> after", dates=("due", "before", "after"))
def holiday_edit(spark, sf):
    """One holiday is put in and one deleted: the days whose next business day moves, and how many orders fall due on each."""
    days, holidays = working_calendar(spark)
    edited = holidays.filter("day <> DATE'1996-05-24'").unionByName(days.filter("day = DATE'1997-04-15'"))
    before, after = (D.next_business_day(days, h).withColumnRenamed("next_day", name) for h, name in ((holidays, "before"), (edited, "after")))
    moved = before.join(after, "day").filter("before <> after AND day BETWEEN DATE'1996-05-01' AND DATE'1997-04-30'")
    due = read(spark, sf, "orders").select(F.date_add(F.add_months(F.trunc("o_orderdate", "month"), 1), 14).alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("orders"))
    return moved.join(due, "day", "left").select(F.col("day").alias("due"), "before", "after", F.coalesce("orders", F.lit(0)).alias("orders"))


@case("SELECT l_orderkey, l_linenumber, CASE WHEN s THEN 'general' ELSE category END AS category, CASE WHEN s THEN 'law-17,decree-1,law-27,' ELSE '' END || base AS legal_base FROM (SELECT *, l_returnflag = 'R' AND category = 'exempt' AND starts_with(base, 'law-18-') AS s FROM (SELECT *, CASE WHEN l_tax < 0.03 THEN 'exempt' ELSE 'reduced' END AS category, CASE WHEN l_linenumber % 2 = 0 THEN 'law-18-' ELSE 'law-19-' END || CAST(l_linenumber AS VARCHAR) AS base FROM lineitem))")
def import_suspension(spark, sf):
    """Exemptions of one article don't hold for imports: the general rate, with the decree's articles before the legal base."""
    l = read(spark, sf, "lineitem")
    base = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "law-18-").otherwise("law-19-"), F.col("l_linenumber").cast("string"))
    lines = l.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "import").otherwise("sale").alias("operation"), F.when(F.col("l_tax") < 0.03, "exempt").otherwise("reduced").alias("was"), base.alias("base"))
    now = lines.withColumn("category", rules.suspended(F.col("was"), F.col("base"), F.col("operation"), "law-18-"))
    bases = rules.suspended_base(F.array("base"), F.col("category") != F.col("was"), ["law-17", "decree-1", "law-27"])
    return now.select("l_orderkey", "l_linenumber", "category", F.array_join(bases, ",").alias("legal_base"))


@case("WITH c AS (SELECT DISTINCT l_orderkey AS item, l_suppkey % 4 AS rule, l_returnflag AS category FROM lineitem), r AS (SELECT l_orderkey AS item, l_suppkey % 4 AS rule, max(l_quantity) AS weight, l_suppkey % 4 = 1 AS evaluates, count(DISTINCT l_returnflag) AS size FROM lineitem GROUP BY ALL), n AS (SELECT item, count(*) AS n FROM r GROUP BY 1), k AS (SELECT item, category FROM c JOIN n USING (item) GROUP BY item, category, n.n HAVING count(*) = n.n), s AS (SELECT item, string_agg(category, ',' ORDER BY category) AS common, count(*) AS size FROM k GROUP BY 1), b AS (SELECT DISTINCT ON (item) item, rule FROM r JOIN s USING (item, size) ORDER BY item, evaluates DESC, weight DESC, rule) SELECT item, n, coalesce(common, '') AS common, CASE WHEN n > 1 THEN b.rule END AS leader FROM n LEFT JOIN s USING (item) LEFT JOIN b USING (item)")
def narrowing_rule(spark, sf):
    """Of the rules that an order's lines name, the categories common to all and the rule that has just these."""
    rule = F.col("l_suppkey") % 4
    answers = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("item"), rule.alias("rule")).agg(F.max("l_quantity").alias("weight"), F.collect_set("l_returnflag").alias("categories"))
    found = rules.narrowing_rule(answers.withColumns({"place": F.col("rule"), "evaluates": F.col("rule") == 1}))
    return found.withColumn("common", F.array_join("common", ","))


_NODES_SQL = "SELECT p_partkey AS seq, lpad(CAST(p_partkey // 50 AS VARCHAR), 10, '0') || lpad(CAST(p_partkey % 50 AS VARCHAR), 2, '0') || '00' AS code, CASE WHEN p_partkey % 50 = 0 THEN 1 WHEN p_partkey % 10 = 0 OR p_partkey % 17 = 0 THEN 2 ELSE 3 END AS level FROM part"


@case(f"WITH e AS (SELECT *, left(code, 10) AS heading, CASE WHEN length(rtrim(code, '0')) >= 10 THEN rtrim(code, '0') ELSE left(code, 10) END AS eff FROM ({_NODES_SQL})), p AS (SELECT DISTINCT ON (c.seq) c.seq, o.code AS parent FROM e c JOIN e o ON o.heading = c.heading AND o.seq < c.seq AND starts_with(c.code, o.eff) AND o.code <> c.code ORDER BY c.seq, length(o.eff) DESC, o.seq), i AS (SELECT DISTINCT ON (c.seq) c.seq, o.code AS by_indent FROM e c JOIN e o ON o.heading = c.heading AND o.seq < c.seq AND o.level < c.level ORDER BY c.seq, o.seq DESC) SELECT seq, code, heading, parent, by_indent, code NOT IN (SELECT parent FROM p) AS terminal, parent IS NOT DISTINCT FROM by_indent AS agrees FROM e LEFT JOIN p USING (seq) LEFT JOIN i USING (seq)")
def rebuilt_tree(spark, sf):
    """Parents of codes by prefix and by indentation, leaves, and where the two disagree."""
    k = F.col("p_partkey")
    code = F.concat(F.lpad(F.floor(k / 50).cast("string"), 10, "0"), F.lpad((k % 50).cast("string"), 2, "0"), F.lit("00"))
    level = F.when(k % 50 == 0, 1).when((k % 10 == 0) | (k % 17 == 0), 2).otherwise(3)
    return tree.code_tree(read(spark, sf, "part").select(k.alias("seq"), code.alias("code"), level.alias("level")), stem=10, levels=3)


@case("WITH m AS (SELECT user_id AS mailbox, event_id AS uid, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_id > CASE WHEN user_id % 3 = 0 THEN 500 ELSE 0 END) SELECT mailbox, count(*) AS taken, min(uid) AS first_uid, max(uid) AS high_water FROM m WHERE n <= 100 GROUP BY 1")
def mailbox_pass(spark, sf):
    """The next messages of each mailbox, at most 100 a pass, beyond its cursor; a cursor of another validity counts from the start."""
    events = read(spark, sf, "events").select(F.col("user_id").alias("mailbox"), F.col("event_id").alias("uid"))
    valid = F.col("mailbox") % 3 == 0  # the others' cursors are of an older validity
    fresh = events.filter(F.col("uid") > F.when(valid, 500).otherwise(0))
    turn = F.row_number().over(Window.partitionBy("mailbox").orderBy("uid"))
    return fresh.withColumn("n", turn).filter("n <= 100").groupBy("mailbox").agg(F.count(F.lit(1)).alias("taken"), F.min("uid").alias("first_uid"), F.max("uid").alias("high_water"))
