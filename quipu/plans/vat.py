"""The classifier over parts, its answers under two catalogues, and the gate between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quipu.operators.rules import WEIGHTS, broken_cases
from quipu.operators.vat import Catalogue, classified
from quipu.plans.core import CODES_SQL, codes
from quipu.plans.registry import Registry, read

R = Registry()
case = R.case

#: The rules of these queries: priority, name pattern, tag; and their options: category, legal base, condition, field, op, limit.
RULES = {"r1": (10, "ring|gear", "PROMO"), "r2": (20, "red|blue", "ECONOMY"), "r3": (20, "bolt|widget", "MEDIUM"), "r4": (5, "small|large", None), "r5": (1, None, None), "r6": (15, None, None)}
OPTIONS = [
    ("r1", 1, "general", ["law-63"], None, None, None, None), ("r1", 2, "exempt", ["law-18-1"], "small", "size", "<", 20.0), ("r2", 1, "reduced", ["law-64"], None, None, None, None), ("r2", 2, "general", ["law-63", "law-64"], "dear", "price", ">", 1000.0),
    ("r3", 1, "exempt", ["law-18-2"], None, None, None, None), ("r4", 1, "general", ["law-63-4"], "cheap", "price", "<=", 950.0), ("r4", 2, "luxury", ["law-61"], "heavy", "weight", ">=", 10.0), ("r5", 1, "exempt", ["law-18-6"], None, None, None, None),
    ("r6", 1, "reduced", ["law-64-6"], None, None, None, None), ("r6", 2, "exempt", ["law-19"], "few", "size", "<=", 10.0),
]
PREFIXES = [("0000", "r1"), ("0001", "r3"), ("00012", "r6"), ("0018", "r2"), ("000", "r4")]
DECREE = ("law-18-", "1995-01-01", None, ["law-17", "decree-3", "law-63"])


def catalogue(spark) -> Catalogue:
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    decrees = rows([DECREE], "article string, since string, until string, bases array<string>").withColumn("since", F.to_date("since")).withColumn("until", F.to_date("until"))
    return Catalogue(
        rows([(r, q) for r, (q, _, _) in RULES.items()], "rule string, priority int"), tuple((r, p, q) for r, (q, p, _) in RULES.items() if p), rows(PREFIXES, "prefix string, rule string"), rows([("book", "r5")], "kind string, rule string"),
        rows([(t, r, q) for r, (q, _, t) in RULES.items() if t], "tag string, rule string, priority int"), rows(OPTIONS, "rule string, place int, category string, legal_base array<string>, condition string, field string, op string, limit double"), decrees,
    )


def items(spark, sf):
    """Parts as items: a code, a publication or a tag for some, a product's name, the name given; every fourth is an import."""
    k = F.col("p_partkey")
    p = read(spark, sf, "part").join(codes(spark, sf), "p_partkey")
    return p.select(
        k.alias("item"), F.when(k % 3 > 0, F.col("code")).alias("code"), F.when(k % 11 == 0, "book").alias("publication"), F.when(k % 2 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("tags"), F.when(k % 5 == 0, F.concat(F.lit("red "), "p_name")).alias("product"),
        F.when(k % 7 > 0, F.col("p_name")).alias("name"), F.when(k % 4 == 0, "import").otherwise("sale").alias("operation"), F.expr("DATE'1994-12-01' + CAST(p_size AS INT) * 5").alias("day"), F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), "p_retailprice").alias("context"),
    )


def _vat_sql(priorities: dict[str, int]) -> str:
    q = lambda x: "NULL" if x is None else (f"'{x}'" if isinstance(x, str) else str(x))
    values = lambda rows, names: f"(VALUES {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)}) v({names})"
    rules = [(r, priorities.get(r, p), pat, tag) for r, (p, pat, tag) in RULES.items()]
    by_name = lambda c, origin: f"SELECT item, rule, '{origin}' AS origin FROM (SELECT item, rule, rank() OVER (PARTITION BY item ORDER BY priority DESC, strpos({c}, regexp_extract({c}, pattern))) AS n FROM i, r WHERE pattern IS NOT NULL AND regexp_matches({c}, pattern)) WHERE n = 1"
    return f"""i AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 3 > 0 THEN code END AS code, p_partkey % 11 = 0 AS book, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS tag, CASE WHEN p_partkey % 5 = 0 THEN 'red ' || p_name END AS product, CASE WHEN p_partkey % 7 > 0 THEN p_name END AS name,
  p_partkey % 4 = 0 AS import, DATE '1994-12-01' + CAST(p_size * 5 AS INTEGER) AS day, p_size, p_retailprice FROM part JOIN ({CODES_SQL}) USING (p_partkey)),
r AS (SELECT rule, CAST(priority AS INTEGER) AS priority, pattern, tag FROM {values(rules, 'rule, priority, pattern, tag')}),
o AS (SELECT * FROM {values([(r, n, c, ','.join(b), cond, f, op, lim) for r, n, c, b, cond, f, op, lim in OPTIONS], 'rule, oplace, category, base, cond, field, op, lim')}),
sig AS (SELECT item, arg_max(rule, length(prefix)) AS rule, 'code' AS origin FROM i JOIN {values(PREFIXES, 'prefix, rule')} ON starts_with(code, prefix) GROUP BY item UNION ALL SELECT item, 'r5', 'book' FROM i WHERE book
  UNION ALL SELECT item, rule, 'category' FROM (SELECT item, r.rule, rank() OVER (PARTITION BY item ORDER BY priority DESC) AS n FROM i JOIN r USING (tag)) WHERE n = 1 UNION ALL {by_name('product', 'product')} UNION ALL {by_name('name', 'name')}),
w AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY weight DESC, priority DESC, rule) AS place FROM (SELECT item, rule, max(weight) AS weight FROM sig JOIN {values(list(WEIGHTS.items()), 'origin, weight')} USING (origin) GROUP BY item, rule) JOIN (SELECT rule, priority FROM r) USING (rule)),
t AS (SELECT w.item, w.rule, weight, place, oplace, category, string_split(base, ',') AS base, cond, bool_or(op IS NOT NULL) OVER (PARTITION BY w.item, w.rule) AS evaluates, import, day,
  CASE WHEN op IS NULL THEN NULL WHEN field = 'weight' THEN NULL WHEN op = '<' THEN x < lim WHEN op = '<=' THEN x <= lim WHEN op = '>' THEN x > lim END AS holds FROM w JOIN o USING (rule) JOIN i USING (item), LATERAL (SELECT CASE field WHEN 'size' THEN p_size ELSE p_retailprice END AS x)),
v AS (SELECT *, import AND category = 'exempt' AND day >= DATE '1995-01-01' AND len(list_filter(base, lambda b: starts_with(b, 'law-18-'))) > 0 AS gone FROM (SELECT *, bool_or(coalesce(holds, true)) OVER (PARTITION BY item, rule) AS alive FROM t) WHERE coalesce(holds, true) OR NOT alive),
l AS (SELECT item, rule, weight, place, oplace, evaluates, gone, cond, CASE WHEN gone THEN 'general' ELSE category END AS category, CASE WHEN gone THEN list_concat(['law-17', 'decree-3', 'law-63'], base) ELSE base END AS base FROM v),
n AS (SELECT item, count(DISTINCT rule) AS n, max(weight) AS top, string_agg(DISTINCT lpad(CAST(place AS VARCHAR), 3, '0') || rule, ',' ORDER BY lpad(CAST(place AS VARCHAR), 3, '0') || rule) AS rs FROM l GROUP BY item),
cm AS (SELECT item, category FROM l JOIN n USING (item) GROUP BY item, category, n HAVING count(DISTINCT rule) = n), cn AS (SELECT item, count(*) AS k FROM cm GROUP BY item),
ld AS (SELECT DISTINCT ON (item) item, rule FROM (SELECT item, rule, weight, place, evaluates, count(DISTINCT category) AS size FROM l GROUP BY ALL) JOIN cn USING (item) JOIN n USING (item) WHERE size = k AND n > 1 ORDER BY item, evaluates DESC, weight DESC, place),
ch AS (SELECT l.*, CASE WHEN ld.rule IS NOT NULL THEN rs ELSE lpad(CAST(place AS VARCHAR), 3, '0') || l.rule END AS told, row_number() OVER (PARTITION BY l.item, l.category ORDER BY place, oplace) AS nth, ld.rule AS lead, cm.category AS shared, n, k FROM l JOIN n USING (item) LEFT JOIN cn USING (item) LEFT JOIN ld ON ld.item = l.item LEFT JOIN cm ON cm.item = l.item AND cm.category = l.category),
fin AS (SELECT * FROM ch WHERE n = 1 OR k IS NULL OR lead = rule OR (lead IS NULL AND shared IS NOT NULL AND nth = 1)),
mg AS (SELECT item, category, array_to_string(list_sort(list_distinct(flatten(list(base)))), '+') AS base, CASE WHEN count(DISTINCT coalesce(cond, '')) = 1 THEN any_value(cond) END AS cond, array_to_string(list_sort(list_distinct(list_transform(flatten(list(string_split(told, ','))), lambda x: substr(x, 4)))), '+') AS rules FROM fin GROUP BY item, category),
ans AS (SELECT item, count(*) AS m, string_agg(category || ' ' || base || ' ' || coalesce(cond, '-') || ' ' || rules, '; ' ORDER BY category) AS options FROM mg GROUP BY item),
res AS (SELECT i.item, CASE WHEN m IS NULL THEN 'undetermined' WHEN m = 1 THEN 'decided' ELSE 'conditional' END AS state,
  CASE WHEN m IS NULL THEN 0.0::DOUBLE ELSE least(0.99::DOUBLE, floor(CAST(top AS DOUBLE) * CASE WHEN m = 1 THEN 1.0 ELSE 0.8 END::DOUBLE * CASE WHEN n = 1 THEN 1.0 WHEN k > 0 THEN 1.05 ELSE 0.8 END::DOUBLE * 100 + 0.5) / 100) END AS confidence,
  coalesce(n > 1 AND k IS NULL, false) AS conflict, coalesce(s.gone, false) AS suspended, coalesce(options, '') AS options FROM i LEFT JOIN ans USING (item) LEFT JOIN n USING (item) LEFT JOIN cn USING (item) LEFT JOIN (SELECT item, bool_or(gone) AS gone FROM fin GROUP BY item) s USING (item))"""


def shown(found):
    """Options as text, by category, bases and rules sorted."""
    one = lambda o: F.concat_ws(" ", o["category"], F.array_join(F.array_sort(o["legal_base"]), "+"), F.coalesce(o["condition"], F.lit("-")), F.array_join(F.array_sort(o["rules"]), "+"))
    return found.select("item", "state", "confidence", "conflict", "suspended", F.array_join(F.array_sort(F.transform("options", one)), "; ").alias("options"))


@case(f"WITH {_vat_sql({})} SELECT * FROM res")
def vat_classifier(spark, sf):
    """State, confidence and options of every part: five origins of signals, conditions with missing data, a suspended exemption, the leading rule."""
    return shown(classified(items(spark, sf), catalogue(spark)))


@case(f"WITH {_vat_sql({})}, base AS MATERIALIZED (SELECT * FROM res) SELECT b.item, b.state AS expected, e.state AS got FROM base b JOIN ({{edited}}) e USING (item) WHERE (b.state, b.options) <> (e.state, e.options)".replace("{edited}", f"WITH {_vat_sql({'r4': 30})} SELECT * FROM res"))
def rule_gate(spark, sf):
    """Items that the catalogue answers otherwise once rule r4 goes before all others: an edit with any such golden case is rejected."""
    base = catalogue(spark)
    answer = lambda c: shown(classified(items(spark, sf), c)).select("item", "state", "options")
    broken = broken_cases(answer(base), answer(base.with_priority("r4", 30)), "item")
    return broken.select("item", F.get_json_object("expected", "$.state").alias("expected"), F.get_json_object("got", "$.state").alias("got"))
