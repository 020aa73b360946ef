"""Product names told apart into words, sizes and packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quipu.functions import names
from quipu.plans.registry import Registry, read

R = Registry()
case = R.case

_NAMED_SQL = """SELECT p_partkey, p_name || CASE p_partkey % 6 WHEN 0 THEN ' ' || p_size || 'KG' WHEN 1 THEN ' ' || p_size || ',5 l x12' WHEN 2 THEN ' ' || p_size || ' g 2x' || p_size WHEN 3 THEN ' P.A.N. ' || p_size || 'ml ' || p_size || 'cc'
  WHEN 4 THEN ' x ' || p_size || ' tabletas 500mg' ELSE ' Widgets' || p_size END AS name, p_size, p_name FROM part"""


def named(spark, sf):
    p = read(spark, sf, "part")
    n, m = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    tail = F.when(m == 0, F.concat(F.lit(" "), n, F.lit("KG"))).when(m == 1, F.concat(F.lit(" "), n, F.lit(",5 l x12"))).when(m == 2, F.concat(F.lit(" "), n, F.lit(" g 2x"), n))
    tail = tail.when(m == 3, F.concat(F.lit(" P.A.N. "), n, F.lit("ml "), n, F.lit("cc"))).when(m == 4, F.concat(F.lit(" x "), n, F.lit(" tabletas 500mg"))).otherwise(F.concat(F.lit(" Widgets"), n))
    return p.select("p_partkey", F.concat("p_name", tail).alias("name"))


@case(f"""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN (p_size * 1000) || 'g' WHEN 1 THEN array_to_string(list_sort(['12un', (p_size * 1000 + 500) || 'ml']), '+') WHEN 2 THEN array_to_string(list_sort([p_size || 'g', p_size || 'un']), '+') WHEN 3 THEN p_size || 'ml'
  WHEN 4 THEN array_to_string(list_sort([p_size || 'un', '500mg']), '+') ELSE '' END AS pack, CASE p_partkey % 6 WHEN 0 THEN p_size * 1000.0::DOUBLE WHEN 2 THEN p_size * 1.0::DOUBLE END AS grams,
  array_to_string(list_distinct(list_sort(list_concat(list_transform(string_split(lower(p_name), ' '), lambda w: w), CASE p_partkey % 6 WHEN 3 THEN ['pan'] WHEN 5 THEN ['widget'] ELSE [] END))), ' ') AS words FROM ({_NAMED_SQL})""".replace("list_distinct(list_sort(", "list_sort(list_distinct("))
def name_lexemes(spark, sf):
    """Sizes and packs of a name in base units, its net weight, its words."""
    name = F.col("name")
    return named(spark, sf).select("p_partkey", names.pack_key(name).alias("pack"), names.grams(name).cast("double").alias("grams"), F.array_join(F.array_sort(names.name_words(name)), " ").alias("words"))
