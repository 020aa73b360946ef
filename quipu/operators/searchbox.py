"""One search box: each query goes to the access paths that its form allows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quipu.functions import numbers as N
from quipu.functions import text as T

#: Forms of the four kinds of queries, blanks, dots and hyphens taken off for the first two; how many hits each path gives.
FORMS = {"tax_id": "(?i)^[VEJPGC][0-9]{9}$", "code": "^[0-9]{4,10}$", "key": "(?i)^(rgl_)?[0-9a-f]{4,8}$"}
MOST = {"rule": 15, "code": 8, "key": 10}
SHORTEST, LONGEST = 4, 10


def routed(queries: DataFrame) -> DataFrame:
    """queries: query_id, q -> (query_id, q, path, term): a row for each path that the query goes to, with what that path is asked.

    A query that is a tax id, a code or a key by its form goes there; every query that is not blank also goes to the rules.
    """
    plain = F.regexp_replace(F.trim("q"), r"[\s.-]", "")
    key = F.lower(F.regexp_replace(F.trim("q"), "(?i)^rgl_", ""))
    ways = F.array(
        F.when(plain.rlike(FORMS["tax_id"]), F.struct(F.lit("tax_id").alias("path"), F.upper(plain).alias("term"))), F.when(plain.rlike(FORMS["code"]), F.struct(F.lit("code").alias("path"), plain.alias("term"))),
        F.when(F.trim("q").rlike(FORMS["key"]), F.struct(F.lit("key").alias("path"), key.alias("term"))), F.when(T.normal(F.col("q")) != "", F.struct(F.lit("rule").alias("path"), T.normal(F.col("q")).alias("term"))),
    )
    return queries.select("query_id", "q", F.explode(F.array_compact(ways)).alias("w")).select("query_id", "q", "w.*")


def _beginning(asked: DataFrame, table: DataFrame, column: str, shortest: int, longest: int) -> DataFrame:
    """(term, row): rows whose column begins with the term, an equi-join on the beginnings that terms can have."""
    cuts = F.transform(F.sequence(F.lit(shortest), F.least(F.lit(longest), F.length(column))), lambda n: F.substr(F.col(column), F.lit(1), n))
    spread = table.filter(F.length(column) >= shortest).select(column, F.explode(cuts).alias("term"))
    return asked.select("term").distinct().join(spread, "term")


def search(queries: DataFrame, codes: DataFrame, keys: DataFrame, rules: DataFrame) -> DataFrame:
    """codes: code; keys: prefix; rules: rule, name -> (query_id, path, place, hit), hits of a path in its order.

    Tax ids are checked by their digit alone; codes begin with the digits, short ones first; keys begin with the letters; rules hold the
    normalised query in `rule name`.  Each path reads its own table only, once for each different term.
    """
    ways = routed(queries)
    of = lambda path: ways.filter(F.col("path") == path)
    tax = of("tax_id").select("query_id", "path", F.lit(1).alias("place"), F.struct(N.tax_id(F.col("term")).alias("t"))["t"].alias("t"))
    tax = tax.select("query_id", "path", "place", F.concat(F.col("t.id"), F.when(F.col("t.valid"), " valid").otherwise(" wrong")).alias("hit"))

    def ranked(found: DataFrame, path: str, hit: str, *order) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("term").orderBy(*order))
        best = found.withColumn("place", place).filter(F.col("place") <= MOST[path]).select("term", "place", F.col(hit).alias("hit"))
        return of(path).join(best, "term").select("query_id", "path", "place", "hit")

    by_code = ranked(_beginning(of("code"), codes, "code", SHORTEST, LONGEST), "code", "code", F.length("code"), "code")
    by_key = ranked(_beginning(of("key"), keys, "prefix", SHORTEST, 8), "key", "prefix", "prefix")
    told = rules.select("rule", T.normal(F.concat_ws(" ", "rule", "name")).alias("told"))
    by_rule = of("rule").select("term").distinct().join(told, F.contains(F.col("told"), F.col("term")))
    return tax.unionByName(by_code).unionByName(by_key).unionByName(ranked(by_rule, "rule", "rule", "rule"))
