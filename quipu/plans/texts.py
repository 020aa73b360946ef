"""Text, HTML, URL and mail queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quipu.functions import text as T
from quipu.operators.matching import best_rules
from quipu.plans.registry import Registry, read

R = Registry()
case = R.case


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(lower(translate({x}, '{T.MARKED}', '{T.PLAIN}')), '[^a-z0-9]+', ' ', 'g'))"


def set_sql(x: str) -> str:
    return f"list_distinct(list_filter(string_split({norm_sql(x)}, ' '), lambda w: w <> ''))"


def trigrams_sql(x: str) -> str:
    return f"list_distinct(flatten(list_transform({set_sql(x)}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@case(f"SELECT doc_id, md5({norm_sql('text')}) AS normal_md5, length({norm_sql('text')}) AS n FROM documents")
def norm_text(spark, sf):
    n = T.normal(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.md5(n).alias("normal_md5"), F.length(n).cast("long").alias("n"))


@case(f"SELECT doc_id, CAST(len({set_sql('text')}) AS BIGINT) AS n_words, array_to_string(list_sort({set_sql('text')})[1:3], ' ') AS first_words FROM documents")
def word_tokens(spark, sf):
    w = T.words(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.array_join(F.slice(F.array_sort(w), 1, 3), " ").alias("first_words"))


_A, _B = trigrams_sql("p_name"), trigrams_sql("'small red ring'")


@case(f"SELECT p_partkey, CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))) AS similarity FROM (SELECT p_partkey, {_A} AS a, {_B} AS b FROM part)")
def trigram_similarity(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.similarity(F.col("p_name"), F.lit("small red ring")).alias("similarity"))


@case(f"SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, {_A} AS a, {trigrams_sql(chr(39) + 'ring red' + chr(39))} AS b FROM part WHERE contains(p_name, 'ring') AND contains(p_name, 'red')) ORDER BY CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))) DESC, p_partkey LIMIT 20")
def all_words_search(spark, sf, query="ring red"):
    p = read(spark, sf, "part")
    for w in query.split():
        p = p.filter(F.contains(T.normal(F.col("p_name")), F.lit(w)))
    return p.orderBy(T.similarity(F.col("p_name"), F.lit(query)).desc(), "p_partkey").limit(20).select("p_partkey", "p_name")


@case(f"SELECT doc_id, CAST(len(list_intersect({set_sql('text')}, ['released', 'under', 'the', 'license'])) AS DOUBLE) / 4 AS relevance FROM documents")
def relevance_share(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.coverage(F.lit("Released under the license"), F.col("text")).alias("relevance"))


@case(f"SELECT item_id, CAST(len(list_intersect({set_sql('text')}, ['the', 'of', 'and', 'que', 'und'])) AS DOUBLE) / 5 AS coverage, contains(' ' || {norm_sql('text')} || ' ', ' of the ') AS phrase FROM benchmark")
def text_coverage_score(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", T.coverage(F.lit("the of and que und"), F.col("text")).alias("coverage"), T.has_phrase(F.col("text"), F.lit("of the")).alias("phrase"))


_MEASURED = "p_name || ' ' || p_size || CASE p_partkey % 4 WHEN 0 THEN 'kg' WHEN 1 THEN ' ml' WHEN 2 THEN ' gr' ELSE '' END || ' XK' || p_partkey || 'Z9'"


def _measured():
    unit = F.element_at(F.array(F.lit("kg"), F.lit(" ml"), F.lit(" gr"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), unit, F.lit(" XK"), F.col("p_partkey").cast("string"), F.lit("Z9"))


@case("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN (p_size * 1000) || 'g' WHEN 1 THEN p_size || 'ml' WHEN 2 THEN p_size || 'g' END AS pack FROM part")
def pack_size_extract(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.pack_size(_measured()).alias("pack"))


@case("SELECT p_partkey, CASE WHEN p_partkey >= 10 THEN 'xk' || p_partkey || 'z9' ELSE '' END AS models FROM part")
def model_codes(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.array_join(T.model_codes(_measured()), " ").alias("models"))


@case(r"SELECT doc_id, regexp_matches(n, '(^|[^a-z0-9])(licenses?|licensees)([^a-z0-9]|$)') AS license, regexp_matches(n, '(^|[^a-z0-9])under(s|es)?\s+(\S+\s+){0,3}license(s|es)?([^a-z0-9]|$)') AS under_license FROM (SELECT doc_id, " + norm_sql("text") + " AS n FROM documents)")
def dictionary_match(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.has_term(F.col("text"), "license").alias("license"), T.has_term(F.col("text"), "under ... license").alias("under_license"))


#: Rules of the classification queries: (rule, pattern, priority, percent, category).
RULES = [("r1", "ring|gear", 10, 16, "general"), ("r2", "red", 20, 8, "reduced"), ("r3", "bolt|widget", 20, 0, "exempt"), ("r4", "small", 5, 16, "general")]
RULES_SQL = "(VALUES " + ", ".join(f"('{r}', '{p}', {q}, {pc}, '{c}')" for r, p, q, pc, c in RULES) + ") r(rule, pattern, priority, percent, category)"


@case(f"SELECT p_partkey, rule, priority FROM (SELECT p_partkey, rule, priority, rank() OVER (PARTITION BY p_partkey ORDER BY priority DESC, strpos(p_name, regexp_extract(p_name, pattern))) AS n FROM part, {RULES_SQL} WHERE regexp_matches(p_name, pattern)) WHERE n = 1")
def rule_priority_match(spark, sf):
    items = read(spark, sf, "part").select("p_partkey", "p_name")
    return best_rules(items, "p_partkey", F.col("p_name"), [(r, p, q) for r, p, q, *_ in RULES]).select("p_partkey", "rule", "priority")


def _plain_sql(x: str) -> str:
    out = rf"regexp_replace(regexp_replace({x}, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


@case(f"SELECT page_id, md5({_plain_sql('html')}) AS text_md5, length({_plain_sql('html')}) AS n FROM pages")
def html_to_text(spark, sf):
    t = T.without_tags(F.col("html"))
    return read(spark, sf, "pages").select("page_id", F.md5(t).alias("text_md5"), F.length(t).cast("long").alias("n"))


@case(r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])((utm_[a-z]+|fbclid|gclid)=[^&]*&?)+', '\1', 'g'), '[?&]+$', '') END AS url FROM pages")
def url_canonical(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '')"


@case(rf"SELECT page_id, substr({_HOST} || regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), 1, 200) AS place FROM pages")
def host_path(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.host_and_path(F.col("url")).alias("place"))


@case(rf"SELECT page_id, d AS domain FROM (SELECT page_id, {_HOST} AS h FROM pages), (VALUES ('example.com'), ('example.net'), ('ththre.example.com')) v(d) WHERE h = d OR ends_with(h, '.' || d)")
def join_domain_suffix(spark, sf):
    """A page's host opened into its parent domains: an equi-join with the known domains."""
    parts = F.split(T.host(F.col("url")), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    known = spark.createDataFrame([("example.com",), ("example.net",), ("ththre.example.com",)], "domain string")
    return read(spark, sf, "pages").select("page_id", F.explode(parents).alias("domain")).join(F.broadcast(known), "domain")


_HEAD = "substr(text, 1, 79)"


@case(f"SELECT doc_id, CASE WHEN length(text) <= 80 THEN text WHEN strpos(reverse({_HEAD}), ' ') > 0 AND length({_HEAD}) - strpos(reverse({_HEAD}), ' ') >= 48 THEN substr({_HEAD}, 1, length({_HEAD}) - strpos(reverse({_HEAD}), ' ')) || '…' ELSE {_HEAD} || '…' END AS teaser FROM documents")
def truncate_words(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.truncated(F.col("text"), 80).alias("teaser"))


@case(r"SELECT conv_id, turn, trim(regexp_replace(text, '(?s)(^|\n)(>|[^\n]*(wrote|escribió):[ ]*\n).*$', '')) AS own FROM conversations")
def reply_own_text(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", T.own_reply(F.col("text")).alias("own"))


@case("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'mailer-daemon|undeliver') THEN 'bounce' WHEN regexp_matches(lower(text), 'out of office|auto-?reply') THEN 'auto' WHEN regexp_matches(lower(text), 'unsubscribe|remove me|baja') THEN 'opt_out' ELSE 'reply' END AS kind FROM conversations")
def opt_out_class(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", T.mail_class(F.col("text")).alias("kind"))
