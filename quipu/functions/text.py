"""Text functions: normalising, trigram similarity, sizes and models in product names, HTML, URLs, mail replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and what they become without their marks.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"
#: Words without weight in product names.
STOPWORDS = ("de", "del", "la", "el", "los", "las", "con", "sin", "y", "en", "para", "por", "the", "of", "and", "a", "un", "una")
#: Pack units, the base unit of each and its factor.
UNITS = {"kg": ("g", 1000), "g": ("g", 1), "gr": ("g", 1), "mg": ("mg", 1), "l": ("ml", 1000), "lt": ("ml", 1000), "ml": ("ml", 1), "cc": ("ml", 1), "un": ("un", 1), "und": ("un", 1)}


def unaccent(text: Column) -> Column:
    """Pure ASCII texts stay as they are, without a look at every letter."""
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.translate(text, MARKED, PLAIN))


def normal(text: Column) -> Column:
    """Lower case without marks, anything else than a-z and 0-9 to single spaces."""
    return F.trim(F.regexp_replace(F.lower(unaccent(text)), "[^a-z0-9]+", " "))


def words(text: Column) -> Column:
    """Different words of the normalised text, in order; none for an empty one."""
    return F.array_distinct(F.array_remove(F.split(normal(text), " "), ""))


def significant_words(text: Column) -> Column:
    """Words without stop words and digits, a plural s taken off words of more than three letters."""
    kept = F.filter(words(text), lambda w: ~w.isin(*STOPWORDS) & ~w.rlike("[0-9]"))
    return F.array_distinct(F.transform(kept, lambda w: F.when(w.rlike("^.{3,}[^s]s$"), F.substring(w, 1, 100).substr(F.lit(1), F.length(w) - 1)).otherwise(w)))


def trigrams(text: Column) -> Column:
    """Different trigrams of each word with two blanks before and one after."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words(text), one)))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of the trigrams; 0 where both are empty."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    either = F.size(x) + F.size(y) - both
    return F.coalesce(F.when(either > 0, both / either), F.lit(0.0))


def coverage(query: Column, text: Column) -> Column:
    """Share of the query's words that the text has; null without words."""
    q = words(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(text))) / F.size(q))


def has_phrase(text: Column, phrase: Column) -> Column:
    """The phrase's words next to each other, as whole words."""
    return F.concat(F.lit(" "), normal(text), F.lit(" ")).contains(F.concat(F.lit(" "), normal(phrase), F.lit(" ")))


def has_term(text: Column, term: str, gap: int = 3) -> Column:
    """A dictionary term as whole words with an optional plural; ` ... ` in it allows up to `gap` words between."""
    parts = [r"\s+".join(f"{w}(?:s|es)?" for w in p.split()) for p in term.split(" ... ")]
    return normal(text).rlike(r"(?<![a-z0-9])" + rf"\s+(?:\S+\s+){{0,{gap}}}".join(parts) + r"(?![a-z0-9])")


def pack_size(name: Column) -> Column:
    """The first measure in base units as `750ml`; null where none is named."""
    clean = F.lower(unaccent(name))
    pattern = r"(?:^|[^a-z0-9.])([0-9]+(?:[.,][0-9]+)?)\s*(kg|gr|g|mg|lt|l|ml|cc|und|un)(?:[^a-z0-9]|$)"
    amount, unit = F.regexp_replace(F.regexp_extract(clean, pattern, 1), ",", "."), F.regexp_extract(clean, pattern, 2)
    base, factor = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v[0])]), F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v[1])])
    value = F.try_element_at(factor, unit) * amount.try_cast("decimal(12,3)")
    return F.when(unit != "", F.concat(value.cast("long").cast("string"), F.try_element_at(base, unit)))


def model_codes(name: Column) -> Column:
    """Words of 6 to 20 characters with at least two letters and two digits; a measure (`1500ml`) is none."""
    measure = lambda w: F.ltrim(w, F.lit("0123456789")).rlike("^[a-z]{1,4}$")
    return F.filter(words(name), lambda w: w.rlike("^[a-z0-9]{6,20}$") & w.rlike("[a-z].*[a-z]") & w.rlike("[0-9].*[0-9]") & ~measure(w))


def without_tags(html: Column) -> Column:
    """One line of text: scripts, styles, comments and tags dropped, the five named entities and blanks decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def truncated(text: Column, most: int) -> Column:
    """Cut at the last blank that leaves 60 % of the length, else hard, with an ellipsis."""
    head = F.substring(text, 1, most - 1)
    last = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (last >= int(0.6 * most)), F.substr(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def canonical_url(url: Column) -> Column:
    """Without fragment and tracking parameters; null for schemes other than http and https."""
    out = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"([?&])(?:(?:utm_[a-z]+|fbclid|gclid)=[^&]*&?)+", "$1")
    return F.when(url.rlike("^https?://"), F.regexp_replace(out, "[?&]+$", ""))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1)), r"^www\.", "")


def host_and_path(url: Column, most: int = 200) -> Column:
    return F.substring(F.concat(host(url), F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)), 1, most)


def own_reply(text: Column) -> Column:
    """A mail's text above the first quoted line (`>` or `… wrote:`)."""
    return F.trim(F.regexp_replace(text, r"(?s)(^|\n)(>|[^\n]*(wrote|escribió):[ ]*\n).*$", ""))


def mail_class(subject_and_text: Column) -> Column:
    low = F.lower(subject_and_text)
    return F.when(low.rlike("mailer-daemon|undeliver"), "bounce").when(low.rlike("out of office|auto-?reply"), "auto").when(low.rlike("unsubscribe|remove me|baja"), "opt_out").otherwise("reply")


def user_agent_family(agent: Column) -> Column:
    """Browser by the first pattern that fits."""
    order = [("bot|crawl|spider", "robot"), ("edg/", "edge"), ("firefox/", "firefox"), ("chrome/", "chrome"), ("safari/", "safari")]
    out = F.when(F.lit(False), F.lit(""))
    for pattern, name in order:
        out = out.when(F.lower(agent).rlike(pattern), name)
    return out.otherwise("other")


def amount(text: Column) -> Column:
    """A price in either decimal convention (`1.234,56` and `1,234.56`) as decimal(18,4); null where there is none."""
    raw = F.regexp_extract(text, r"([0-9][0-9.,]*)", 1)
    european = raw.rlike(r",[0-9]{1,2}$") | raw.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+$")
    return F.when(european, F.translate(F.translate(raw, ".", ""), ",", ".")).otherwise(F.translate(raw, ",", "")).try_cast("decimal(18,4)")
