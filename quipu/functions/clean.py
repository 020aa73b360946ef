"""Cleaners of directory fields: what says nothing becomes null, what has the wrong form too.  All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quipu.functions.text import normal, unaccent

#: Texts that stand for nothing.
NOTHING = ("", "-", ".", "0", "0-", "N/A", "NA", "S/I", "NO INDICA", "NO IND", "NO APLICA", "NINGUNO", "NULL", "NONE")
#: Months by name, words that stay small in a name, words of a search that say nothing of the product, forms of the fields.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
SMALL = ("de", "del", "la", "las", "los", "el", "y", "e", "en", "para", "por", "a")
UNIT_WORDS = (
    "g", "gr", "grs", "gramos", "kg", "kgs", "kilo", "kilos", "ml", "l", "lt", "lts", "litro", "litros", "cc", "cm", "mm", "m", "und", "unid", "unidades", "x", "pack", "oz", "lb", "lbs", "gb", "tb", "mah", "w", "v", "pulgadas",
)
MAIL, PERIOD = r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$", "^(19|20)[0-9]{2}(0[1-9]|1[0-2])$"
LONGEST_URL = 1000


def said(text: Column) -> Column:
    """Blanks collapsed, none before a comma or point; null for what stands for nothing."""
    one = F.trim(F.regexp_replace(text, r"[\s ]+", " "))
    tight = F.regexp_replace(one, " +([,.])", "$1")
    return F.when(~F.upper(tight).isin(*NOTHING), tight)


def mail(text: Column) -> Column:
    found = F.replace(F.lower(said(text)), F.lit(" "), F.lit(""))
    return F.when(found.rlike(MAIL), found)


def phone(text: Column) -> Column:
    """`0414-1234567` of ten digits, or of eleven with the zero before; neither the area nor the number is all zeros."""
    digits = F.regexp_replace(said(text), "[^0-9]", "")
    whole = F.when((F.length(digits) == 10) & ~digits.startswith("0"), F.concat(F.lit("0"), digits)).otherwise(digits)
    fits = whole.rlike("^0[0-9]{10}$") & ~whole.rlike("^0000") & ~whole.rlike("0{7}$")
    return F.when(fits, F.concat(F.substring(whole, 1, 4), F.lit("-"), F.substring(whole, 5, 7)))


def web(text: Column) -> Column:
    found = F.lower(said(text))
    return F.when(F.contains(found, F.lit(".")) & ~found.rlike("[@ ]"), found)


def money(text: Column) -> Column:
    """`$184.930.383,23` as a decimal of two places."""
    figures = F.regexp_replace(text, "[^0-9,.-]", "")
    return F.replace(F.replace(figures, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(20,2)")


def period(text: Column) -> Column:
    found = said(text)
    return F.when(found.rlike(PERIOD), found)


def iso_day(text: Column) -> Column:
    """The day that a text begins with."""
    return F.regexp_extract(said(text), "^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).try_cast("date")


def long_day(text: Column) -> Column:
    """`febrero 27, 2026, 12:00 a. m.` as a date."""
    form = r"^([a-záéíóú]+)\s+([0-9]{1,2}),\s*([0-9]{4})"
    part = lambda i: F.regexp_extract(F.lower(said(text)), form, i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(1))
    return F.when(month > 0, F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(2), 2, "0")).try_cast("date"))


def comparison_key(*parts: Column) -> Column:
    """Capital letters and digits without marks, of all parts together."""
    return F.upper(F.regexp_replace(unaccent(F.concat_ws(" ", *parts)), "[^A-Za-z0-9]", ""))


def company(name: Column) -> Column:
    """A company's name in title case, its legal form as `C.A.`, `S.A.` or `S.R.L.`; small words stay small but at the beginning."""
    capital = F.upper(F.regexp_replace(F.trim(name), r"\s+", " "))
    legal = F.regexp_replace(F.regexp_replace(capital, r"\bS\s*\.?\s*R\s*\.?\s*L\b\.?", "S.R.L."), r"\b([CS])\s*\.?\s*A\b\.?", "$1.A.")
    words = F.split(F.regexp_replace(legal, r"\s+,", ","), " ")
    title = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
    shown = F.transform(words, lambda w, i: F.when(w.rlike(r"^[A-Z](\.[A-Z])+\.?,?$"), w).when((i > 0) & F.lower(w).isin(*SMALL), F.lower(w)).otherwise(title(w)))
    return F.array_join(shown, " ")


def image_url(url: Column, base: Column) -> Column:
    """An address that a page may show: relative ones under the base's host or folder, http as https; null for data, other schemes and long ones."""
    clean = F.regexp_replace(F.trim(url), "&amp;", "&")
    host, folder = F.regexp_extract(base, "^(https?://[^/?#]+)", 1), F.regexp_extract(base, "^(https?://[^?#]*/)", 1)
    rooted = F.when(clean.startswith("//"), F.concat(F.lit("https:"), clean)).when(clean.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), clean).when(clean.startswith("/"), F.concat(host, clean)).otherwise(F.concat(F.when(folder.rlike("^https?://[^/]+/"), folder).otherwise(F.concat(host, F.lit("/"))), clean))
    secure = F.regexp_replace(rooted, "^http://", "https://")
    return F.when((F.length(clean) > 0) & secure.rlike("^https://[^/]") & (F.length(secure) <= LONGEST_URL), secure)


def search_words(query: Column) -> Column:
    """The normalised query without numbers, numbers with a unit and words of units."""
    kept = F.filter(F.split(normal(query), " "), lambda w: (w != "") & ~w.rlike("^[0-9]+[a-z]{0,4}$") & ~w.isin(*UNIT_WORDS))
    return F.array_join(kept, " ")
