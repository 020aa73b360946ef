"""A lexer for product names: sizes, packs, initials, words and numbers, told apart in one pass over the plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quipu.functions.text import unaccent

#: Units as they are written, by base unit and factor.
MEASURES = {
    ("g", 1000): ("kg", "kilo", "kilos", "kgs", "k"), ("g", 1): ("g", "gr", "grs", "gramos"), ("mg", 1): ("mg",), ("mcg", 1): ("mcg",), ("ml", 1000): ("l", "lt", "lts", "litro", "litros"), ("ml", 1): ("ml", "cc"), ("oz", 1): ("oz",),
    ("un", 1): ("un", "und", "unid", "unidades", "u", "pzas", "piezas", "comp", "comprimidos", "tab", "tabs", "tabletas", "caps", "capsulas"), ("sobre", 1): ("sobre", "sobres"), ("pulg", 1): ("pulg", "pulgadas", '"'),
}
#: Words without weight in a product's name.
EMPTY = ("de", "del", "la", "el", "los", "las", "y", "e", "en", "con", "para", "por", "x", "tipo", "a", "al", "un", "una")
#: Units that keep a number with the letters before it.
TIGHT = ("kg", "g", "gr", "grs", "mg", "ml", "l", "lt", "lts", "cc", "oz", "un", "und")

_BASE = {w: unit for unit, words in MEASURES.items() for w in words}
_either = lambda words: "|".join(sorted(words, key=len, reverse=True))
NUMBER = r"[0-9]+(?:[.,][0-9]+)?"
#: In this order at every place: a pack (`x10`), a size (`1,5 kg`), initials (`P.A.N.`), a word, a number.
PACK = rf"(?<![a-z0-9])x\s*[0-9]{{1,4}}(?![0-9]|[.,][0-9]|\s*(?:{_either(_BASE)})(?![a-z]))"
SIZE = rf"(?<![a-z0-9-]){NUMBER}\s*(?:{_either(_BASE)})(?![a-z])"
LEXEMES = rf"{PACK}|{SIZE}|(?<![a-z0-9])(?:[a-z]\.)+[a-z]?(?![a-z])|[a-z]+|{NUMBER}"


def plain(name: Column) -> Column:
    """Lower case without marks; `2x1` becomes `2 x 1`; letters before a number part from it, unless the number has a unit."""
    text = F.regexp_replace(F.lower(unaccent(name)), r"([0-9])\s*x\s*(?=[0-9])", "$1 x ")
    return F.regexp_replace(text, rf"([a-z])([0-9])(?![0-9.,]*\s*(?:{_either(TIGHT)})(?![a-z0-9]))", "$1 $2")


def lexemes(name: Column) -> Column:
    """(kind, text) in order; kinds: pack, size, initials, word, number.  Null for a null name."""
    found = F.regexp_extract_all(plain(name), F.lit(f"({LEXEMES})"), F.lit(1))
    kind = lambda t: F.when(t.rlike(r"^x\s*[0-9]"), "pack").when(t.rlike(r"^[0-9].*[a-z\"]$"), "size").when(t.rlike(r"^[a-z]\."), "initials").when(t.rlike("^[a-z]"), "word").otherwise("number")
    return F.transform(found, lambda t: F.struct(kind(t).alias("kind"), t.alias("text")))


def _of_kind(name: Column, kind: str) -> Column:
    return F.transform(F.filter(lexemes(name), lambda x: x["kind"] == kind), lambda x: x["text"])


def measures(name: Column) -> Column:
    """(unit, amount) in base units: of each unit the first that is above zero, packs (`x10`) as units after the sizes; sorted by unit."""
    base = F.create_map(*[F.lit(x) for w, (unit, _) in _BASE.items() for x in (w, unit)])
    factor = F.create_map(*[F.lit(x) for w, (_, n) in _BASE.items() for x in (w, n)])

    def size(t: Column) -> Column:
        unit = F.regexp_extract(t, '([a-z"]+)$', 1)
        amount = F.replace(F.regexp_extract(t, f"^({NUMBER})", 1), F.lit(","), F.lit(".")).cast("decimal(15,3)")
        return F.struct(F.try_element_at(base, unit).alias("unit"), (amount * F.try_element_at(factor, unit)).cast("decimal(15,3)").alias("amount"))

    sizes = F.transform(_of_kind(name, "size"), size)
    packs = F.transform(_of_kind(name, "pack"), lambda t: F.struct(F.lit("un").alias("unit"), F.regexp_extract(t, "([0-9]+)$", 1).cast("decimal(15,3)").alias("amount")))
    every = F.filter(F.concat(sizes, packs), lambda m: m["amount"] > 0)
    first = F.filter(every, lambda m, i: F.coalesce(~F.exists(F.slice(every, 1, i), lambda o: o["unit"] == m["unit"]), F.lit(True)))
    return F.array_sort(first)


def shown_amount(amount: Column) -> Column:
    """Without zeros after the point."""
    return F.regexp_replace(F.regexp_replace(amount.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def pack_key(name: Column) -> Column:
    """All measures as one sorted text: `1000g+12un`; empty where there are none."""
    return F.array_join(F.array_sort(F.transform(measures(name), lambda m: F.concat(shown_amount(m["amount"]), m["unit"]))), "+")


def name_words(name: Column) -> Column:
    """Different words of two letters or more without sizes, packs, numbers and empty words, initials joined, plurals as singulars."""
    said = F.transform(F.filter(lexemes(name), lambda x: x["kind"].isin("word", "initials")), lambda x: F.replace(x["text"], F.lit("."), F.lit("")))
    kept = F.filter(said, lambda w: (F.length(w) > 1) & ~w.isin(*EMPTY))
    one = lambda w: F.when(w.rlike("^.{2,}[^s]es$") & (F.length(w) > 4), F.regexp_replace(w, "es$", "")).when(w.rlike("s$") & (F.length(w) > 3), F.regexp_replace(w, "s$", "")).otherwise(w)
    return F.array_distinct(F.transform(kept, one))


def grams(name: Column) -> Column:
    """Net weight in grams of the first weight that is named; null without one, or at zero."""
    found = F.regexp_extract(F.lower(unaccent(name)), r"([0-9]+(?:[.,][0-9]+)?)\s*(kg|kilos?|kilogramos?|g|gr|grs|gramos?)\b", 0)
    amount = F.replace(F.regexp_extract(found, f"^({NUMBER})", 1), F.lit(","), F.lit(".")).try_cast("decimal(15,3)")
    return F.when(amount > 0, (amount * F.when(found.rlike(r"[0-9]\s*k"), 1000).otherwise(1)).cast("decimal(18,3)"))
