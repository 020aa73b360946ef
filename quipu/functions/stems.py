"""Spanish stems by the published Snowball rules, for words whose marks are taken off already."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

#: The endings of the published algorithm that hold no marked letter.
PRONOUNS = ("selas", "selos", "sela", "selo", "las", "les", "los", "nos", "me", "se", "la", "le", "lo")
AFTER = ("iendo", "ando", "ar", "er", "ir")
NOUNS = (
    "anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos",
)
AGENTS = ("adora", "ador", "acion", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias")
Y_VERBS = ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yas", "yes", "yais", "yamos")
E_VERBS = ("en", "es", "emos")
VERBS = (
    "aremos", "eremos", "iremos", "aba", "ada", "ida", "ara", "iera", "ad", "ed", "id", "ase", "iese", "aste", "iste", "an", "aban", "aran", "ieran", "asen", "iesen", "aron", "ieron", "ado", "ido", "ando", "iendo", "ar", "er", "ir",
    "as", "abas", "adas", "idas", "aras", "ieras", "ases", "ieses", "abais", "arais", "ierais", "aseis", "ieseis", "asteis", "isteis", "ados", "idos", "amos", "imos",
)
#: Ending -> what replaces it in the second region, and what may go before it there.
STANDARD = (
    dict.fromkeys(NOUNS, ("", ())) | dict.fromkeys(AGENTS, ("", ("ic",))) | dict.fromkeys(("ucion", "uciones"), ("u", ())) | dict.fromkeys(("encia", "encias"), ("ente", ()))
    | {"mente": ("", ("ante", "able", "ible"))} | dict.fromkeys(("idad", "idades"), ("", ("abil", "ic", "iv"))) | dict.fromkeys(("iva", "ivo", "ivas", "ivos"), ("", ("at",)))
)
_REGION = re.compile(r"[aeiou][^aeiou]")


def _verb_region(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in "aeiou":
        found = re.compile("[aeiou]").search(word, 2)
    elif word[0] in "aeiou":
        found = re.compile("[^aeiou]").search(word, 2)
    else:
        return 3
    return found.end() if found else len(word)


def _longest(word: str, endings: tuple[str, ...]) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _cut(word: str, region: int, endings: tuple[str, ...]) -> str:
    """The word without the longest of the endings, if that lies in the region."""
    e = _longest(word, endings)
    return word[: -len(e)] if e and len(word) - len(e) >= region else word


@functools.lru_cache(200_000)
def stem(word: str) -> str:
    rv = _verb_region(word)
    found = _REGION.search(word)
    r1 = found.end() if found else len(word)
    found = _REGION.search(word, r1)
    r2 = found.end() if found else len(word)

    if pronoun := _longest(word[rv:], PRONOUNS):
        head = word[: -len(pronoun)]
        if _longest(head[rv:], AFTER) or (head[rv:].endswith("yendo") and head.endswith("uyendo")):
            word = head

    before = word
    ending = _longest(word, (*STANDARD, "amente"))
    if ending == "amente":
        if len(word) - 6 >= r1:
            word = word[:-6]
            short = _cut(word, r2, ("iv", "os", "ic", "ad"))
            word = _cut(short, r2, ("at",)) if short != word and word.endswith("iv") else short
    elif ending and len(word) - len(ending) >= r2:
        other, ahead = STANDARD[ending]
        word = _cut(word[: -len(ending)], r2, ahead) + other
    if word == before:
        e = _longest(word[rv:], Y_VERBS)
        if e and word[: -len(e)].endswith("u"):
            word = word[: -len(e)]
        elif e := _longest(word[rv:], (*E_VERBS, *VERBS)):
            word = word[: -len(e)]
            if e in E_VERBS and word.endswith("gu"):
                word = word[:-1]

    e = _longest(word[rv:], ("os", "a", "o", "e"))
    if e:
        word = word[: -len(e)]
        if e == "e" and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word


@arrow_udf(ArrayType(StringType()))
def stems(words: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each different word of a batch is stemmed once; the rest stays in Arrow's buffers, so that a batch makes few Python objects."""
    for part in words:
        coded = part.flatten().dictionary_encode()
        known = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string())
        ends = np.cumsum(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int32)
        yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), known.take(coded.indices), mask=part.is_null())
