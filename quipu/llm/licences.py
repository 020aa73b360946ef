"""Operator 2: licence scan by canonical digest lookup.  DataFrame functions only.

A whole text is normalised (A-Z lowered, copyright clauses and "all rights reserved" dropped, punctuation and white space to single
spaces, equivalent spellings made one) and its SHA-256 is joined to the digests of known licences.  Null texts and texts of which
nothing is left have a null digest and no licence.  Repeated rows each get a row; of licences with one digest the smallest id counts.
Very long texts are normalised whole, as one value.  Empty tables give no rows; without known licences none is found.  Columns but doc_id
and text are not looked at.
"""

from __future__ import annotations

import pkgutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quipu.llm.common import LOWER, UPPER, lower_ascii, read, small

# Spellings that count as one, applied in this order to the lowered text.
EQUIVALENT = [
    ("licence", "license"), ("licencing", "licensing"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("organisation", "organization"),
    ("authoris", "authoriz"), ("recognis", "recogniz"), ("realis", "realiz"), ("utilis", "utiliz"), ("whilst", "while"), ("favour", "favor"), ("honour", "honor"),
    ("behaviour", "behavior"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"),
]
#: A clause with (c), a sign or a year stands anywhere; one of a name alone starts its line and does not go on as prose does.  Each ends with
#: its line or where a licence begins.
_BEGINS = r"\b(permission (is|to)\b|redistribution and\b|(dual[ -])?licensed under\b|released under\b|this (software|work|file|program|library|is)\b|everyone is\b|all\s+rights\s+reserved|the above\b|you may\b|distributed under\b|provided under\b)"
_PROSE = r"(notice|holder|owner|law|licen|statement|disclaim|interest|protect|right|treat|doctrine|infring|permission|message|term|(act|on|in|of|to|is|are|or|and|the|that|for|as|with|under|at|from|does|applies|status|resulting)\b(?! regents))"
COPYRIGHT_CLAUSE = rf"(copyright[ \t]*(\(c\)|©|[0-9]{{4}}|[<\[])|©|\(c\)[ \t]*[0-9]{{4}}|^[^a-z0-9\n]*copyright[ \t]+(by[ \t]+)?(?!{_PROSE})[a-z]).*?(?={_BEGINS}|$)"
#: The form in OP2_SQL: whole lines.  The two differ only on texts with a copyright clause.
COPYRIGHT_LINE = r"^[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|<)|©|\(c\)[ \t]*[0-9]{4})[^\n]*"
RESERVED = r"all\s+rights\s+reserved\.?"
#: ASCII signs and white space, no-break space, angle and curly quotes, dashes, bullets, the ellipsis and the byte order mark.
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{00A0}\x{00AB}\x{00BB}\x{2010}-\x{2027}\x{FEFF}]+"

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_TAIL = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
# Public licence texts and the header that Apache-2.0 asks for.  Callers can pass a table of their own.
KNOWN = [
    ("MIT", f"MIT License\n\n{_GRANT}\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}"),
    ("MIT-0", f"MIT No Attribution\n\n{_GRANT.replace(', subject to the following conditions: ', '.')}\n\n{_AS_IS}"),
    ("ISC", f"ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_TAIL}"),
    ("0BSD", f"Zero-Clause BSD\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC_TAIL}"),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
]


#: Whole texts in licence_texts/, by file name.
TEXTS = "Apache-2.0 Artistic-1.0-Perl BSD-2-Clause BSD-3-Clause-UC CC-BY-SA-4.0 CC0-1.0 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 MPL-1.1 MPL-2.0 Unlicense".split()
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"


def whole_texts() -> list[tuple[str, str]]:
    """Standard licences as whole texts, with and without title line and appendix, items numbered or not."""
    read_text = lambda name: pkgutil.get_data(__package__, f"licence_texts/{name}.txt").decode()
    texts = {name: read_text(name) for name in TEXTS}
    two = texts["BSD-2-Clause"]
    texts["BSD-3-Clause"] = two.replace("THIS SOFTWARE IS PROVIDED", f"{_THIRD}THIS SOFTWARE IS PROVIDED", 1)
    titles = {"BSD-2-Clause": ["", "BSD 2-Clause License\n\n", "The BSD 2-Clause License\n\n", "Simplified BSD License\n\n"], "BSD-3-Clause": ["", "BSD 3-Clause License\n\n", "The BSD 3-Clause License\n\n", "New BSD License\n\n"], "Unlicense": ["", "The Unlicense\n\n"]}
    out = {(name, title + text) for name, text in texts.items() for title in titles.get(name, [""])}
    for mark in ("END OF TERMS AND CONDITIONS", "How to Apply These Terms", "APPENDIX: How to apply", "ADDENDUM: How to use", "For more information, please refer to"):
        out |= {(name, text[: text.index(mark) + end]) for name, text in out if mark in text for end in ((0, len(mark)) if mark.startswith("END") else (0,))}
    out |= {(name, text.split("\n", 1)[1]) for name, text in KNOWN if text.startswith(("MIT ", "ISC ", "Zero-Clause"))}
    out |= {("MIT", "The " + text) for name, text in KNOWN if name == "MIT"} | {("MIT", text.replace("MIT License", "The MIT License (MIT)", 1)) for name, text in KNOWN if name == "MIT"}
    for name, text in list(out):
        if name.startswith("BSD"):
            bare = "\n".join(line.lstrip(" 123.") if line.lstrip()[:2] in ("1.", "2.", "3.") else line for line in text.split("\n"))
            out.add((name, bare))
    return sorted(out)


def normalized(text: Column) -> Column:
    lowered = lower_ascii(text)
    marked = lowered.contains("copyright") | lowered.contains("©") | lowered.contains("(c)")
    out = F.when(marked, F.regexp_replace(lowered, f"(?md){COPYRIGHT_CLAUSE}", "")).otherwise(lowered)
    out = F.trim(F.regexp_replace(F.regexp_replace(out, RESERVED, ""), PUNCTUATION, " "))
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def digest(text: Column) -> Column:
    clean = normalized(text)
    return F.when(clean != "", F.sha2(clean, 256))


def known_licences(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame([*KNOWN, *whole_texts()] if texts is None else texts, "license_id string, text string")


def licence_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per document row: digest of the normalised whole text, and the known licence that has it."""
    digests = known.select(digest(F.col("text")).alias("known_digest"), "license_id").filter("known_digest IS NOT NULL").groupBy("known_digest").agg(F.min("license_id").alias("license_id"))
    scanned = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    joined = scanned.join(small(digests, 10_000), F.col("digest") == F.col("known_digest"), "left")
    return joined.select("doc_id", "digest", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(read(spark, sf_dir, "documents"), known_licences(spark))


def _sql_normalized(text: str) -> str:
    out = rf"trim(regexp_replace(regexp_replace(regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '(?m){COPYRIGHT_LINE}', '', 'g'), '{RESERVED}', '', 'g'), '{PUNCTUATION}', ' ', 'g'), ' ')"
    for a, b in EQUIVALENT:
        out = f"replace({out}, '{a}', '{b}')"
    return out


_SQL_KNOWN = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
OP2_SQL = rf"""
WITH k AS (SELECT sha256(t) AS digest, min(license_id) AS license_id FROM (SELECT license_id, {_sql_normalized("text")} AS t FROM (VALUES {_SQL_KNOWN}) v(license_id, text)) WHERE t <> '' GROUP BY 1),
d AS (SELECT doc_id, CASE WHEN t <> '' THEN sha256(t) END AS digest FROM (SELECT doc_id, {_sql_normalized("text")} AS t FROM documents))
SELECT doc_id, digest, license_id, license_id IS NOT NULL AS is_license FROM d LEFT JOIN k USING (digest)
"""
