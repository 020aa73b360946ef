"""Exact decimals, currency conversion, invoice amounts, check digits.  All are column expressions inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dec(value: Column, scale: int = 4, precision: int = 18) -> Column:
    return value.cast(f"decimal({precision},{scale})")


def convert(amount: Column, rate_from: Column, rate_to: Column, scale: int = 2) -> Column:
    """amount * rate_from / rate_to, half away from zero; null where a rate is missing or zero."""
    product = dec(amount, 4, 18) * dec(rate_from, 6, 14)
    return F.when(rate_to != 0, F.round(product / dec(rate_to, 4, 12), scale))


def invoice(base: Column, percent: Column) -> list[Column]:
    """Base and tax to cents (tax on the rounded base), and their sum."""
    cents = F.round(base, 2).cast("decimal(18,2)")
    tax = F.round(cents * percent / 100, 2).cast("decimal(18,2)")
    return [cents.alias("base"), tax.alias("tax"), (cents + tax).cast("decimal(18,2)").alias("total")]


def gap_percent(value: Column, reference: Column) -> Column:
    return F.when(reference != 0, (value / reference - 1) * 100)


def plausible(value: Column, reference: Column, low: float = 0.5, high: float = 5.0) -> Column:
    """Within low..high times the reference; null counts as not plausible."""
    return F.coalesce(value.between(reference * low, reference * high), F.lit(False))


def weighted_digits(digits: Column, weights: list[int]) -> Column:
    """Sum of the digits, each times its weight."""
    terms = [F.substring(digits, i, 1).cast("int") * w for i, w in enumerate(weights, 1)]
    return sum(terms[1:], terms[0])


def mod11_digit(kind_value: Column, eight_digits: Column) -> Column:
    """Check digit of a tax id: 4 for the kind, 3 2 7 6 5 4 3 2 for its digits; 11 - rest, two digits count as 0."""
    rest = (4 * kind_value + weighted_digits(eight_digits, [3, 2, 7, 6, 5, 4, 3, 2])) % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


#: Number of each kind of tax id.
TAX_ID_KIND = {"V": 1, "E": 2, "J": 3, "P": 4, "G": 5}


def tax_id(text: Column) -> Column:
    """Struct: canonical id, kind, verified (the kind has a known check digit), valid; kind C counts as valid unverified."""
    clean = F.regexp_replace(F.upper(F.trim(text)), r"[\s.\-]", "")
    formed = F.coalesce(clean.rlike("^[VEJCPG][0-9]{9}$"), F.lit(False))
    kind = F.substring(clean, 1, 1)
    value = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in TAX_ID_KIND.items()])
    right = mod11_digit(value, F.substring(clean, 2, 8)) == F.substring(clean, 10, 1).cast("int")
    verified = formed & value.isNotNull()
    return F.struct(F.when(formed, clean).alias("id"), F.when(formed, kind).alias("kind"), verified.alias("verified"), F.coalesce(F.when(verified, right), formed).alias("valid"))


def gtin_valid(code: Column) -> Column:
    """GS1 mod-10 for 8, 12, 13 or 14 digits; others are false."""
    padded = F.lpad(code, 14, "0")
    right = (10 - weighted_digits(padded, [3, 1] * 6 + [3]) % 10) % 10 == F.substring(padded, 14, 1).cast("int")
    return F.coalesce(F.when(code.rlike("^([0-9]{8}|[0-9]{12,14})$"), right), F.lit(False))


def _mod11_book(code: Column, length: int) -> Column:
    last = F.substring(code, length, 1)
    total = weighted_digits(code, list(range(length, 1, -1))) + F.when(last == "X", 10).otherwise(last.cast("int"))
    return F.coalesce(F.when(code.rlike(f"^[0-9]{{{length - 1}}}[0-9X]$"), total % 11 == 0), F.lit(False))


def isbn10_valid(code: Column) -> Column:
    return _mod11_book(code, 10)


def issn_valid(code: Column) -> Column:
    return _mod11_book(code, 8)


def code_type(code: Column) -> Column:
    """issn, isbn, plu, ean8, upc, ean13, gtin14, internal or sku, the first that fits."""
    c = F.regexp_replace(F.upper(F.trim(code)), r"[\s\-]", "")
    n = F.length(c)
    return (
        F.when(issn_valid(c) & ~gtin_valid(c), "issn").when(isbn10_valid(c), "isbn").when(c.rlike("^97[89][0-9]{10}$") & gtin_valid(c), "isbn")
        .when(c.rlike("^[3489][0-9]{3}$"), "plu").when(c.rlike("^2[0-9]{12}$"), "internal")
        .when(gtin_valid(c), F.when(n == 8, "ean8").when(n == 12, "upc").when(n == 13, "ean13").otherwise("gtin14")).otherwise("sku")
    )
