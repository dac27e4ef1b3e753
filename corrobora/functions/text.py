"""Canonical forms of text and number values, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Spellings of "no value", and the characters that count as space or as part of a word.
NO_VALUE = "nan|none|null"
SPACE = r"\t-\r\x1c-\x1f\x20\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"


def nfkc(col: Column) -> Column:
    """Unicode compatibility composition, on the JVM; plain ASCII is already composed."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), col, F.lit(True))
    return F.when(col.rlike(r"[^\x00-\x7F]"), composed).otherwise(col)


def _has_value(text: Column) -> Column:
    return ~text.rlike(rf"(?i)\A[{SPACE}]*(?:{NO_VALUE})?[{SPACE}]*\z")


def norm_text(col: Column) -> Column:
    """Compatibility-composed, lower-cased words, one space apart; null if nothing is left.

    Punctuation, symbols and combining marks separate words.
    """
    text = col.cast("string")
    words = F.trim(F.regexp_replace(F.lower(nfkc(text)), rf"[^{WORD}]+", " "))
    return F.when(_has_value(text), F.nullif(words, F.lit("")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _two_decimals(x: Column, sign: Column) -> Column:
    """Non-negative double below 2**62 with two decimals, half-even on its exact binary value.

    The fraction is split into two parts of at most 27 bits, whose products with
    100 are exact, so the side of the half can be told exactly.
    """
    def rounded(frac: Column) -> Column:
        def halves(high: Column) -> Column:
            cents = F.floor(frac * 100.0)
            beyond = (high * 100.0 - (cents + 0.5)) + (frac - high) * 100.0
            return cents + F.when((beyond > 0) | ((beyond == 0) & (cents % 2 == 1)), 1).otherwise(0)

        return _let(frac * 134217729.0 - (frac * 134217729.0 - frac), halves)

    def shown(cents: Column) -> Column:
        whole = (F.floor(x) + F.floor(cents / 100)).cast("string")
        return F.concat(sign, whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))

    return _let(_let(x - F.floor(x), rounded), shown)


def norm_number(col: Column) -> Column:
    """First number in the text with two decimals, or null; a comma is a decimal mark."""
    text = F.regexp_replace(col.cast("string"), ",", ".")

    def formatted(found: Column) -> Column:
        sign = F.when(found.startswith("-"), "-").otherwise("")

        def shown(x: Column) -> Column:
            # From 2**62 on doubles are whole numbers, too large for long arithmetic.
            return F.when(x < 2.0**62, _two_decimals(x, sign)).otherwise(F.concat(sign, F.format_string("%.2f", x)))

        return F.when(found != "", _let(F.abs(found.try_cast("double")), shown))

    return _let(F.regexp_extract(text, NUMBER, 0), formatted)
