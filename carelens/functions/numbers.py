"""Lenient numeric parsing of source text.

``$`` and ``,`` are removed anywhere, then the text must look like a plain or
exponent decimal; anything else (``120 +``, ``inf``, ``12a``) is a parse
failure.  Parsed values are exact decimals, never floats.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from carelens.functions.text import normalize_text, strip, tidy

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
PARSE_TYPE = T.DecimalType(38, 6)


def mark_free(text: Column) -> Column:
    """Currency marks and thousands separators removed, then surrounding space again
    (``"$ 1,000"`` is a number, as the numeric parser of the source system accepts it)."""
    return strip(F.translate(text, ",$", ""))


def numeric_text(c: Column) -> Column:
    """Normalised text with currency marks and thousands separators removed."""
    return mark_free(normalize_text(c))


def parse_numeric_text(text: Column) -> Column:
    """Exact decimal(38,6) value of already-normalised, mark-free text; NULL when it is not a number."""
    return F.when(text.rlike(_NUMBER), text.try_cast(PARSE_TYPE))


def parse_texts(texts: Column) -> Column:
    """Exact decimal(38,6) values of an array of normalised texts, step by step, so no text is freed of marks twice."""
    free = F.transform(texts, lambda t: F.replace(F.replace(t, F.lit(","), F.lit("")), F.lit("$"), F.lit("")))
    bare = F.transform(free, lambda t: F.when(tidy(t), t).otherwise(strip(t)))
    return F.transform(bare, parse_numeric_text)


def parse_number(c: Column) -> Column:
    """Exact decimal(38,6) value of raw text, NULL when it is not a number."""
    return parse_numeric_text(numeric_text(c))


def to_stored(value: Column, target: T.DataType) -> Column:
    """Cast a parsed decimal to its stored type; integers round half away from zero."""
    if isinstance(target, (T.IntegerType, T.LongType, T.ShortType)):
        return F.round(value, 0).try_cast(target)
    return value.try_cast(target)
