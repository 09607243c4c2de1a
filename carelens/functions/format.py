"""Display text of report facts (thousands separators, 2 decimals, $, percent, placeholder).

``format_number`` rounds half-even on the double's exact value, the same as
Python's ``format``; ``format_string`` would round half-up.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from carelens.schema import DAYS_UNIT, DISPLAY_MISSING, MONEY_UNITS, NOT_AVAILABLE


def _na(c: Column, text: Column) -> Column:
    return F.when(c.isNull(), F.lit(NOT_AVAILABLE)).otherwise(text)


def count_text(c: Column) -> Column:
    """``1,234``"""
    return _na(c, F.format_number(c.cast("long"), 0))


def decimal_text(c: Column) -> Column:
    """``1,234.57``"""
    return _na(c, F.format_number(c.cast("double"), 2))


def money_text(c: Column) -> Column:
    """``$1,234.57``"""
    return _na(c, F.concat(F.lit("$"), F.format_number(c.cast("double"), 2)))


def percent_text(c: Column) -> Column:
    """``12.34%``; values of at most 1 are shares and are scaled by 100 first."""
    v = c.cast("double")
    scaled = F.when(v <= 1, v * 100).otherwise(v)
    return _na(c, F.concat(F.regexp_replace(F.format_number(scaled, 2), ",", ""), F.lit("%")))


def label_text(c: Column) -> Column:
    """A text value of a present row; NULL prints as ``None``."""
    return F.coalesce(c.cast("string"), F.lit("None"))


# -- dashboard display variants (cards and axis labels) ---------------------

def _fixed2(v: Column) -> Column:
    """Two decimals, no grouping."""
    return F.regexp_replace(F.format_number(v, 2), ",", "")


def display_count(c: Column) -> Column:
    """Grouped integer; a missing count shows as 0."""
    return F.format_number(F.coalesce(c, F.lit(0)).cast("long"), 0)


def display_percent(c: Column) -> Column:
    """Share as ``12.34%``; ``--`` when missing."""
    return F.when(c.isNull(), F.lit(DISPLAY_MISSING)).otherwise(
        F.concat(_fixed2(c.cast("double") * 100), F.lit("%")))


def display_days(c: Column) -> Column:
    """``3.25 天``; ``--`` when missing."""
    return F.when(c.isNull(), F.lit(DISPLAY_MISSING)).otherwise(F.concat(_fixed2(c.cast("double")), F.lit(DAYS_UNIT)))


def display_money(c: Column) -> Column:
    """Large amounts in units of 亿 (1e8) or 万 (1e4) with 2 decimals, smaller ones as a grouped integer."""
    v = c.cast("double")
    out = F.when(c.isNull(), F.lit(DISPLAY_MISSING))
    for size, unit in MONEY_UNITS:
        out = out.when(F.abs(v) >= size, F.concat(_fixed2(v / size), F.lit(unit)))
    return out.otherwise(F.format_number(F.round(v, 0), 0))
