"""Derived measures with exact half-up rounding.

Averages and ratios are computed on integers (cents, counts) so that the
result does not depend on floating point: for ``b > 0``,
``round_half_up(a / b) = sign(a) * ((2|a| + b) div 2b)``.  Results are
doubles with the requested number of digits.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_up_div(num: Column, den: Column) -> Column:
    """Integer quotient of two bigint columns rounded half away from zero (den > 0)."""
    a = F.abs(num) * 2 + den
    b = den * 2
    # (a - a mod b) is an exact multiple of b, so the decimal quotient is an exact integer
    q = ((a - F.pmod(a, b)).cast("decimal(38,0)") / b.cast("decimal(38,0)")).cast("long")
    return F.when(num < 0, -q).otherwise(q)


def ratio(numerator: Column, denominator: Column, digits: int = 4) -> Column:
    """Share of a count in a total, ``digits`` places; NULL when the total is 0 or NULL.
    A NULL numerator counts as 0."""
    scale = 10 ** digits
    num = F.coalesce(numerator, F.lit(0)).cast("long") * scale
    den = denominator.cast("long")
    return F.when(den != 0, half_up_div(num, den) / float(scale))


def average(total: Column, count: Column, digits: int = 2) -> Column:
    """``total / count`` rounded half up; NULL if the total is NULL or the count 0/NULL.

    ``total`` is a decimal with at most ``digits`` fractional digits (money,
    days) and ``count`` the number of records in the group — records whose
    value is NULL included, so this is not ``avg(col)``.
    """
    scale = 10 ** digits
    units = (total * scale).cast("long")
    den = count.cast("long")
    return F.when(total.isNotNull() & (den != 0), half_up_div(units, den) / float(scale))


def exact_quotient(total: Column, count: Column) -> Column:
    """Unrounded ``total / count`` (decimal), NULL when count is 0 — a sort key."""
    return F.try_divide(total, count)


def as_money(total: Column) -> Column:
    """A 2-digit decimal sum as a double; NULL stays NULL."""
    return total.cast("double")


def as_count(c: Column) -> Column:
    """A count as bigint, NULL as 0."""
    return F.coalesce(c, F.lit(0)).cast("long")
