"""Numeric and formatting Column helpers.

Rounding uses the scaled form ``round(x * 10^d) / 10^d``: rounding a double to
zero decimals is the same in Spark and in C-style engines, while Spark's
``round(x, d)`` with d > 0 rounds the decimal text of the double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to(c, digits: int = 2) -> Column:
    scale = float(10 ** digits)
    return F.round(col_(c) * F.lit(scale)) / F.lit(scale)


def round2(c) -> Column:
    return round_to(c, 2)


def safe_ratio(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL (SQL NULLIF semantics)."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


def pct_change(new, old) -> Column:
    """(new - old) / old * 100, 0.0 when old is 0."""
    new, old = col_(new), col_(old)
    return F.when(old != 0, (new - old) / old * F.lit(100.0)).otherwise(F.lit(0.0))


def to_cents(c) -> Column:
    """Money as whole cents, so sums are exact and order independent."""
    return F.round(col_(c) * F.lit(100.0)).cast("bigint")


def cents_to_money(c) -> Column:
    return col_(c).cast("double") / F.lit(100.0)


def _no_negative_zero(c: Column) -> Column:
    return F.when(c == 0, F.lit(0.0)).otherwise(c)


SPLIT = 134217729.0      # 2^27 + 1: cuts a double into two halves of 26 bits


def fmt_fixed(c, digits: int = 1, sign: bool = False) -> Column:
    """Text of a number as Python's '{:.{d}f}' (or '{:+.{d}f}') prints it.

    Python rounds the exact binary value with ties to even: f"{112.35:.1f}" is '112.3', since
    the double lies below 112.35. The JVM formats from the shortest decimal text and gives
    '112.4'. Here v * 10^d is taken exactly, as a product and its rounding error (Dekker), so
    the half is compared with the exact value.
    """
    v = col_(c).cast("double")
    size, ten = F.abs(v), F.lit(10.0 ** digits)
    product = size * ten
    cut = size * F.lit(SPLIT)
    high = cut - (cut - size)
    error = (high * ten - product) + (size - high) * ten
    below = F.floor(product).cast("bigint")
    over_half = (product - below.cast("double") - F.lit(0.5)) + error
    units = below + F.when((over_half > 0) | ((over_half == 0) & (below % 2 == 1)), 1).otherwise(0)
    text = units.cast("string")
    if digits:
        base = 10 ** digits
        text = F.concat(F.floor(units / base).cast("string"), F.lit("."), F.lpad((units % base).cast("string"), digits, "0"))
    mark = F.when(v < 0, "-").otherwise("+" if sign else "")
    return F.when(v.isNotNull() & ~F.isnan(v), F.concat(mark, text))


def fmt_short(c) -> Column:
    """Text of a value already rounded to 2 decimals, as Python prints a float.

    95.71 -> '95.71', 95.7 -> '95.7', 95.0 -> '95.0'.
    """
    return F.regexp_replace(F.format_string("%.2f", _no_negative_zero(col_(c))), "0$", "")
