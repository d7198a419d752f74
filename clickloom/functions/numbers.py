"""Loose number reading and writing, as web form values need it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_BLANK = r"[ \t\n\r\x0B\x0C]*"

# DECIMAL(10,2) bounds.
MAX_MONEY = "99999999.99"


def number_prefix(c: Column) -> Column:
    """Longest leading number as double, 0.0 when there is none (``12abc`` is 12, ``abc`` is 0)."""
    text = F.regexp_extract(c, rf"\A{_BLANK}({_NUMBER})", 1)
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def is_number(c: Column) -> Column:
    return F.coalesce(c.rlike(rf"\A{_BLANK}{_NUMBER}{_BLANK}\z"), F.lit(False))


def is_int(c: Column, low: int | None = None, high: int | None = None) -> Column:
    """Canonical 64-bit integer text (no plus sign, leading zero or decimals) inside the bounds."""
    value = c.try_cast("bigint")
    ok = c.rlike(r"\A(?:0|-?[1-9][0-9]*)\z") & value.isNotNull()
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return F.coalesce(ok, F.lit(False))


def is_float(c: Column, low: float | None = None, high: float | None = None) -> Column:
    value = number_prefix(c)
    ok = is_number(c)
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return ok


def int_or(c: Column, default: int, low: int | None = None, high: int | None = None) -> Column:
    """The integer when valid, otherwise the default: out-of-range values are not clamped."""
    return F.when(is_int(c, low, high), c.try_cast("bigint")).otherwise(F.lit(default).cast("bigint"))


def float_or(c: Column, default: float, low: float | None = None, high: float | None = None) -> Column:
    return F.when(is_float(c, low, high), number_prefix(c)).otherwise(F.lit(float(default)))


def is_unix_second(c: Column) -> Column:
    return is_int(c, 0, 2147483647)


def money(c: Column) -> Column:
    """DECIMAL(10,2): rounded half up on the shortest decimal text, clamped instead of rejected."""
    bound = F.lit(MAX_MONEY).cast("decimal(10,2)")
    value = c.try_cast("decimal(10,2)")
    over = F.when(c > 0, bound).when(c < 0, -bound)
    return F.coalesce(value, over).cast("decimal(10,2)")


def money_text(c: Column) -> Column:
    """Two decimals, no thousands mark."""
    return c.cast("decimal(30,2)").cast("string")


def float_text(c: Column) -> Column:
    """Shortest text that reads back to the same double: 1, 0.285, 1.0E+25."""
    size = F.abs(c)
    plain = F.regexp_replace(F.regexp_replace(
        c.cast("string").try_cast("decimal(38,21)").cast("string"), r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")
    wide = F.regexp_replace(c.cast("string"), r"E(?=[0-9])", "E+")
    return (
        F.when(c == 0, F.lit("0"))
        .when((size >= 1e-4) & (size < 1e17), plain)
        .otherwise(wide)
    )
