"""Arithmetic on doubles as IEEE 754 has it, where Spark's own would raise, skip nulls or round otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
EPSILON = 2.220446049250313e-16


def div(n: Column, d: Column) -> Column:
    """n / d: a zero denominator gives an infinity, or NaN for 0 / 0."""
    return F.coalesce(F.try_divide(n, d), n * F.pow(d, F.lit(-1.0)))


def largest(*xs: Column) -> Column:
    """The greatest argument; NaN, which sorts last, if any is."""
    return xs[0] if len(xs) == 1 else F.greatest(*xs)


def smallest(*xs: Column) -> Column:
    """The least argument; NaN if any is."""
    return xs[0] if len(xs) == 1 else -F.greatest(*[-x for x in xs])


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def whole(fn, x: Column) -> Column:
    """``fn`` (floor or ceil) as a double; values that it can't change stay."""
    return F.when(is_finite(x) & (F.abs(x) < 2.0**53), fn(x).cast("double")).otherwise(x)


def round_away(x: Column) -> Column:
    """To the nearest whole number, halves away from zero."""
    return F.signum(x) * whole(F.floor, F.abs(x) + 0.5)


def round_to(x: Column, places: int) -> Column:
    """To ``places`` decimals, halves towards plus infinity; for finite values."""
    if places <= 0:
        return F.floor(x + 0.5).cast("double")
    return F.floor((x + EPSILON) * float(10**places) + 0.5).cast("double") / float(10**places)


def modulo(x: Column, y: Column) -> Column:
    """x - y * floor(x / y); x for a zero y."""
    return F.when(y == 0, x).otherwise(x - y * whole(F.floor, div(x, y)))


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| over the greater magnitude; 0 for equal values."""
    return F.when(a == b, 0.0).otherwise(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)))


def coerce(text: Column) -> Column:
    """A string as a number by script-language rules: blank is 0, true 1, false 0, 0x hexadecimal; else NaN."""
    t = F.regexp_replace(text, r"^[\s ﻿]+|[\s ﻿]+$", "")
    decimal = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return (
        F.when(text.isNull(), F.lit(None).cast("double"))
        .when(t == "", 0.0)
        .when(t.isin("true", "false"), (t == "true").cast("double"))
        .when(t.rlike(r"^0[xX][0-9a-fA-F]{1,13}$"), F.conv(F.substring(t, 3, 13), 16, 10).cast("double"))
        .when(t.isin("Infinity", "+Infinity"), F.lit(float("inf")))
        .when(t == "-Infinity", F.lit(float("-inf")))
        .otherwise(F.coalesce(F.when(decimal, t.try_cast("double")), F.lit(float("nan"))))
    )
