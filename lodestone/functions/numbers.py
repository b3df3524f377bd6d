"""Rounding, number text and lenient numeric reading, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, places: int = 6) -> Column:
    """floor(c * 10^places + 0.5) / 10^places on the binary double: half goes up, also below zero. NaN and infinities stay."""
    f = float(10**places)
    scaled = c.cast("double") * f
    return F.when(F.isnan(scaled) | (F.abs(scaled) > 9.0e15), c.cast("double")).otherwise(F.floor(scaled + 0.5).cast("double") / f)


def number_text(c: Column, places: int = 7) -> Column:
    """A number rounded to ``places`` as the shortest decimal text: no trailing zeros, no exponent, 0 for -0."""
    fixed = F.format_string(f"%.{places}f", round_half_up(c, places))
    # each step is named once: inside a lambda Spark works a repeated one out again
    return F.regexp_replace(F.regexp_replace(fixed, "(\\.\\d*[1-9])0+$|\\.0*$", "$1"), "^-0$", "0")


def lenient_number(c: Column) -> Column:
    """A double from text: blank text is 0, other text that is no number is null, null stays null."""
    t = F.trim(c.cast("string"))
    return F.when(c.isNull(), F.lit(None).cast("double")).when(t == "", F.lit(0.0)).otherwise(t.try_cast("double"))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def approx_equal(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return finite(a) & finite(b) & (F.abs(a - b) <= tolerance)
