"""Numbers: tolerant parsing, finite values, decimal rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities become null (JSON has neither, and they poison averages).
    Written with ``nanvl`` and ``nullif``, which evaluate their argument once."""
    number = F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    return F.nullif(F.nullif(number, F.lit(float("inf"))), F.lit(float("-inf")))


def to_number(text: Column, decimal: str = ".") -> Column:
    """Text to double, anything unreadable or not finite to null."""
    plain = F.trim(text)
    if decimal != ".":
        plain = F.translate(plain, decimal, ".")
    return finite(plain.try_cast("double"))


def half_up(x: Column, digits: int = 2) -> Column:
    """Round half away from zero as a decimal would.

    The inner rounding removes the last-bit noise of a floating sum first, so
    that -10.0149999999999994 counts as the -10.015 it stands for and the
    result does not depend on the order in which partitions were added up.
    """
    return F.round(F.round(x.cast("double"), 10), digits)


def percent(part: Column, total: Column, digits: int = 2) -> Column:
    """100 * part / total, null when the total is zero or null."""
    return half_up(F.lit(100.0) * part / F.when(total != 0, total), digits)


def number_text(x: Column) -> Column:
    """A number as people write it: 90 and not 90.0."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")
