"""Rounding and ordering keys."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part / whole`` in percent, halves to even, null for an empty whole."""
    return F.bround(F.try_divide(part.cast("double"), whole) * 100, digits)


def ordered_pair(major: Column, minor: Column) -> Column:
    """One number that sorts as ``(major, minor)`` for two integers.

    A decimal fits in a hash aggregation buffer where a struct would force a
    sort-based aggregation. Overflow raises, it never wraps.
    """
    wide = major.cast("decimal(19,0)") * F.lit(Decimal(2**64))
    return (wide + minor.cast("decimal(19,0)")).cast("decimal(38,0)")
