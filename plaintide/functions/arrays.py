"""Values computed once, and arrays as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column used in several places is copied into each of them whenever a
    filter or a generator above it is pushed down; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def unnest(df: DataFrame, kept: list, array: Column, pos: str, item: str) -> DataFrame:
    """One row per item of ``array`` with its 0-based position.

    A plain explode would make the optimizer test the array in a filter of its
    own, that is compute it twice. The outer form does not.
    """
    rows = df.select(*kept, F.posexplode_outer(array).alias(pos, item))
    return rows.filter(F.col(pos).isNotNull())
