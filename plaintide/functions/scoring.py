"""Response priority of a review from rating, length, words and age."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, functions as F

from .arrays import let
from .vocabulary import MEDIUM_WORDS, SEVERE_WORDS


def rating_factor(rating: Column) -> Column:
    """Up to 40 points. Part stars are cut off; a missing rating counts as 3."""
    stars = F.coalesce(rating.try_cast("double").try_cast("int"), F.lit(3))
    return F.when(stars == 1, 40).when(stars == 2, 25).when(stars == 3, 10).otherwise(0)


def length_factor(text: Column) -> Column:
    """Up to 20 points by number of characters."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n >= 200, 20).when(n >= 100, 12).when(n >= 50, 6).otherwise(2)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda found, word: found | text.contains(word), words, F.lit(False))


def keyword_factor(
    text: Column,
    severe: Sequence[str] = SEVERE_WORDS,
    medium: Sequence[str] = MEDIUM_WORDS,
) -> Column:
    """Up to 25 points by words found in the lower-case text."""

    def points(lower: Column) -> Column:
        severe_points = F.when(contains_any(lower, severe), 25)
        return severe_points.when(contains_any(lower, medium), 15).otherwise(5)

    return let(F.lower(F.coalesce(text, F.lit(""))), points)


def moment(as_of: datetime | str | None) -> Column:
    """A reference time without zone; the clock if none is given."""
    now = F.current_timestamp() if as_of is None else F.lit(str(as_of))
    return now.cast("timestamp_ntz")


def recency_factor(created_at: Column, as_of: datetime | str | None, is_text: bool = False) -> Column:
    """Up to 15 points. Missing or unreadable times give 8, future ones 15."""
    if is_text:
        # A bare year or month is no time here, though the parser would take it.
        has_date = created_at.rlike(r"^\d{4}-\d{2}-\d{2}")
        created_at = F.when(has_date, F.try_to_timestamp(created_at))
    at = created_at.cast("timestamp_ntz")
    now = moment(as_of)
    return (
        F.when(at.isNull(), 8)
        .when(at >= now - F.expr("INTERVAL 1 DAY"), 15)
        .when(at >= now - F.expr("INTERVAL 3 DAY"), 10)
        .when(at >= now - F.expr("INTERVAL 7 DAY"), 5)
        .otherwise(2)
    )


def level_of(score: Column) -> Column:
    return (
        F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 40, "medium")
        .otherwise("low")
    )
