"""Response priority: which reviews to answer first."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions import scoring
from ..functions.vocabulary import MEDIUM_WORDS, SEVERE_WORDS
from .filters import filter_level, filter_negative_truncated
from .positions import page_counts, paginate

FACTORS = ["rating_score", "length_score", "keyword_score", "recency_score"]


def with_factors(
    df: DataFrame,
    as_of: datetime | str | None = None,
    severe: Sequence[str] = SEVERE_WORDS,
    medium: Sequence[str] = MEDIUM_WORDS,
) -> DataFrame:
    """Adds the four factor columns. Missing columns count as missing values."""
    types = dict(df.dtypes)
    rating = F.col("rating") if "rating" in types else F.lit(None).cast("int")
    text = F.col("review_text") if "review_text" in types else F.lit("")
    created = F.col("created_at") if "created_at" in types else F.lit(None).cast("timestamp_ntz")
    return df.withColumns({
        "rating_score": scoring.rating_factor(rating),
        "length_score": scoring.length_factor(text),
        "keyword_score": scoring.keyword_factor(text, severe, medium),
        "recency_score": scoring.recency_factor(
            created, as_of, is_text=types.get("created_at") == "string"
        ),
    })


def with_priority(
    df: DataFrame,
    as_of: datetime | str | None = None,
    severe: Sequence[str] = SEVERE_WORDS,
    medium: Sequence[str] = MEDIUM_WORDS,
) -> DataFrame:
    """Adds factors, ``score`` (their sum) and ``level``."""
    total = sum((F.col(name) for name in FACTORS[1:]), F.col(FACTORS[0]))
    scored = with_factors(df, as_of, severe, medium).withColumn("score", total)
    return scored.withColumn("level", scoring.level_of(F.col("score")))


def nested_priority(df: DataFrame) -> DataFrame:
    """The flat priority columns as one ``priority`` struct."""
    factors = F.struct(*[F.col(name).alias(name.removesuffix("_score")) for name in FACTORS])
    return df.withColumn("priority", F.struct("score", "level", factors.alias("factors"))).drop(
        *FACTORS, "score", "level"
    )


def priority_order(created: str = "created_at", key: str = "review_id") -> list:
    return [F.desc("score"), F.desc(created), F.col(key)]


def priority_top(scored: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most urgent rows of a scored frame."""
    return scored.orderBy(*priority_order()).limit(n)


def negative_scored(df: DataFrame, threshold: int = 3, **scoring_args) -> DataFrame:
    return with_priority(filter_negative_truncated(df, threshold), **scoring_args)


def priority_page_counts(scored: DataFrame, page_size: int = 20, level: str | None = None) -> DataFrame:
    """One row: rows and pages of the list, of one level if given."""
    return page_counts(filter_level(scored, level), page_size)


def priority_page_after(
    scored: DataFrame, score: int, created, key_value: int, page_size: int = 20, level: str | None = None,
    created_name: str = "created_at", key: str = "review_id",
) -> DataFrame:
    """The page after the row with this score, time and key; no earlier row is sorted. ``created`` may be None."""
    time = F.lit(created).cast("timestamp_ntz")
    column = F.col(created_name).cast("timestamp_ntz")
    if created is None:
        later_time, same_time = F.lit(False), column.isNull()
    else:
        later_time, same_time = F.coalesce(column < time, F.lit(True)), F.coalesce(column == time, F.lit(False))
    after = (F.col("score") < score) | ((F.col("score") == score) & (later_time | (same_time & (F.col(key) > key_value))))
    return filter_level(scored, level).filter(after).orderBy(*priority_order(created_name, key)).limit(page_size)


def paginate_priority(
    scored: DataFrame, page: int, page_size: int = 20, level: str | None = None
) -> DataFrame:
    """One page of scored rows, most urgent first, of one level if given."""
    return paginate(filter_level(scored, level), priority_order(), page, page_size)
