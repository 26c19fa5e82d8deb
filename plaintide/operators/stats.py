"""Counts and shares of whole review tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import percent
from ..functions.text import rating_key


def rating_distribution(df: DataFrame, rating: str = "rating", counted: bool = False) -> DataFrame:
    """Reviews per rating, ascending; whole ratings keyed without decimals. ``counted``: see ``review_stats``."""
    rated = df.filter(F.col(rating).isNotNull())
    counts = rated if counted else rating_counts(rated, rating)
    return counts.orderBy(rating).select(rating_key(F.col(rating)).alias("rating_key"), "n")


def rating_counts(df: DataFrame, rating: str = "rating") -> DataFrame:
    """Rows per rating, null included, as ``n``: what the two functions here need of a table."""
    return df.groupBy(rating).agg(F.count(F.lit(1)).alias("n"))


def review_stats(df: DataFrame, threshold: float = 3, rating: str = "rating", counted: bool = False) -> DataFrame:
    """One row: total, negative, their share and the threshold. One scan; ``counted`` says that ``df`` is of ``rating_counts``."""
    if counted:
        total, negative = (F.coalesce(F.sum(n), F.lit(0)) for n in (F.col("n"), F.when(F.col(rating) <= threshold, F.col("n"))))
    else:
        total, negative = F.count(F.lit(1)), F.count_if(F.col(rating) <= threshold)
    return df.agg(
        total.alias("total_reviews"),
        negative.alias("negative_reviews"),
        percent(negative, F.greatest(total, F.lit(1))).alias("negative_ratio"),
        F.lit(threshold).alias("rating_threshold"),
    )


def crawl_summary(reviews: DataFrame, rating: str = "rating", text: str = "review_text") -> DataFrame:
    """One row over all rated rows: count, mean rating, rows with text."""
    return reviews.filter(F.col(rating).isNotNull()).agg(
        F.count(F.lit(1)).alias("total_count"),
        F.coalesce(F.bround(F.avg(rating), 2), F.lit(0.0)).alias("rating_average"),
        F.count(text).alias("text_reviews"),
    )


def category_share_input(
    labeled: DataFrame, reviews: DataFrame, category: str = "category"
) -> DataFrame:
    """Items per category, in percent of the reviews sent in, largest first."""
    sent = reviews.agg(F.count(F.lit(1))).scalar()
    key = F.coalesce(F.nullif(F.col(category), F.lit("")), F.lit("unknown"))
    return (
        labeled.groupBy(key.alias("category")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("percentage", F.coalesce(percent(F.col("n"), sent, 0), F.lit(0.0)))
        .orderBy(F.desc("n"), "category")
    )
