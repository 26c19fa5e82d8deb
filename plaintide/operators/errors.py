"""Where and why predictions go wrong.

Input is a frame of mismatches: ``review_id, review_text, true_label,
predicted_label`` and, if known, ``rating``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import unnest
from ..functions.numbers import ordered_pair
from ..functions.text import length_bucket, rating_key, tokens
from ..functions.vocabulary import STOPWORDS

PAIR = ["true_label", "predicted_label"]


def error_profile(errors: DataFrame) -> DataFrame:
    """Mismatches per pair, length bucket and rating: ``n`` and ``first_id``.

    One pass over the texts. All functions here but the keywords take a profile
    in place of the mismatches and give the same rows.
    """
    bucket = length_bucket(F.col("review_text")).alias("bucket")
    return errors.groupBy(*PAIR, bucket, "rating").agg(F.count(F.lit(1)).alias("n"), F.min("review_id").alias("first_id"))


def _counted(errors: DataFrame) -> bool:
    return "first_id" in errors.columns and "n" in errors.columns


def _n(errors: DataFrame) -> Column:
    return (F.sum("n") if _counted(errors) else F.count(F.lit(1))).alias("n")


def _first(errors: DataFrame) -> Column:
    return F.min("first_id" if _counted(errors) else "review_id").alias("first_id")


def confusion_pairs(errors: DataFrame) -> DataFrame:
    """Errors per directed pair, most frequent first, ties by first appearance."""
    return errors.groupBy(*PAIR).agg(_n(errors), _first(errors)).orderBy(F.desc("n"), "first_id")


def top_pairs(errors: DataFrame, k: int = 5) -> DataFrame:
    return confusion_pairs(errors).limit(k)


def errors_by_length(errors: DataFrame) -> DataFrame:
    bucket = F.col("bucket") if _counted(errors) else length_bucket(F.col("review_text")).alias("bucket")
    return errors.groupBy(bucket).agg(_n(errors))


def errors_by_rating(errors: DataFrame) -> DataFrame:
    """Errors per rating as text; rows without a rating are left out."""
    rated = errors.filter(F.col("rating").isNotNull())
    return (
        rated.groupBy("rating").agg(_n(errors))
        .select(rating_key(F.col("rating")).alias("rating_key"), "n")
    )


def errors_by_true_label(errors: DataFrame, k: int | None = 5) -> DataFrame:
    counts = (
        errors.groupBy("true_label").agg(_n(errors), _first(errors))
        .orderBy(F.desc("n"), "first_id")
    )
    return counts if k is None else counts.limit(k)


def errors_of_top_pairs(errors: DataFrame, pairs: int = 3, profile: DataFrame | None = None) -> DataFrame:
    """The error rows of the most frequent pairs, with the pair's rank."""
    top = top_pairs(errors if profile is None else profile, pairs)
    # ``pairs`` rows only, so one small task ranks them and they can be broadcast.
    ranked = top.withColumn(
        "pair_rank", F.row_number().over(Window.orderBy(F.desc("n"), "first_id"))
    ).select(*PAIR, "pair_rank")
    return errors.join(F.broadcast(ranked), PAIR)


def confusion_keywords(
    errors: DataFrame, pairs: int = 3, k: int = 10, stopwords: Sequence[str] = STOPWORDS, profile: DataFrame | None = None
) -> DataFrame:
    """The ``k`` most frequent words in the texts of each of the top pairs.

    Words are counted per pair before they are ranked, and the counting starts
    before the shuffle, so frequent words cost one row per task. Ties go to
    the word that appears first.
    """
    words = unnest(
        errors_of_top_pairs(errors, pairs, profile), ["pair_rank", *PAIR, "review_id"],
        tokens(F.col("review_text"), stopwords), "pos", "keyword",
    )
    counts = words.groupBy("pair_rank", *PAIR, "keyword").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(ordered_pair(F.col("review_id"), F.col("pos"))).alias("_first"),
    )
    rank = F.row_number().over(Window.partitionBy("pair_rank").orderBy(F.desc("n"), "_first"))
    return (
        counts.withColumn("keyword_rank", rank).filter(F.col("keyword_rank") <= k)
        .select("pair_rank", *PAIR, "keyword_rank", "keyword", "n")
    )


def error_suggestions(
    errors: DataFrame, short_share: float = 0.2, label_share: float = 0.15
) -> DataFrame:
    """Rows of advice: the worst pair, too many very short texts, one bad label.

    Both shares are strict lower bounds on the part of all errors.
    """
    by_length = errors_by_length(errors)
    total = by_length.agg(F.sum("n")).scalar()
    worst = top_pairs(errors, 1).select(
        F.lit("confused_pair").alias("kind"),
        F.concat_ws(" -> ", *PAIR).alias("subject"), "n",
    )
    short = (
        by_length.filter((F.col("bucket") == "very_short") & (F.col("n") > total * short_share))
        .select(F.lit("short_text").alias("kind"), F.col("bucket").alias("subject"), "n")
    )
    label = (
        errors_by_true_label(errors, 1).filter(F.col("n") > total * label_share)
        .select(F.lit("frequent_label").alias("kind"), F.col("true_label").alias("subject"), "n")
    )
    return worst.unionByName(short).unionByName(label)
