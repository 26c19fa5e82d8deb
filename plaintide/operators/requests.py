"""Request tables: the texts a model is to be asked about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .positions import chunk_requests, newest_sample

# How reviews are set in a request.
REVIEW_SEPARATOR = "\n---\n"
REPLY_ENTRY = "\n### 리뷰 %d (평점: %s점)%s\n%s\n"
REPLY_CATEGORY = " [카테고리: %s]"
KNN_HEADER = "Similar examples from past reviews:\n\n"
KNN_EXAMPLE = '%d. Review: "%s..."\n   Category: %s\n\n'
KNN_REVIEW = '\n\nNow, categorize this new review:\n\nReview: "%s"'


def _joined(order: str, text: str, separator: str) -> Column:
    """Texts of a group in order. For groups of a fixed size only."""
    items = F.sort_array(F.collect_list(F.struct(order, text)))
    return F.array_join(F.transform(items, lambda item: item[text]), separator)


def build_category_requests(
    df: DataFrame,
    group: list[str],
    size: int = 200,
    chars: int = 500,
    time: str = "created_at",
    key: str = "review_id",
) -> DataFrame:
    """One request per group over its ``size`` newest reviews, numbered from 1.

    At scale ``group`` names a product and a period; a group's request holds at
    most ``size * chars`` characters whatever the size of the group.
    """
    sample = newest_sample(df.filter(F.col("review_text").isNotNull()), size, group, time, key, "_number")
    line = F.concat_ws(". ", F.col("_number").cast("string"), F.substring("review_text", 1, chars))
    return (
        sample.withColumn("_line", line)
        .groupBy(*group).agg(
            F.count(F.lit(1)).alias("review_count"),
            _joined("_number", "_line", REVIEW_SEPARATOR).alias("request_text"),
        )
    )


def request_numbers(
    df: DataFrame, group: list[str], size: int = 200, time: str = "created_at", key: str = "review_id"
) -> DataFrame:
    """Which review stands under which number in the requests of ``build_category_requests``.

    The same rows in the same order, without the texts: the group, ``review_number`` and the key.
    """
    known = df.filter(F.col("review_text").isNotNull()).select(*group, time, key)
    numbered = newest_sample(known, size, group, time, key, "review_number")
    return numbered.select(*group, F.col("review_number").cast("int").alias("review_number"), key)


def attach_answers(items: DataFrame, numbers: DataFrame, group: list[str]) -> DataFrame:
    """Categorized items of answers, with the key of the review each is about.

    ``items`` as from ``ingest_model_responses`` with the group's columns,
    ``numbers`` as from ``request_numbers``. Items under a number that was not
    asked for, or none, are in ``unknown_answers``; reviews without an item are
    in ``unanswered``.
    """
    return items.join(numbers, [*group, "review_number"])


def unknown_answers(items: DataFrame, numbers: DataFrame, group: list[str]) -> DataFrame:
    """Items that ``attach_answers`` leaves out, with ``reason``: ``no number`` or ``unknown number``."""
    unknown = items.join(numbers.select(*group, "review_number"), [*group, "review_number"], "left_anti")
    reason = F.when(F.col("review_number").isNull(), "no number").otherwise("unknown number")
    return unknown.withColumn("reason", reason)


def unanswered(items: DataFrame, numbers: DataFrame, group: list[str], default: str = "other") -> DataFrame:
    """Numbered reviews that no item is about, with the category that stands for none."""
    asked = numbers.join(items.select(*group, "review_number"), [*group, "review_number"], "left_anti")
    return asked.withColumn("category", F.lit(default))


def build_reply_requests(
    df: DataFrame, key: str = "review_id", size: int = 10, block_width: int | None = None
) -> DataFrame:
    """One request per ``size`` consecutive reviews, with rating and, if present, category."""
    category = F.lit("")
    if "category" in df.columns:
        known = F.col("category").isNotNull() & (F.col("category") != "")
        category = F.when(known, F.format_string(REPLY_CATEGORY, F.col("category"))).otherwise("")
    entry = F.format_string(
        REPLY_ENTRY, F.col("review_index"), F.col("rating").cast("string"), category, F.col("review_text")
    )
    # Only keys are ranked; each text is moved once to its place and once to its request.
    placed = df.join(chunk_requests(df.select(key), key, size, block_width), key)
    return (
        placed.withColumn("_entry", entry)
        .groupBy("batch", "chunk_start").agg(
            F.count(F.lit(1)).alias("review_count"),
            _joined("review_index", "_entry", "").alias("request_text"),
        )
    )


def build_knn_requests(
    reviews: DataFrame, neighbors: DataFrame, examples: DataFrame, chars: int = 150
) -> DataFrame:
    """Per review: its nearest examples with category, then the review.

    ``neighbors`` as from ``knn_retrieve``; ``examples`` has ``neighbor_id,
    example_text``. The example side is cut to ``chars`` before the join.
    """
    short = examples.select("neighbor_id", F.substring("example_text", 1, chars).alias("_short"))
    entry = F.format_string(
        KNN_EXAMPLE, F.col("neighbor_rank"), F.col("_short"), F.col("category").cast("string")
    )
    lists = (
        neighbors.join(short, "neighbor_id").withColumn("_entry", entry)
        .groupBy("review_id").agg(
            F.count(F.lit(1)).alias("example_count"),
            _joined("neighbor_rank", "_entry", "").alias("_examples"),
        )
    )
    head = F.when(F.col("_examples").isNotNull(), F.concat(F.lit(KNN_HEADER), F.col("_examples")))
    return reviews.join(lists, "review_id", "left").select(
        "review_id",
        F.coalesce(F.col("example_count"), F.lit(0)).alias("example_count"),
        F.concat(
            F.coalesce(head, F.lit("")), F.format_string(KNN_REVIEW, F.col("review_text"))
        ).alias("request_text"),
    )
