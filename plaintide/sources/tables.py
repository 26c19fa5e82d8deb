"""CSV review files, order tables and the common review schema."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.vocabulary import CSV_NULL_TOKENS
from ..operators.filters import drop_null_text
from ..operators.joins import join_reviews_orders
from ..operators.periods import parse_time
from ..operators.positions import synthesize_id_time
from . import csv_splits


def read_csv_text(spark: SparkSession, path: str, position: str | None = None) -> DataFrame:
    """A CSV with header, all columns as text, quoted line breaks kept, a large file read by many tasks.

    ``position`` names a column for the place of each row over all files.
    """
    return csv_splits.read_csv(spark, path, position)


def read_whole_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same rows with one task for each file: for files whose lines end in another way, or too small to cut."""
    return spark.read.csv(
        path, header=True, multiLine=True, escape='"', enforceSchema=False,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def null_if_token(column: Column, tokens: Sequence[str] = CSV_NULL_TOKENS) -> Column:
    return F.when(~column.isin(list(tokens)), column)


def normalize_review_schema(df: DataFrame) -> DataFrame:
    """``Ratings, Reviews`` or ``rating, review_text`` as ``rating, review_text``.

    The first spelling wins if both are there. Only these two columns, and an
    id and a time if present, are kept.
    """
    names = set(df.columns)
    if {"Ratings", "Reviews"} <= names:
        chosen = [F.col("Ratings").alias("rating"), F.col("Reviews").alias("review_text")]
    elif {"rating", "review_text"} <= names:
        chosen = [F.col("rating"), F.col("review_text")]
    else:
        raise ValueError("columns 'Ratings' and 'Reviews', or 'rating' and 'review_text', are required")
    kept = [F.col(name) for name in ("review_id", "created_at") if name in names]
    return df.select(*kept, *chosen)


def read_reviews_csv(
    spark: SparkSession,
    path: str,
    as_of: datetime | str,
    null_tokens: Sequence[str] = CSV_NULL_TOKENS,
) -> DataFrame:
    """Reviews of a CSV with ``Ratings`` and ``Reviews``; all other columns drop.

    Ids count from 1 by place in the file, before rows without text drop out.
    """
    raw = read_csv_text(spark, path, position="_place")
    if not {"Ratings", "Reviews"} <= set(raw.columns):
        raise ValueError("CSV must have 'Ratings' and 'Reviews' columns")
    reviews = raw.select(
        null_if_token(F.col("Ratings"), null_tokens).cast("double").alias("rating"),
        null_if_token(F.col("Reviews"), null_tokens).alias("review_text"),
        "_place",
    )
    return drop_null_text(synthesize_id_time(reviews, as_of, position="_place"))


def read_uploaded_csv(
    spark: SparkSession, path: str, null_tokens: Sequence[str] = CSV_NULL_TOKENS
) -> DataFrame:
    """Ratings and texts of a CSV in either spelling, rows without text included.

    Ratings stay text here: ``filter_negative_truncated`` and the priority
    factors read them as they are.
    """
    reviews = normalize_review_schema(read_csv_text(spark, path))
    return reviews.withColumns({name: null_if_token(F.col(name), null_tokens) for name in reviews.columns})


def read_labeled_csv(
    spark: SparkSession, path: str, null_tokens: Sequence[str] = CSV_NULL_TOKENS
) -> DataFrame:
    """A labeling set that was filled in by hand: text, rating, label and notes."""
    raw = read_csv_text(spark, path)
    missing = sorted({"manual_label", "review_text"} - set(raw.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    labeled = raw.withColumns({name: null_if_token(F.col(name), null_tokens) for name in raw.columns})
    return labeled.withColumn("rating", F.col("rating").cast("double")) if "rating" in raw.columns else labeled


def reviews_with_orders(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    """Order reviews with text and purchase time in the common schema."""
    joined = join_reviews_orders(reviews, orders)
    return drop_null_text(joined.select(
        "review_id",
        F.col("review_comment_message").alias("review_text"),
        F.col("review_score").cast("double").alias("rating"),
        F.col("order_purchase_timestamp").alias("created_at"),
    ))


def read_reviews_with_orders(spark: SparkSession, reviews_path: str, orders_path: str) -> DataFrame:
    """Two CSV files, reviews and orders, as one review table."""
    reviews, orders = read_csv_text(spark, reviews_path), read_csv_text(spark, orders_path)
    cleaned = reviews.withColumn("review_comment_message", null_if_token(F.col("review_comment_message")))
    joined = reviews_with_orders(cleaned, orders)
    return parse_time(joined, "created_at")


def write_csv(df: DataFrame, path: str, byte_order_mark: bool = False) -> str:
    """A folder of CSV files with header that ``read_csv_text`` reads back unchanged.

    Empty strings are quoted, null is nothing. Spreadsheets take a file for
    UTF-8 if it begins with a byte order mark; the readers here skip it.
    """
    if byte_order_mark:
        # The header is what a file begins with, also one without rows.
        df = df.toDF("\ufeff" + df.columns[0], *df.columns[1:])
    df.write.csv(
        path, header=True, escape='"', quote='"', emptyValue='""', nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return path


def write_reviews_csv(df: DataFrame, path: str) -> str:
    """Reviews as ``Ratings, Reviews``."""
    return write_csv(df.select(F.col("rating").alias("Ratings"), F.col("review_text").alias("Reviews")), path)


def write_labeling_csv(sample: DataFrame, path: str, byte_order_mark: bool = True) -> str:
    """A labeling set to be filled in by hand, in a spreadsheet as a rule."""
    return write_csv(sample.select("review_id", "review_text", "rating", "manual_label", "notes"), path, byte_order_mark)
