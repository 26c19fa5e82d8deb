"""Joins of reviews with other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import ordered_pair


def join_reviews_orders(
    reviews: DataFrame, orders: DataFrame, key: str = "order_id", time: str = "order_purchase_timestamp"
) -> DataFrame:
    """Reviews with the purchase time of their order, null if there is none.

    Only two columns of the order table are read. A large key on the review
    side is split by adaptive skew handling, as this is a left join.
    """
    return reviews.join(orders.select(key, time), key, "left")


def attach_predictions(
    reviews: DataFrame,
    items: DataFrame,
    number: str = "review_number",
    default: str = "other",
) -> DataFrame:
    """Adds ``prediction`` by review number; the last answer per number counts.

    ``items`` has the number, ``item_pos`` and ``category``. Reviews without an
    answer get ``default`` and ``is_matched`` false.
    """
    # An id that is unique by contract still may repeat here: reduce it first.
    last = items.groupBy(number).agg(F.max_by("category", "item_pos").alias("_category"))
    return (
        reviews.join(last, number, "left")
        .withColumns({
            "prediction": F.coalesce(F.col("_category"), F.lit(default)),
            "is_matched": F.col("_category").isNotNull(),
        })
        .drop("_category")
    )


def latest_results(history: DataFrame, kind: str, run: str, run_id: str, values: list[str]) -> DataFrame:
    """The values of the last run per kind; ``run_id`` settles equal times."""
    key = ordered_pair(F.unix_micros(F.col(run).cast("timestamp")), F.col(run_id))
    return history.groupBy(kind).agg(
        F.max(run).alias(run), *[F.max_by(value, key).alias(value) for value in values]
    )
