"""Frequent and surging problem categories."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numbers import percent
from ..functions.vocabulary import DISPLAY_LABELS


def newest_first_order(df: DataFrame, name: str, time: str = "created_at", key: str = "review_id") -> DataFrame:
    """Adds a column to order by: the newest item first, of equal times the smallest key; no time comes last."""
    # Microseconds as a number: what orders descending becomes one ascending value.
    age = F.coalesce(-F.unix_micros(F.col(time).cast("timestamp")), F.lit((1 << 63) - 1))
    return df.withColumn(name, F.struct(age.alias("age"), F.col(key).alias("key")))


def category_counts(df: DataFrame, order: str = "review_number") -> DataFrame:
    """Items per category and the first position of each, for ties."""
    return df.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first_position")
    )


def distinct_categories(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("category").alias("categories"))


def first_k_examples(
    df: DataFrame, k: int = 3, order: str = "review_number", text: str = "brief_issue"
) -> DataFrame:
    """The first ``k`` texts of each category in item order, with their rank.

    The rank filter lets every task keep only ``k`` rows per category before
    the shuffle, so a category with a third of all rows costs no more.
    """
    rank = F.row_number().over(Window.partitionBy("category").orderBy(order))
    return (
        df.select("category", order, text).withColumn("example_rank", rank)
        .filter(F.col("example_rank") <= k)
    )


def example_lists(df: DataFrame, k: int, name: str, order: str, text: str = "brief_issue") -> DataFrame:
    """One array of the first ``k`` texts per category."""
    items = F.collect_list(F.struct("example_rank", text))
    return (
        first_k_examples(df, k, order, text).groupBy("category")
        .agg(F.transform(F.sort_array(items), lambda item: item[text]).alias(name))
    )


def _items(counts: DataFrame):
    """The sum of ``n`` as a scalar.

    Taking the first position with it keeps the plan below equal to that of
    ``counts`` in use, so both share one scan and one shuffle.
    """
    sums = counts.agg(F.struct(F.sum("n").alias("items"), F.min("first_position").alias("first")))
    return sums.scalar()["items"]


def most_frequent(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest of ``category, n, first_position`` with their percent of all."""
    return (
        counts.orderBy(F.desc("n"), "first_position").limit(n)
        .withColumn("percentage", percent(F.col("n"), _items(counts)))
    )


def _of_categories(df: DataFrame, top: DataFrame, category: str = "category") -> DataFrame:
    # ``top`` was cut by limit, so its size is known before it is broadcast.
    return df.join(F.broadcast(top.select(category)), category, "left_semi")


def top_issues(
    df: DataFrame,
    n: int = 3,
    examples: int = 3,
    order: str = "review_number",
    counts: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` most frequent categories: count, percent of all items, examples.

    ``counts`` spares the count where the caller has it already.
    """
    top = most_frequent(category_counts(df, order) if counts is None else counts, n)
    lists = example_lists(_of_categories(df, top), examples, "examples", order)
    return (
        top.join(lists, "category", "left").orderBy(F.desc("n"), "first_position")
        .select("category", "n", "percentage", "examples")
    )


def period_compare(df: DataFrame, order: str = "review_number") -> DataFrame:
    """Recent and comparison count of every category of the recent period, in one pass."""
    recent = F.col("period") == "recent"
    return (
        df.groupBy("category").agg(
            F.count_if(recent).alias("recent_count"),
            F.count_if(F.col("period") == "comparison").alias("comparison_count"),
            F.min(F.when(recent, F.col(order))).alias("first_position"),
        )
        .filter(F.col("recent_count") > 0)
    )


def recent_counts(compared: DataFrame) -> DataFrame:
    """The recent side of a comparison as ``category, n, first_position``."""
    return compared.select("category", F.col("recent_count").alias("n"), "first_position")


def surging(compared: DataFrame, min_rate: float = 0.2, min_new: int = 5) -> DataFrame:
    """All compared categories that grew by more than ``min_rate``.

    A category without comparison counts if it has ``min_new`` items; its rate
    is infinite. The threshold is applied to the unrounded rate.
    """
    growth = (F.col("recent_count") - F.col("comparison_count")).cast("double")
    rate = F.when(F.col("is_new"), F.lit(float("inf"))).otherwise(
        F.try_divide(growth, F.col("comparison_count"))
    )
    shown = F.when(F.col("is_new"), F.col("_rate")).otherwise(F.bround(F.col("_rate") * 100, 1))
    return (
        compared.withColumn("is_new", F.col("comparison_count") == 0)
        .filter(~F.col("is_new") | (F.col("recent_count") >= min_new))
        .withColumn("_rate", rate)
        .filter(F.col("_rate") > min_rate)
        .withColumn("increase_rate", shown)
        .drop("_rate")
    )


def emerging_issues(
    df: DataFrame,
    n: int = 3,
    min_rate: float = 0.2,
    min_new: int = 5,
    order: str = "review_number",
    compared: DataFrame | None = None,
) -> DataFrame:
    """The ``n`` fastest growing categories, ties by first appearance."""
    compared = period_compare(df, order) if compared is None else compared
    return (
        surging(compared, min_rate, min_new)
        .orderBy(F.desc("increase_rate"), "first_position").limit(n)
        .select("category", "recent_count", "comparison_count", "increase_rate", "is_new")
    )


def issue_brief(
    df: DataFrame,
    n: int = 3,
    examples: int = 3,
    complaints: int = 5,
    order: str = "review_number",
) -> DataFrame:
    """What an action plan is written from: one row per top category of the
    recent period, with examples, complaint texts and its surge, if any.

    Counts of both periods come from one aggregation.
    """
    compared = period_compare(df, order)
    top = most_frequent(recent_counts(compared), n)
    recent = df.filter(F.col("period") == "recent")
    texts = example_lists(_of_categories(recent, top), complaints, "complaints", order)
    surge = emerging_issues(df, compared=compared).select("category", "increase_rate")
    return (
        top.join(texts, "category", "left")
        .join(F.broadcast(surge), "category", "left")
        .withColumn("examples", F.slice("complaints", 1, examples))
        .orderBy(F.desc("n"), "first_position")
        .select("category", "n", "percentage", "examples", "complaints", "increase_rate")
    )


def chart_top(counts: DataFrame, n: int = 5, other: str = "others") -> DataFrame:
    """The ``n`` largest categories; what is left is summed into ``other`` if any.

    ``counts`` has ``category, n, first_position``, one row per category.
    """
    top = counts.orderBy(F.desc("n"), "first_position").limit(n)
    rest = top.agg((_items(counts) - F.sum("n")).alias("n")).filter(F.col("n") > 0)
    top, rest = top.select("category", "n"), rest.select(F.lit(other).alias("category"), "n")
    return top.unionByName(rest)


def label_lookup(
    df: DataFrame,
    labels: Mapping[str, str] | DataFrame = DISPLAY_LABELS,
    key: str = "category",
    name: str = "label",
) -> DataFrame:
    """Adds the display label of a key; unknown keys stay themselves.

    A mapping becomes one literal map, so there is no join at all; a table of
    labels ``(key, label)`` is joined, and the planner sees its size.
    """
    if isinstance(labels, DataFrame):
        dim = labels.select(F.col(labels.columns[0]).alias(key), F.col(labels.columns[1]).alias(name))
        joined = df.join(dim, key, "left")
        return joined.withColumn(name, F.coalesce(F.col(name), F.col(key)))
    pairs = [F.lit(part) for pair in labels.items() for part in pair]
    known = F.try_element_at(F.create_map(*pairs), F.col(key))
    return df.withColumn(name, F.coalesce(known, F.col(key)))
