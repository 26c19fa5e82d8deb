"""Counts per day and category, kept as a table, and periods added up from them.

A comparison of two periods over all reviews reads all reviews. Here each day
is counted once: a new or corrected day replaces its own partition, and a
comparison reads one small row for each day and category. Where a period does
not begin at midnight, the rows of its first day, and of no other, are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from .periods import split_by_period

_SCHEMA = "category string, n bigint, first_position bigint, last_at timestamp_ntz, day date"


def _on_days(items: DataFrame, days: Sequence[date], time: str) -> DataFrame:
    """The items of these days, by bounds on the time itself, which reach the scan."""
    wanted = F.lit(False)
    for day in days:
        start = F.lit(str(day)).cast("timestamp_ntz")
        wanted = wanted | ((F.col(time) >= start) & (F.col(time) < start + F.expr("INTERVAL 1 DAY")))
    return items.filter(wanted)


def store_days(
    items: DataFrame, path: str, days: Sequence[date] | None = None, time: str = "created_at", order: str = "review_number"
) -> str:
    """Counts ``items`` (``category``, ``time``, ``order``) by day below ``path``; each day written takes the place of what was there.

    With ``days`` only these are read and replaced, also by nothing if they have
    no items any more; without, all days that ``items`` has. Writing a day twice
    changes nothing. Items without time belong to no period and are not counted.
    """
    chosen = items if days is None else _on_days(items, days, time)
    counts = chosen.filter(F.col(time).isNotNull()).groupBy(F.to_date(time).alias("day"), "category").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col(order).cast("bigint")).alias("first_position"),
        F.max(F.col(time).cast("timestamp_ntz")).alias("last_at"))
    if days is not None:
        # A day without items keeps a row that counts nothing, so that its old rows go.
        empty = items.sparkSession.createDataFrame([(day,) for day in days], "day date")
        counts = counts.unionByName(empty.selectExpr(
            "day", "string(null) AS category", "0L AS n", "bigint(null) AS first_position", "CAST(null AS timestamp_ntz) AS last_at"))
    counts.select("category", "n", "first_position", "last_at", "day").repartition("day") \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return path


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(path).filter("n > 0")


def stored_period_compare(
    spark: SparkSession,
    path: str,
    as_of: datetime | str | None = None,
    recent_days: int = 30,
    comparison_days: int = 60,
    items: DataFrame | None = None,
    time: str = "created_at",
    order: str = "review_number",
) -> DataFrame:
    """The rows of ``period_compare`` for the periods of ``split_by_period``, from the stored days.

    ``as_of`` is the newest stored time if it is not given. If it is not
    midnight, ``items`` has to be given: of the two days on which a period
    begins, the items are read and told apart by their time.
    """
    days = read_days(spark, path)
    if as_of is None:
        as_of = days.agg(F.max("last_at")).first()[0]
        if as_of is None:
            return days.selectExpr("category", "n AS recent_count", "n AS comparison_count", "first_position")
    now = datetime.fromisoformat(str(as_of))
    recent, comparison = now - timedelta(days=recent_days), now - timedelta(days=comparison_days)
    whole = now.time() == datetime.min.time()
    if not whole and items is None:
        raise ValueError("the periods begin within a day: give the items of that day")
    # Whole days only: those on which a period begins within the day are left out.
    first = comparison.date() if whole else comparison.date() + timedelta(days=1)
    counted = days.filter(F.col("day") >= F.lit(first))
    if not whole:
        counted = counted.filter(F.col("day") != F.lit(recent.date()))
    parts = counted.select("category", F.when(F.col("day") >= F.lit(recent.date()), "recent").otherwise("comparison").alias("period"), "n", "first_position")
    if not whole:
        begun = _on_days(items, sorted({recent.date(), comparison.date()}), time)
        split = split_by_period(begun, recent_days, comparison_days, now, time)
        parts = parts.unionByName(split.groupBy("category", "period").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.col(order).cast("bigint")).alias("first_position")))
    is_recent = F.col("period") == "recent"
    number = lambda period: F.coalesce(F.sum(F.when(F.col("period") == period, F.col("n"))), F.lit(0))
    return parts.groupBy("category").agg(
        number("recent").alias("recent_count"), number("comparison").alias("comparison_count"),
        F.min(F.when(is_recent, F.col("first_position"))).alias("first_position")).filter("recent_count > 0")
