"""Recent and comparison period."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F


def split_by_period(
    df: DataFrame,
    recent_days: int = 30,
    comparison_days: int = 60,
    as_of: datetime | str | None = None,
    time: str = "created_at",
) -> DataFrame:
    """Adds ``period``: ``recent`` or ``comparison``; rows of neither drop out.

    Counted back from ``as_of``, or from the newest row of ``df``. A given
    ``as_of`` is a literal and prunes the scan; the newest row is found by a
    scalar subquery over the time column alone. An empty ``df`` gives no rows.
    """
    if as_of is None:
        newest = df.agg(F.max(time)).scalar()
    else:
        newest = F.lit(str(as_of)).cast("timestamp_ntz")
    at = F.col(time)
    recent_start = newest - F.expr(f"INTERVAL {int(recent_days)} DAY")
    comparison_start = newest - F.expr(f"INTERVAL {int(comparison_days)} DAY")
    period = F.when(at >= recent_start, "recent").otherwise("comparison")
    return df.filter(at >= comparison_start).withColumn("period", period)


def parse_time(df: DataFrame, source: str, name: str = "created_at") -> DataFrame:
    """Text to timestamp; unreadable text fails the job."""
    return df.withColumn(name, F.to_timestamp_ntz(source))


def date_range(df: DataFrame, time: str = "created_at") -> DataFrame:
    return df.agg(F.min(time).alias("first_at"), F.max(time).alias("last_at"))
