"""Pages of a list that is stored in its order: any page is one small read.

``paginate`` sorts for every page, and keeps all rows before the page it
gives. Here the list is ranked once, in parallel, and written in files of
consecutive ranks; a page knows from its number which file it is in.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .positions import with_position

ROWS_PER_FILE = 1 << 20


def newest_order(time: str = "created_at", key: str = "review_id") -> dict[str, Column]:
    """The order of ``newest_first``: rows without time last."""
    age = -F.unix_micros(F.col(time).cast("timestamp"))
    return {"_age": F.coalesce(age, F.lit((1 << 63) - 1)), "_key": F.col(key)}


def priority_sorted(time: str = "created_at", key: str = "review_id") -> dict[str, Column]:
    """The order of the priority list: score, then newest, then key."""
    return {"_score": -F.col("score")} | newest_order(time, key)


def store_pages(df: DataFrame, path: str, order: Mapping[str, Column], rows_per_file: int = ROWS_PER_FILE) -> str:
    """Writes ``df`` below ``path`` in the order of ascending ``order``, whose columns together are unique, with its ``rank`` from 0.

    Each file holds ``rows_per_file`` consecutive ranks. An earlier list at
    ``path`` is replaced.
    """
    ranked = with_position(df.withColumns(dict(order)), list(order), "rank").drop(*order)
    parts = ranked.withColumn("part", F.expr(f"rank div {rows_per_file}"))
    parts.repartition("part").sortWithinPartitions("part", "rank").write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    total = df.sparkSession.read.parquet(f"{path}/rows").agg(F.count(F.lit(1)).alias("total"))
    total.withColumn("rows_per_file", F.lit(rows_per_file)).write.mode("overwrite").parquet(f"{path}/list")
    return path


def stored_page(spark: SparkSession, path: str, page: int, page_size: int = 20) -> DataFrame:
    """Rows of one 1-based page, in order, with ``rank``; empty beyond the end.

    Opens the file the page is in, or two if it begins in one and ends in the
    next. A page may have any size.
    """
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    start, end = (page - 1) * page_size, page * page_size - 1
    per_file = spark.read.parquet(f"{path}/list").first()["rows_per_file"]
    parts = list(range(start // per_file, end // per_file + 1))
    rows = spark.read.parquet(f"{path}/rows")
    return rows.filter(F.col("part").isin(parts) & F.col("rank").between(start, end)).drop("part").orderBy("rank")


def stored_totals(spark: SparkSession, path: str, page_size: int = 20) -> DataFrame:
    """One row: ``total`` and ``total_pages``, as of ``page_counts``, without reading the list."""
    total = F.col("total")
    return spark.read.parquet(f"{path}/list").select("total", F.ceil(total / F.lit(page_size)).cast("bigint").alias("total_pages"))
