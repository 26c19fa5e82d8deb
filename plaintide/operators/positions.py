"""Exact row positions, chunks and pages without a whole-table window."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampNTZType, TimestampType

from ..functions.arrays import let

ROWS_PER_BLOCK = 1 << 18
WIDE_ROWS_PER_BLOCK = 1 << 13  # of rows with texts or arrays, of which a range meets in one task
FIXED_WIDTH = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)
MOST_BLOCKS = 4096
SAMPLED = 32  # rows for each range
GROUP_LIMIT = 1000  # default of spark.sql.optimizer.windowGroupLimitThreshold
SLICES = 64


def splitters(
    df: DataFrame, keys: Sequence[str], rows_per_block: int = ROWS_PER_BLOCK, most_blocks: int = MOST_BLOCKS
) -> list[Row]:
    """Values of ``keys`` that cut ``df`` in ranges of about ``rows_per_block`` rows.

    They come from a sample of ``SAMPLED`` rows for each range, so the driver
    gets at most ``SAMPLED * most_blocks`` keys whatever the table holds. What
    the sample hits decides how even the ranges are, nothing else. A table of
    up to ``rows_per_block`` rows needs none.
    """
    rows = df.count()
    blocks = min(most_blocks, -(-rows // rows_per_block))
    if blocks < 2:
        return []
    sample = df.select(*keys).sample(min(1.0, SAMPLED * blocks / rows), seed=SAMPLED).orderBy(*keys).collect()
    return list(dict.fromkeys(sample[i * len(sample) // blocks] for i in range(1, blocks) if sample))


def block_of(df: DataFrame, keys: Sequence[str], cuts: Sequence[Row]) -> Column:
    """How many of the sorted ``cuts`` are not after the row: the number of its range, found by halving."""
    types = [df.schema[key].dataType for key in keys]
    known = F.array(*[F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, cut, types)]) for cut in cuts])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])

    def search(key: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            (at + step <= len(cuts)) & (F.get(known, at + step - 1) <= key), at + step).otherwise(at))

    return let(F.struct(*keys), search)


def with_position(
    df: DataFrame,
    key: str | Sequence[str],
    name: str = "position",
    block_width: int | None = None,
    group: Sequence[str] = (),
    rows_per_block: int | None = None,
) -> DataFrame:
    """0-based rank of each row by ``key``, or of each row in its ``group``.

    The table is cut in ranges of the key at sampled splitters. Rows are ranked
    inside their range and shifted by the rows of all earlier ranges, of which
    only one count for each range (and group) is brought together. So any key
    that can be ordered will do, random 64-bit numbers and texts too, and a
    group with a third of all rows is ranked in as many tasks as it has ranges.
    Rows move with all their columns: ranges are smaller by default where some
    of them are not of a fixed width.

    Keys should be unique; rows with equal keys are ranked in any order and
    share a range, so add columns to ``key`` that tell them apart. Nulls come
    first. Sampling costs a count and a pass over the keys when the frame is
    built. For whole numbers without wide gaps ``block_width`` avoids that: the
    ranges are then that many consecutive numbers each.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if rows_per_block is None:
        wide = any(f.name not in (*keys, *group) and not isinstance(f.dataType, FIXED_WIDTH) for f in df.schema)
        rows_per_block = WIDE_ROWS_PER_BLOCK if wide else ROWS_PER_BLOCK
    if block_width is None:
        cuts = splitters(df, keys, rows_per_block)
        if not cuts:
            rank = F.row_number().over(Window.partitionBy(*group).orderBy(*keys)) - 1
            return df.withColumn(name, rank.cast("bigint"))
        block = block_of(df, keys, cuts)
    else:
        # Whole-number arithmetic: exact for any 64-bit key, negative ones too.
        block = F.expr(f"(`{keys[0]}` - pmod(`{keys[0]}`, {block_width}L)) div {block_width}L")
    tagged = df.withColumn("_block", block)
    inside = F.row_number().over(Window.partitionBy(*group, "_block").orderBy(*keys)) - 1
    offsets = block_offsets(tagged, group)
    same = [tagged["_block"].eqNullSafe(offsets["_b"]), *[tagged[g].eqNullSafe(offsets[f"_g{i}"]) for i, g in enumerate(group)]]
    return (
        tagged.withColumn("_inside", inside).join(offsets, reduce(Column.__and__, same))
        .withColumn(name, (F.col("_offset") + F.col("_inside")).cast("bigint"))
        .drop("_block", "_inside", *offsets.columns)
    )


def block_offsets(tagged: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """``_offset`` of each group and ``_block``: the rows of the group in earlier blocks.

    One window task sees one row for each block of a group.
    """
    groups = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    counts = tagged.groupBy(*groups, F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*[f"_g{i}" for i in range(len(group))]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("*", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")).drop("_n")


def with_file_position(df: DataFrame, name: str = "position") -> DataFrame:
    """0-based position of each row of a file scan: by file path, then by place in the file.

    ``df`` is a scan, or columns of one. How the scan packs files into tasks
    makes no difference: rows are counted inside their block of a file, which
    one task reads in order, and shifted by the rows of all earlier blocks. Only
    one row for each block is brought together.
    """
    block = ["_path", "_start"]
    row = F.monotonically_increasing_id()
    tagged = df.withColumns({"_path": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_row": row})
    earlier = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
        .select(*block, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    return (
        tagged.join(offsets, block)
        .withColumn(name, F.col("_offset") + F.col("_row") - F.col("_first"))
        .drop(*block, "_row", "_first", "_offset")
    )


def synthesize_id_time(
    df: DataFrame, as_of, key: str | None = None, days: int = 60, position: str | None = None
) -> DataFrame:
    """``review_id`` 1..n by position and ``created_at`` spread over ``days``.

    The position is in the column ``position`` (which goes), or that of ``key``,
    or of the file scan if there is neither. A real ``created_at`` is kept.
    """
    if position:
        df = df.withColumnRenamed(position, "_pos")
    else:
        df = with_position(df, key, "_pos") if key else with_file_position(df, "_pos")
    columns = {"review_id": F.col("_pos") + 1}
    if "created_at" not in df.columns:
        base = F.lit(str(as_of)).cast("timestamp_ntz")
        columns["created_at"] = base - F.make_dt_interval(days=(F.col("_pos") % days).cast("int"))
    return df.withColumns(columns).drop("_pos")


def chunk_requests(
    df: DataFrame, key: str, size: int = 10, block_width: int | None = None
) -> DataFrame:
    """Adds ``batch``, ``chunk_start`` and the 1-based ``review_index`` in the batch.

    ``key`` may be anything unique that can be ordered, see ``with_position``.
    """
    pos = F.col("_pos")
    return (
        with_position(df, key, "_pos", block_width)
        .withColumns({
            "batch": F.expr(f"_pos div {size}"),
            "chunk_start": pos - pos % size,
            "review_index": (pos % size + 1).cast("int"),
        })
        .drop("_pos")
    )


def newest_first(df: DataFrame, time: str = "created_at", key: str = "review_id") -> DataFrame:
    return df.orderBy(F.desc(time), key)


def newest_sample(
    df: DataFrame,
    size: int = 200,
    group: list[str] | None = None,
    time: str = "created_at",
    key: str = "review_id",
    rank_name: str | None = None,
) -> DataFrame:
    """The ``size`` newest rows, or of each group; ``rank_name`` keeps their rank.

    Without groups this is a top-k; with groups no task sees more than a few
    times ``size`` rows of a group, so a hot group stays small.
    """
    order = [F.desc(time), F.col(key)]
    if not group:
        sample = df.orderBy(*order).limit(size)
        # At most ``size`` rows are ranked here.
        return sample.withColumn(rank_name, F.row_number().over(Window.orderBy(*order))) if rank_name else sample
    if size > GROUP_LIMIT:
        # Beyond this size Spark does not cut groups before the shuffle by
        # itself. Each slice of a group gives up what cannot be in its newest.
        part = F.pmod(F.xxhash64(key), F.lit(SLICES))
        in_slice = F.row_number().over(Window.partitionBy(*group, part).orderBy(*order))
        df = df.withColumn("_in_slice", in_slice).filter(F.col("_in_slice") <= size).drop("_in_slice")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    name = rank_name or "_rank"
    sample = df.withColumn(name, rank).filter(F.col(name) <= size)
    return sample if rank_name else sample.drop(name)


def paginate(df: DataFrame, order: list, page: int, page_size: int = 20) -> DataFrame:
    """Rows of one 1-based page; empty beyond the end.

    Meant for the first pages: the rows before the page are sorted too. Far
    into a table, use ``page_after``.
    """
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page starts at 1 and page_size is 1..100")
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def page_after(df: DataFrame, key: str, last_key, page_size: int = 20) -> DataFrame:
    """The page after the row with ``last_key``, by a filter the scan can use."""
    later = df if last_key is None else df.filter(F.col(key) > last_key)
    return later.orderBy(key).limit(page_size)


def page_counts(df: DataFrame, page_size: int = 20) -> DataFrame:
    """One row: ``total`` and ``total_pages``."""
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"), F.ceil(total / F.lit(page_size)).cast("bigint").alias("total_pages")
    )
