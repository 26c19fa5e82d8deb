"""Quoted CSV read by as many tasks as a file has splits.

A line break may stand inside a quoted field, so a split of a file does not
know whether its first line begins a record. Two passes find out:

1. Every split is read under both assumptions at once. What a line does to the
   state "inside a quoted field" is one of four functions of two states; of a
   split, too. That and the number of records it begins under each assumption
   is one row for each split.
2. The rows of a file are chained, which gives the state and the number of
   records at the start of each split. The splits are read again, and their
   lines become numbered records.

Records that go on in another split, or in another batch of lines, come as
pieces and are put together by their number. Records are parsed by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage
from ..workers import in_tasks

#: A field that ends at a comma: quoted, with anything after its closing quote, or without quotes at its start.
_FIELD = r'(?:"(?:[^"]|"")*"(?:[^",][^,]*)?|[^",][^,]*)?'
_OPEN = rf'(?:{_FIELD},)*"(?:[^"]|"")*$'
#: Lines after which a quoted field is open, if none, or one, was before.
OPENS = rf"^{_OPEN}"
STAYS_OPEN = rf'^(?:[^"]|"")*(?:$|"(?:[^",][^,]*)?,{_OPEN})'
#: Splits up to which their start is broadcast; beyond it lines are joined with it by a shuffle.
MOST_BROADCAST = 1 << 20

Lines = Iterator[pa.RecordBatch]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, path, start``: the lines of all files, with the split they are in.

    The number of splits must not change between the passes, as it would when
    executors come or go: it is fixed in the session, unless that is set.
    """
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    lines = spark.read.text(path, lineSep="\n")
    return lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def _effects(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether a field is open after each line, if none was before and if one was."""
    opens, stays = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    if len(quoted):
        some = lines.take(pa.array(quoted))
        opens[quoted] = pc.match_substring_regex(some, OPENS).to_numpy(zero_copy_only=False)
        stays[quoted] = pc.match_substring_regex(some, STAYS_OPEN).to_numpy(zero_copy_only=False)
    return opens, stays


def _equal(lines: pa.Array, text: str) -> np.ndarray:
    return pc.equal(lines, text).to_numpy(zero_copy_only=False)


def _states(opens: np.ndarray, stays: np.ndarray, first: bool) -> np.ndarray:
    """Whether a field is open before each line and after the last one: what the last line that decides it says, turned as often as lines after it turn it."""
    decided, turns = opens == stays, np.cumsum(opens & ~stays)
    last = np.maximum.accumulate(np.where(decided, np.arange(len(opens)), -1))
    known = last >= 0
    after = np.where(known, opens[last], first) ^ ((turns - np.where(known, turns[last], 0)) % 2).astype(bool)
    return np.concatenate([[first], after])


def _segments(batches: Lines) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batches cut where another split begins, each with the values of its split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start = batch.column("start").to_numpy()
        path = batch.column("path").dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(start) != 0) | (np.diff(path) != 0)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            yield tuple(column[0].as_py() for column in part.columns[1:]), part


def _summaries(batches: Lines) -> Lines:
    names = ["path", "start", "opens", "stays", "n_closed", "n_open", "returns_closed", "returns_open", "windows"]
    now, row = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, *row)], names)

    for split, part in _segments(batches):
        lines = part.column(0)
        if split != now:
            if now:
                yield out()
            now, row = split, [False, True, 0, 0, 0, 0, lines[0].as_py().endswith("\r")]
        opens, stays = _effects(lines)
        blank, lone = _equal(lines, ""), _equal(lines, "\r")
        for k in (0, 1):
            before = _states(opens, stays, row[k])
            begins = ~before[:-1] & ~blank
            row[k], row[k + 2], row[k + 4] = bool(before[-1]), row[k + 2] + int(begins.sum()), row[k + 4] + int((begins & lone).sum())
    if now:
        yield out()


def _records(batches: Lines) -> Lines:
    """``number, start, piece, whole, record``: the records of each part of a split, whole or in pieces."""
    now, number, inside, piece = None, 0, False, 0
    for split, part in _segments(batches):
        if split[:2] != now:
            if split[2] is None:
                raise ValueError("the splits of the files changed while they were read; set spark.sql.files.minPartitionNum")
            now, inside, number, piece = split[:2], bool(split[2]), split[3] - 1, 0
        lines = part.column(0)
        if split[4]:
            lines = pc.replace_substring_regex(lines, "\r$", "")
        opens, stays = _effects(lines)
        before = _states(opens, stays, inside)
        begins = ~before[:-1] & ~_equal(lines, "")
        # A blank line between records is none.
        kept = np.flatnonzero(begins | before[:-1])
        numbers = number + np.cumsum(begins)[kept]
        first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])) if len(kept) else np.zeros(0, int)
        last = np.concatenate([first[1:], [len(kept)]])[:len(first)] - 1
        whole = begins[kept[first]] & ~before[kept[last] + 1]
        offsets = pa.array(np.concatenate([first, [len(kept)]]) if len(kept) else np.zeros(1, int), pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(offsets, lines.take(pa.array(kept))), "\n")
        yield pa.RecordBatch.from_arrays([
            pa.array(numbers[first]), pa.array(np.full(len(first), now[1], np.int64)), pa.array(np.full(len(first), piece, np.int64)),
            pa.array(whole), texts, pa.array([now[0]] * len(first), pa.string())],
            ["number", "start", "piece", "whole", "record", "path"])
        number, inside, piece = number + int(begins.sum()), bool(before[-1]), piece + 1


def split_starts(lines: DataFrame) -> DataFrame:
    """``path, start, inside, records, windows``: whether each split begins inside a quoted field, the records that begin before it in its file, and whether lines of the file end with ``\\r\\n``, as its first one does.

    Only one row for each split of a file comes together.
    """
    seen = in_tasks(lines, _summaries, "path string, start bigint, opens boolean, stays boolean, n_closed bigint, n_open bigint, "
                    "returns_closed bigint, returns_open bigint, windows boolean")
    file = Window.partitionBy("path").orderBy("start")
    earlier = file.rowsBetween(Window.unboundedPreceding, -1)
    decided = F.col("opens") == F.col("stays")
    turns = seen.withColumn("turns", F.coalesce(F.sum((F.col("opens") & ~F.col("stays")).cast("int")).over(file), F.lit(0)))
    last = F.last(F.when(decided, F.struct("opens", "turns")), ignorenulls=True).over(earlier)
    chained = turns.withColumns({"_last": last, "_turns": F.coalesce(F.lag("turns").over(file), F.lit(0))})
    turned = (F.col("_turns") - F.coalesce(F.col("_last.turns"), F.lit(0))) % 2 == 1
    states = chained.withColumn("inside", F.coalesce(F.col("_last.opens"), F.lit(False)) != turned)
    begun = lambda n, returns: F.col(n) - F.when(F.col("windows"), F.col(returns)).otherwise(0)
    count = F.when(F.col("inside"), begun("n_open", "returns_open")).otherwise(begun("n_closed", "returns_closed"))
    counted = states.withColumn("windows", F.first("windows").over(file)).withColumn("n", count)
    return counted.select("path", "start", "inside", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("records"), "windows", "n")


def read_records(spark: SparkSession, path: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``path, number, position, record`` of every record below the header of each file.

    ``number`` counts from 1 inside the file, ``position`` from 0 over all
    files in the order of their paths.
    """
    lines = read_lines(spark, path)
    starts = split_starts(lines)
    # One small row for each split, needed three times.
    starts = cut_lineage(starts)
    joined = ["path", "start"]
    told = starts.select(*joined, "inside", "records", "windows")
    if starts.count() <= most_broadcast:
        placed = lines.join(F.broadcast(told), joined, "left")
    else:
        # Lines come back in their order, whatever the join has done to it.
        placed = lines.withColumn("row", F.monotonically_increasing_id()).join(told, joined, "left") \
            .repartition(*joined).sortWithinPartitions(*joined, "row")
    cut = in_tasks(placed.select("value", *joined, "inside", "records", "windows"), _records,
                   "number bigint, start bigint, piece bigint, whole boolean, record string, path string")
    pieces = F.sort_array(F.collect_list(F.struct("start", "piece", "record")))
    joined_pieces = cut.where("not whole").groupBy("path", "number").agg(F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record"))
    records = cut.where("whole").select("path", "number", "record").union(joined_pieces)
    files = starts.groupBy("path").agg(F.greatest(F.sum("n") - 1, F.lit(0)).alias("n"))
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("path", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return records.join(base, "path").withColumn("position", F.col("base") + F.col("number") - 1).select("path", "number", "position", "record")


def read_csv(spark: SparkSession, path: str, position: str | None = None, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """A CSV with header, all columns as text, as Spark's reader with ``multiLine`` gives it, but split into tasks.

    ``position`` names a column for the 0-based place of each row, files in the
    order of their paths. Fields may be quoted, hold commas, line breaks and
    doubled quotes; a quote inside a field that does not begin with one is a
    character. Blank lines are no rows. All files must have the same header.
    Lines end with ``\\n`` or ``\\r\\n``.
    """
    options = {"header": "true", "multiLine": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    names = spark.read.options(**options).csv(path).columns
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    records = read_records(spark, path, most_broadcast)
    fields = F.from_csv("record", schema, {k: v for k, v in options.items() if k != "header"})
    same = F.coalesce(fields == F.struct(*[F.lit(n).alias(n) for n in names]), F.lit(False))
    # Header rows are dropped, and fail the job where they are not that of the first file.
    wrong = F.raise_error(F.concat(F.lit("another header in "), "path")).cast("boolean")
    rows = records.where(F.when(F.col("number") > 0, True).when(same, False).otherwise(wrong))
    kept = [F.col("position").alias(position)] if position else []
    return rows.select(fields.alias("_fields"), *kept).select(*[F.col("_fields")[name].alias(name) for name in names], *([position] if position else []))
