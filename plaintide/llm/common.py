"""What several operators of the package share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Words of the contracts: runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows, and bytes of text, that a task turns into Python objects at a time.
SLICE, SLICE_BYTES = 256, 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder all executors share, and read from there: later reads start here."""
    path = f"{shared_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: dict = {}


def kept(key, make: Callable):
    """What ``make`` gives, held by the worker process from task to task; of the last ``key`` only, so that stages do not add up their models."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Frees what the worker holds of an earlier stage."""
    _KEPT.clear()


def held_out(doc_id: Column | str) -> Column:
    """True for the quarter of the documents that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str)
                                     else doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def in_tasks(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with the folder of this package on the workers' path.

    That serves where all machines have the package in one place; elsewhere it
    is sent with ``--py-files``.
    """
    environment = df.sparkSession.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [_ROOT])
    return df.mapInArrow(run, schema)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows and little text, so that a task holds few texts as Python objects.

    A row whose text is larger than ``size`` is a piece of its own.
    """
    for batch in batches:
        texts = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
        lengths = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts),
                      np.zeros(batch.num_rows, np.int64))
        ends, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(start, end - start)
            start = end
