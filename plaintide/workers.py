"""Arrow batches in Python tasks."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


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
