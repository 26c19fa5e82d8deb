"""Files of training examples, metrics and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.training import chat_examples, chat_json


def write_chat_jsonl(split: DataFrame, path: str, **format_args) -> dict[str, str]:
    """One folder of JSON lines for each part of a split training set."""
    lines = chat_examples(split, **format_args)
    lines = lines.select("part", chat_json(lines).alias("value"))
    paths = {"train": f"{path}/training_data", "valid": f"{path}/validation_data"}
    for part, target in paths.items():
        lines.filter(F.col("part") == part).select("value").write.text(target)
    return paths


def partition_name(value: str) -> str:
    """A value as part of a path; Spark reads it back as it was."""
    return "".join(c if c.isalnum() or c in "-_." or ord(c) > 127 else f"%{ord(c):02X}" for c in value)


def write_metrics_json(df: DataFrame, path: str, kind: str, run_id: str) -> str:
    """Metric or error rows as JSON lines below ``kind=…/run_id=…``.

    A run that is written again takes the place of what it wrote before, also if
    it has fewer rows or none; other runs are not touched.
    """
    df.write.mode("overwrite").json(f"{path}/kind={partition_name(kind)}/run_id={partition_name(run_id)}")
    return path


def read_latest_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of the last run of each kind; run ids sort as text."""
    history = spark.read.schema(f"{schema}, kind string, run_id string").json(path)
    # The partition columns alone say which run is last.
    last = history.groupBy("kind").agg(F.max("run_id").alias("run_id"))
    return history.join(last, ["kind", "run_id"], "left_semi")
