"""Whole jobs: files in, result files out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.vocabulary import LABEL_KEYS, RULE_WORDS
from ..operators.filters import clean_labels_eval, filter_negative
from ..operators.labelers import Labeler, label_with
from ..operators.labeling import label_by_rules
from ..session import cut_lineage
from ..sources.results import write_chat_jsonl, write_metrics_json
from ..sources.tables import read_labeled_csv, read_reviews_csv, read_reviews_with_orders
from . import composites
from .composites import full_analysis


def analyze_reviews(
    reviews: DataFrame,
    as_of: datetime | str,
    threshold: int = 3,
    rules: Mapping[str, Sequence[str]] = RULE_WORDS,
    **options,
) -> dict[str, DataFrame]:
    """The full analysis of reviews without labels, labeled by word rules.

    Only negative reviews are labeled. The labels are written once, with the
    whole text as the issue, and every part reads them from there.
    """
    labels = label_by_rules(filter_negative(reviews, threshold), rules).select(
        "review_id", "rating", "created_at", "category", F.col("review_text").alias("brief_issue")
    )
    return full_analysis(reviews, cut_lineage(labels), threshold, as_of=as_of, **options)


def analyze_csv(
    spark: SparkSession, path: str, out: str, run_id: str, as_of: datetime | str, threshold: int = 3, **options
) -> str:
    """Analyzes a review CSV and writes each part as JSON below ``out``."""
    return _write(analyze_reviews(read_reviews_csv(spark, path, as_of), as_of, threshold, **options), out, run_id)


def analyze_orders_csv(
    spark: SparkSession, reviews_path: str, orders_path: str, out: str, run_id: str, as_of: datetime | str, threshold: int = 3, **options
) -> str:
    """Analyzes order reviews, dated by their orders, and writes each part as JSON below ``out``."""
    reviews = cut_lineage(read_reviews_with_orders(spark, reviews_path, orders_path))
    return _write(analyze_reviews(reviews, as_of, threshold, **options), out, run_id)


def number_ids(df: DataFrame) -> DataFrame:
    """Ids read as text become numbers if all are whole numbers, so that 9 comes before 10; others stay text."""
    plain = F.col("review_id").rlike("^(0|-?[1-9][0-9]{0,17})$")
    if dict(df.dtypes)["review_id"] != "string" or df.agg(F.count_if(~plain)).first()[0]:
        return df
    return df.withColumn("review_id", F.col("review_id").cast("bigint"))


def _write(parts: Mapping[str, DataFrame], out: str, run_id: str, prefix: str = "") -> str:
    for kind, part in parts.items():
        write_metrics_json(part, out, f"{prefix}{kind}", run_id)
    return out


def evaluate_csv(
    spark: SparkSession,
    path: str,
    make_labeler: Callable[[], Labeler],
    out: str,
    run_id: str,
    mode: str = "baseline",
    keys: Sequence[str] = LABEL_KEYS,
    default: str = "other",
) -> str:
    """Labels a hand-labeled CSV by a labeler and writes metrics and errors below ``out``.

    The labeler gets ``review_id, review_text, rating``. A row it fails for, or
    that it gives no label, counts as ``default``; failures are written too.
    Kinds are ``{mode}_overall``, ``_per_class``, ``_confusion``, ``_errors`` and
    ``_failures``, and ``_report_…`` for the analyses of the errors.
    """
    labeled = clean_labels_eval(read_labeled_csv(spark, path), keys)
    answered = cut_lineage(label_with(labeled, make_labeler, inputs=["review_id", "review_text", "rating"], allowed=[*keys, default]))
    predicted = answered.select(
        "review_id", "review_text", "rating", F.col("manual_label").alias("true_label"), F.coalesce("category", F.lit(default)).alias("predicted_label"))
    parts = composites.evaluation_report(predicted)
    errors = cut_lineage(parts["errors"])
    failures = answered.where("label_error is not null").select("review_id", "label_error")
    _write(parts | {"errors": errors, "failures": failures}, out, run_id, f"{mode}_")
    return _write(composites.error_report(number_ids(errors)), out, run_id, f"{mode}_report_")


def training_files_csv(
    spark: SparkSession, path: str, out: str, keys: Sequence[str] = LABEL_KEYS, valid_share: float = 0.2, seed: int = 42
) -> dict[str, str]:
    """Training and validation files of a hand-labeled CSV, and what was cleaned and how labels are spread, as JSON.

    Of rows with one text the one with the smallest id stays, by number if all ids are whole numbers.
    """
    labeled = number_ids(cut_lineage(read_labeled_csv(spark, path)))
    parts = composites.training_set(labeled, keys, valid_share, seed)
    paths = write_chat_jsonl(parts["examples"], out)
    for name in ("distribution", "report"):
        paths[name] = write_metrics_json(parts[name], f"{out}/reports", name, f"seed_{seed}")
    return paths
