"""Reports made of several operators. Each part is a lazy DataFrame of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import errors as err
from ..operators import evaluation as ev
from ..operators import issues, training
from ..operators.consensus import consensus_batch
from ..operators.filters import clean_labels, filter_negative
from ..operators.joins import attach_predictions
from ..operators.periods import split_by_period
from ..operators.priority import priority_top, with_priority
from ..operators.stats import rating_counts, rating_distribution, review_stats
from ..session import cut_lineage

__all__ = [
    "consensus_batch", "error_report", "evaluation_report", "full_analysis", "model_comparison",
    "prompt_experiment_table", "training_set",
]


def full_analysis(
    reviews: DataFrame,
    labeled: DataFrame | None = None,
    threshold: int = 3,
    recent_days: int = 30,
    comparison_days: int = 60,
    as_of=None,
    top_n: int = 3,
    priority_n: int = 20,
    **scoring_args,
) -> dict[str, DataFrame]:
    """Statistics, top and surging issues, category counts and the reviews to
    answer first.

    ``labeled`` has the negative reviews' ``review_id, rating, created_at,
    category, brief_issue``; by default these are columns of ``reviews``. It is
    read for several parts, so labels that are costly to make should come from
    a table. Examples are those of the newest reviews, and of equal categories
    the one met first from the newest on comes first. Without negative reviews
    all parts but the statistics are empty.
    """
    negative = filter_negative(reviews if labeled is None else labeled, threshold)
    order = "_order"
    periods = issues.newest_first_order(split_by_period(negative, recent_days, comparison_days), order)
    recent = periods.filter(F.col("period") == "recent")
    # Small tables, one row for a category or a rating, that several parts read: each is made by one pass and written once.
    compared = cut_lineage(issues.period_compare(periods, order))
    counts = issues.recent_counts(compared)
    ratings = cut_lineage(rating_counts(reviews))
    return {
        "stats": review_stats(ratings, threshold, counted=True),
        "rating_distribution": rating_distribution(ratings, counted=True),
        "top_issues": issues.top_issues(recent, top_n, order=order, counts=counts),
        "all_categories": counts.select("category", "n"),
        "emerging_issues": issues.emerging_issues(periods, compared=compared),
        "priority_reviews": priority_top(
            with_priority(filter_negative(reviews, threshold), as_of, **scoring_args), priority_n
        ),
    }


def evaluation_report(predictions: DataFrame) -> dict[str, DataFrame]:
    """Metrics, confusion matrix and mismatches of one prediction table.

    The table is aggregated once, and the pair counts are written for the parts that share them. The mismatches
    read it again, so predictions that are costly to make should come from a table.
    """
    pairs = cut_lineage(ev.label_pairs(predictions))
    return {
        "overall": ev.eval_weighted(pairs),
        "per_class": ev.eval_per_class(pairs),
        "confusion": ev.confusion_matrix(pairs),
        "errors": ev.mismatch_rows(predictions),
    }


def error_report(errors: DataFrame) -> dict[str, DataFrame]:
    """All error analyses of a mismatch table; empty in, empty out.

    The texts are read twice: for the profile, which is written once, and for
    the keywords.
    """
    profile = cut_lineage(err.error_profile(errors))
    return {
        "confusion_pairs": err.confusion_pairs(profile),
        "review_length": err.errors_by_length(profile),
        "rating": err.errors_by_rating(profile),
        "categories": err.errors_by_true_label(profile, None),
        "keywords": err.confusion_keywords(errors, profile=profile),
        "suggestions": err.error_suggestions(profile),
    }


def model_comparison(base: DataFrame, new: DataFrame) -> DataFrame:
    """Metrics of two prediction tables side by side, under the same names."""
    names = ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted"]

    def long(predictions: DataFrame) -> DataFrame:
        row = ev.eval_weighted(ev.label_pairs(predictions), digits=None)
        return ev.unpivot_metrics(row, names)

    return ev.metric_delta(long(base), long(new))


def training_set(labeled: DataFrame, keys, valid_share: float = 0.2, seed: int = 42) -> dict[str, DataFrame]:
    """Clean, deduplicated, split and formatted training examples with reports."""
    clean = training.dedup_text(clean_labels(labeled, keys))
    split = training.train_valid_split(clean, valid_share, seed)
    return {
        "examples": training.chat_examples(split),
        "distribution": training.train_label_distribution(split),
        "report": training.cleaning_report(labeled, keys),
    }


def prompt_experiment_table(labeled: DataFrame, answers: DataFrame, baseline: str = "zero_shot") -> DataFrame:
    """Accuracy per strategy from raw answers ``strategy, strategy_order,
    review_number, item_pos, category``. A review without an answer is ``other``."""
    last = F.max_by("category", "item_pos")
    predicted = answers.groupBy("strategy", "review_number").agg(F.min("strategy_order").alias("strategy_order"), last.alias("prediction"))
    return ev.strategy_summary(ev.answered_accuracy(labeled, predicted), baseline)
