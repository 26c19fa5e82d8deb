"""Quality of predicted labels against true labels.

Everything but the row listings starts from ``label_pairs``: the data is
aggregated once to at most labels x labels rows, and the rest works on those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import display_name, preview
from ..session import cut_lineage

METRICS = ["precision", "recall", "f1"]


def label_pairs(df: DataFrame, true: str = "true_label", pred: str = "predicted_label") -> DataFrame:
    """Rows per (true, predicted) label."""
    return df.groupBy(F.col(true).alias("true_label"), F.col(pred).alias("predicted_label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def label_union(df: DataFrame, true: str = "true_label", pred: str = "predicted_label") -> DataFrame:
    """Sorted labels of both columns."""
    pairs = label_pairs(df, true, pred)
    return (
        pairs.select(F.explode(F.array("true_label", "predicted_label")).alias("label"))
        .distinct().orderBy("label")
    )


def _ratio(part: Column, whole: Column) -> Column:
    """0 where it is undefined."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def class_counts(pairs: DataFrame) -> DataFrame:
    """Per label of the union: support, predicted and hits."""
    sides = F.array(
        F.struct(F.col("true_label").alias("label"), F.lit(True).alias("is_true")),
        F.struct(F.col("predicted_label").alias("label"), F.lit(False).alias("is_true")),
    )
    hit = F.col("true_label") == F.col("predicted_label")
    side = pairs.select(F.explode(sides).alias("side"), "n", hit.alias("hit"))
    true = F.col("side.is_true")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return side.groupBy(F.col("side.label").alias("label")).agg(
        total(true).alias("support"),
        total(~true).alias("predicted"),
        total(true & F.col("hit")).alias("hits"),
    )


def class_metrics(pairs: DataFrame) -> DataFrame:
    """Per label of the union: unrounded precision, recall, f1 and support."""
    p, r = F.col("precision"), F.col("recall")
    return (
        class_counts(pairs)
        .withColumns({
            "precision": _ratio(F.col("hits"), F.col("predicted")),
            "recall": _ratio(F.col("hits"), F.col("support")),
        })
        .withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
        .select("label", *METRICS, "support")
    )


def eval_per_class(pairs: DataFrame, digits: int = 4) -> DataFrame:
    """Metrics of each label that occurs as a true label."""
    rounded = [F.bround(name, digits).alias(name) for name in METRICS]
    return (
        class_metrics(pairs).filter(F.col("support") > 0)
        .select("label", *rounded, "support").orderBy("label")
    )


def eval_accuracy(pairs: DataFrame, digits: int = 4) -> DataFrame:
    hits = F.sum(F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0))
    return pairs.agg(F.bround(_ratio(hits, F.sum("n")), digits).alias("accuracy"))


def eval_weighted(pairs: DataFrame, digits: int | None = 4) -> DataFrame:
    """One row: accuracy and the support-weighted metrics. No rows give zeros."""
    metrics = class_metrics(pairs)
    support = F.sum("support")

    def mean(name: str) -> Column:
        value = _ratio(F.sum(F.col(name) * F.col("support")), support)
        return value if digits is None else F.bround(value, digits)

    # Weighted recall is hits over support, that is the accuracy.
    return metrics.agg(
        mean("recall").alias("accuracy"),
        mean("precision").alias("precision_weighted"),
        mean("recall").alias("recall_weighted"),
        mean("f1").alias("f1_weighted"),
    )


def confusion_matrix(pairs: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """A row for every true and predicted label of the union, zeros included.

    The label list is taken from the pair counts if it is not given. They are
    written once then, so that what they count is not made twice.
    """
    if labels is None:
        pairs = cut_lineage(pairs)
        sides = F.explode(F.array("true_label", "predicted_label")).alias("label")
        union = pairs.select(sides).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    else:
        union = pairs.sparkSession.range(1).select(F.array(*map(F.lit, labels)).alias("labels"))
    grid = (
        union.select(F.explode("labels").alias("true_label"), "labels")
        .select("true_label", F.explode("labels").alias("predicted_label"))
    )
    return (
        grid.join(pairs, ["true_label", "predicted_label"], "left")
        .na.fill(0, ["n"]).orderBy("true_label", "predicted_label")
    )


def mismatch_rows(
    df: DataFrame, true: str = "true_label", pred: str = "predicted_label", preview_size: int | None = None
) -> DataFrame:
    """Rows whose labels differ, with the text or only its first characters."""
    wrong = df.filter(~F.col(true).eqNullSafe(F.col(pred)))
    if preview_size is None:
        return wrong.select("review_id", "review_text", true, pred, "rating")
    short = preview(F.col("review_text"), preview_size).alias("review_preview")
    return wrong.select("review_id", short, true, pred)


def unpivot_metrics(row: DataFrame, metrics: list[str]) -> DataFrame:
    """One row of metric columns as ``(metric, value)`` rows."""
    return row.unpivot([], metrics, "metric", "value")


def metric_delta(base: DataFrame, new: DataFrame, digits: int = 4) -> DataFrame:
    """Two ``(metric, value)`` frames side by side in percent; missing base is 0."""
    base_value = F.coalesce(F.col("base_value"), F.lit(0.0))
    return (
        new.join(base.select("metric", F.col("value").alias("base_value")), "metric", "left")
        .select(
            "metric",
            F.bround(base_value * 100, digits).alias("base_pct"),
            F.bround(F.col("value") * 100, digits).alias("new_pct"),
            F.bround((F.col("value") - base_value) * 100, digits).alias("improvement"),
        )
    )


def strategy_accuracy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Accuracy per strategy; ``strategy_order`` is the order they were tried in."""
    hit = (F.col("true_label") == F.col("predicted_label")).cast("double")
    return df.groupBy("strategy").agg(
        F.min("strategy_order").alias("strategy_order"), F.bround(F.avg(hit), digits).alias("accuracy")
    )


def answered_accuracy(labeled: DataFrame, predicted: DataFrame, default: str = "other", digits: int = 4) -> DataFrame:
    """Accuracy per strategy over all rows of ``labeled`` (``review_number, true_label``), those without a prediction counting as ``default``.

    ``predicted`` has ``strategy, strategy_order, review_number, prediction``, at
    most one row for a strategy and review. Rows without a prediction are never
    made: they are right where the true label is ``default``, which is known by
    subtraction from one count over all rows.
    """
    is_default = F.coalesce(F.col("true_label") == default, F.lit(False))
    every = labeled.agg(
        F.count("true_label").alias("rows"), F.count_if(is_default).alias("defaults")).select(F.struct("rows", "defaults")).scalar()
    strategies = predicted.groupBy("strategy").agg(F.min("strategy_order").alias("strategy_order"))
    label = F.coalesce("prediction", F.lit(default))
    known = labeled.join(predicted, "review_number").groupBy("strategy").agg(
        F.count_if(F.col("true_label") == label).alias("hits"), F.count_if(is_default).alias("default_rows"))
    hits = F.coalesce("hits", F.lit(0)) + every["defaults"] - F.coalesce("default_rows", F.lit(0))
    return strategies.join(known, "strategy", "left").select(
        "strategy", "strategy_order", F.bround(F.try_divide(hits.cast("double"), every["rows"]), digits).alias("accuracy"))


def strategy_summary(accuracy: DataFrame, baseline: str = "zero_shot") -> DataFrame:
    """Improvement of each strategy over ``baseline`` in points, and the best one."""
    # One row per strategy: a window over all of them is small, and the
    # predictions behind them are evaluated once.
    everything = Window.partitionBy()
    base = F.max(F.when(F.col("strategy") == baseline, F.col("accuracy"))).over(everything)
    best = F.max_by("strategy", F.struct("accuracy", -F.col("strategy_order"))).over(everything)
    return accuracy.select(
        "strategy",
        "accuracy",
        F.bround((F.col("accuracy") - base) * 100, 1).alias("improvement"),
        (F.col("strategy") == best).alias("is_best"),
    )


def stage_report(stages: DataFrame, baseline: str = "baseline", skip: str = "temperature") -> DataFrame:
    """``(stage, accuracy)`` rows with display name and improvement over the baseline.

    Stages with ``skip`` in their name are left out; without a baseline the
    improvement is 0, and the baseline itself has none.
    """
    # One row per stage, see above.
    base = F.max(F.when(F.col("stage") == baseline, F.col("accuracy"))).over(Window.partitionBy())
    gain = F.coalesce(F.bround((F.col("accuracy") - base) * 100, 1), F.lit(0.0))
    report = stages.select(
        "stage",
        F.bround(F.col("accuracy") * 100, 2).alias("accuracy_pct"),
        F.when(F.col("stage") != baseline, gain).alias("improvement"),
    )
    return report.filter(~F.col("stage").contains(skip)).withColumn("stage", display_name(F.col("stage")))
