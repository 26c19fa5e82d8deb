"""Row filters and label cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_blank, strip
from ..functions.vocabulary import LABEL_KEYS


def drop_null_text(df: DataFrame, text: str = "review_text") -> DataFrame:
    return df.filter(F.col(text).isNotNull())


def filter_negative(df: DataFrame, threshold: float = 3, rating: str = "rating") -> DataFrame:
    """Ratings up to ``threshold``; the comparison reaches the Parquet scan."""
    return df.filter(F.col(rating) <= threshold)


def filter_negative_truncated(
    df: DataFrame, threshold: int = 3, rating: str = "rating"
) -> DataFrame:
    """As above on the whole-star part: 3.7 passes at 3. Unreadable ratings drop."""
    return df.filter(F.col(rating).try_cast("double").try_cast("int") <= threshold)


def filter_level(df: DataFrame, level: str | None, column: str = "level") -> DataFrame:
    return df if level is None else df.filter(F.col(column) == level)


def labeled_only(df: DataFrame, label: str = "manual_label") -> DataFrame:
    return df.filter(F.col(label).isNotNull())


def unlabeled_guard(df: DataFrame, label: str = "manual_label") -> DataFrame:
    """One row: rows in all and rows without a label. The caller decides what to do."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_blank(F.col(label))).alias("unlabeled"),
    )


def normal_label(label: Column) -> Column:
    return F.lower(strip(label))


def usable_label(label: Column, keys: Sequence[str] = LABEL_KEYS) -> Column:
    """True for a label that is one of ``keys`` after strip and lower; never null."""
    return F.coalesce(normal_label(label).isin(list(keys)), F.lit(False))


def clean_labels(
    df: DataFrame,
    keys: Sequence[str] = LABEL_KEYS,
    label: str = "manual_label",
    text: str = "review_text",
    category: str = "category",
) -> DataFrame:
    """Rows fit for training: known label, text left after strip.

    A ``category`` column, where there is one, has to hold a known key too.
    """
    checked = [label] + ([category] if category in df.columns else [])
    for name in checked:
        df = df.filter(usable_label(F.col(name), keys)).withColumn(name, normal_label(F.col(name)))
    return df.filter(~is_blank(F.col(text))).withColumn(text, strip(F.col(text)))


def clean_labels_eval(
    df: DataFrame, keys: Sequence[str] = LABEL_KEYS, label: str = "manual_label"
) -> DataFrame:
    """Rows fit for evaluation: known label only; text is left as it is."""
    return df.filter(usable_label(F.col(label), keys)).withColumn(label, normal_label(F.col(label)))


def valid_category_check(
    df: DataFrame, keys: Sequence[str] = LABEL_KEYS, category: str = "category"
) -> DataFrame:
    """Normalise predictions; an unknown one becomes null and is flagged."""
    valid = usable_label(F.col(category), keys)
    return df.withColumns(
        {"is_failure": ~valid, category: F.when(valid, normal_label(F.col(category)))}
    )


def fill_null_preview(df: DataFrame, order_by: str, size: int = 5) -> DataFrame:
    """The first rows, null strings as ''."""
    return df.orderBy(order_by).limit(size).na.fill("")
