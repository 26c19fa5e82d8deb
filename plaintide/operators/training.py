"""Labeled training sets: deduplicate, split, format, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import percent
from ..functions.text import is_blank
from ..functions.vocabulary import CHAT_SYSTEM_TEXT, CHAT_USER_PREFIX, LABEL_KEYS
from ..session import cut_lineage
from .filters import clean_labels, usable_label


FEW_KEYS = 1 << 14


def dedup_text(df: DataFrame, text: str = "review_text", order: str = "review_id") -> DataFrame:
    """The first row of each text.

    Every task keeps one row per text before the shuffle, so copies that make
    up a third of the table do not meet in one place. The hash comes first in
    the sort key to spare comparisons of long texts; the text itself decides.
    """
    first = F.row_number().over(
        Window.partitionBy(F.xxhash64(text), F.col(text)).orderBy(order)
    )
    return df.withColumn("_copy", first).filter(F.col("_copy") == 1).drop("_copy")


def shuffle_key(text: Column, seed: int) -> Column:
    """A reproducible pseudo-random sort key."""
    return F.md5(F.concat(text, F.lit(f"-{seed}")).cast("binary"))


def sample_for_labeling(df: DataFrame, size: int = 100, seed: int = 42, key: str = "review_id") -> DataFrame:
    """``size`` rows in seeded random order, with empty columns to fill in."""
    return (
        df.orderBy(shuffle_key(F.col(key).cast("string"), seed), key).limit(size)
        .select(
            "review_id", "review_text", "rating",
            F.lit("").alias("manual_label"), F.lit("").alias("notes"),
        )
    )


def train_valid_split(
    df: DataFrame, valid_share: float = 0.2, seed: int = 42, text: str = "review_text", tie: str = "review_id"
) -> DataFrame:
    """Adds ``part``: exactly ``int(n * (1 - valid_share))`` rows of ``train``.

    Equal texts are told apart by ``tie``, a unique column; without it ``text``
    has to be unique. In place of sorting the table, the key of the last
    training row is found by counting: first per 4-digit prefix of the key, then
    per longer prefix inside the one that holds the cut, then among the few keys
    of that. The split itself is a comparison per row.

    The rows are written once with their key, so that each text is made, cleaned
    and hashed once, and the counts read the keys alone.
    """
    key, digits = shuffle_key(F.col(text), seed), [4, 8]
    if tie in df.columns:
        # The second half of the key is hashed too, so copies of one text spread over its prefixes.
        key, digits = F.concat(key, F.md5(F.col(tie).cast("string").cast("binary")), F.col(tie).cast("string")), [4, 8, 36, 40]
    keyed = cut_lineage(df.withColumn("_key", key))
    # A null text has no key and is never trained on.
    last = _nth_key(keyed.select("_key").filter("_key is not null"), int(keyed.count() * (1 - valid_share)), digits)
    is_train = F.lit(False) if last is None else F.coalesce(F.col("_key") <= last, F.lit(False))
    return keyed.withColumn("part", F.when(is_train, "train").otherwise("valid")).drop("_key")


def _nth_key(keys: DataFrame, n: int, digits: Sequence[int]) -> str | None:
    """The ``n``-th smallest key, counted from 1; None if there is no such key.

    Keys are counted by a prefix, then by a longer one inside the prefix that
    holds the n-th, until few keys have it. A count has at most 16 ** 4 rows, so
    their running sum is one small task, and one row of it is wanted.
    """
    if n < 1:
        return None
    for size in digits:
        counts = keys.groupBy(F.substring("_key", 1, size).alias("_prefix")).agg(F.count(F.lit(1)).alias("_n"))
        ends = counts.withColumn("_end", F.sum("_n").over(Window.orderBy("_prefix")))
        at = ends.filter(F.col("_end") >= n).orderBy("_prefix").first()
        if at is None:
            return None
        keys, n = keys.filter(F.col("_key").startswith(at["_prefix"])), n - (at["_end"] - at["_n"])
        if at["_n"] <= FEW_KEYS:
            break
    # Beyond all prefixes only rows with the same text and the hash of the same id are left.
    return keys.orderBy("_key").limit(n).agg(F.max("_key")).first()[0]


def chat_examples(
    df: DataFrame,
    label: str = "manual_label",
    text: str = "review_text",
    system_text: str = CHAT_SYSTEM_TEXT,
    user_prefix: str = CHAT_USER_PREFIX,
) -> DataFrame:
    """Adds ``messages``: system, user and assistant turn of each example."""

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return df.withColumn("messages", F.array(
        turn("system", F.lit(system_text)),
        turn("user", F.concat(F.lit(user_prefix), F.col(text))),
        turn("assistant", F.col(label)),
    ))


def chat_json(df: DataFrame) -> Column:
    """One JSON line per example; non-ASCII text stays as it is."""
    return F.to_json(F.struct(df["messages"]))


def cleaning_report(
    df: DataFrame, keys: Sequence[str] = LABEL_KEYS, label: str = "manual_label", text: str = "review_text"
) -> DataFrame:
    """One row: rows in, dropped per rule, duplicates and rows kept."""
    good_label = usable_label(F.col(label), keys)
    rules = df.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(~good_label).alias("bad_label"),
        F.count_if(good_label & is_blank(F.col(text))).alias("blank_text"),
    )
    # Distinct texts only: nothing is kept but the count.
    kept = clean_labels(df, keys, label, text).select(text).distinct().agg(F.count(F.lit(1))).scalar()
    clean = F.col("rows_in") - F.col("bad_label") - F.col("blank_text")
    return rules.withColumn("rows_kept", kept).withColumns({
        "duplicates": clean - F.col("rows_kept"),
        "removed_total": F.col("rows_in") - F.col("rows_kept"),
    })


def train_label_distribution(split: DataFrame, label: str = "manual_label") -> DataFrame:
    """Training rows per label in percent, and the size of both parts."""
    counts = split.groupBy("part", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))

    def size(part: str) -> Column:
        # Over the counts, two rows per label.
        return F.sum(F.when(F.col("part") == part, F.col("n")).otherwise(0)).over(Window.partitionBy())

    sized = counts.withColumns({"train_rows": size("train"), "valid_rows": size("valid")})
    return sized.filter(F.col("part") == "train").select(
        "label", "n", percent(F.col("n"), F.col("train_rows")).alias("percentage"), "train_rows", "valid_rows"
    )
