"""Statistics of whole texts, in built-in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Words in a window that counts as repeated when it is found twice.
WINDOW = 5


def count_of(text: Column, pattern_of_others: str) -> Column:
    """Characters left when all others, given as a pattern, are taken out."""
    return F.length(F.regexp_replace(text, pattern_of_others, "")).cast("long")


def text_statistics(df: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in ``keep`` and, of each whole text, as long:

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (of
    ``#*$%&|<>``), ``n_lines`` (``\\n``-split lines with a word), ``n_dup_lines``
    (such lines equal to an earlier one), ``n_repeat_words`` (words in 5-word
    windows found twice or more, the first included), ``n_distinct`` (different
    words), and characters of ASCII kinds: ``n_upper``, ``n_letters``,
    ``n_digits``, ``n_bangs`` (``!``), ``n_bars`` (``|``).

    A null text counts as empty; an empty text has zeros. Each row gives a row.
    Windows are compared by a 64-bit hash of their five words. All arrays belong
    to one text, so memory follows the longest text, not the table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = df.select(*keep, text.alias("__text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("__words"))
    at = lambda i: [F.get("__words", i + k) for k in range(WINDOW)]
    hashes = F.when(F.size("__words") >= WINDOW,
                    F.transform(F.sequence(F.lit(0), F.size("__words") - WINDOW), lambda i: F.xxhash64(*at(i)))) \
        .otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("__text", "\n", -1), lambda line: line.rlike(WORD))
    counted = words.select(
        *keep, F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("__words")).cast("long").alias("n_distinct"),
        count_of(F.col("__text"), "[^#*$%&|<>]+").alias("n_symbols"),
        count_of(F.col("__text"), r"[^A-Z]+").alias("n_upper"),
        count_of(F.col("__text"), r"[^A-Za-z]+").alias("n_letters"),
        count_of(F.col("__text"), r"[^0-9]+").alias("n_digits"),
        count_of(F.col("__text"), r"[^!]+").alias("n_bangs"),
        count_of(F.col("__text"), r"[^|]+").alias("n_bars"),
        lines.alias("__lines"), hashes.alias("__hashes"))
    # Only texts in which a window comes again pay for the sort that finds where.
    again = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    sorted_ = counted.withColumn(
        "__sorted", F.when(again, F.array_sort(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda i: F.get("__sorted", i)["h"]
    twice = F.filter("__sorted", lambda w, i: F.coalesce(near(i - 1) == w["h"], F.lit(False)) | F.coalesce(near(i + 1) == w["h"], F.lit(False)))
    places = sorted_.withColumn("__places", F.array_sort(F.transform(twice, lambda w: w["i"])))
    covered = F.aggregate(
        "__places", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])
    return places.select(
        *keep, "n_words", "word_chars", "n_symbols", F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_distinct", "n_upper", "n_letters", "n_digits", "n_bangs", "n_bars")
