"""Response tables: raw model answers to typed rows.

Every reader returns good rows; ``quarantine`` returns the answers no reader
can use, so that nothing is lost without a trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.answers import json_of
from ..functions.arrays import unnest

# Every field is read as text first: one odd value must not lose the whole answer.
CATEGORIES = "categories array<struct<review_number: string, category: string, brief_issue: string>>"
REPLY = "reply: string, tone: string, key_points_addressed: array<string>, suggested_action: string"
SINGLE = "category string, confidence double, reasoning string"
STRICT = {"allowSingleQuotes": "false"}


def with_json(df: DataFrame, answer: str = "answer", name: str = "answer_json") -> DataFrame:
    """Adds the JSON text inside each answer, repaired if need be, else null."""
    return df.withColumn(name, json_of(F.col(answer)))


def _parsed(schema: str, answer: str) -> Column:
    return F.from_json(json_of(F.col(answer)), schema, STRICT)


def _others(df: DataFrame, answer: str) -> list[str]:
    return [name for name in df.columns if name != answer]


def _whole(text: Column) -> Column:
    """A number in any spelling (2, "2", 2.0) as int, null if it isn't a whole one."""
    number = text.try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("int"))


def ingest_model_responses(df: DataFrame, answer: str = "answer") -> DataFrame:
    """One row per categorized review; adds the number, category, issue and position."""
    items = unnest(df, _others(df, answer), _parsed(CATEGORIES, answer)["categories"], "item_pos", "_item")
    return items.select("*", "_item.*").drop("_item").withColumn("review_number", _whole(F.col("review_number")))


def quarantine(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Answers without usable JSON."""
    return with_json(df, answer).filter(F.col("answer_json").isNull()).drop("answer_json")


def quarantine_with_reason(df: DataFrame, field: str = "categories", answer: str = "answer") -> DataFrame:
    """Answers that give no row, and why: ``no_json``, ``no_array`` (no array of that name) or ``empty_array``.

    Each answer either gives rows in the reader of ``field`` or is listed here.
    """
    items = F.from_json(json_of(F.col(answer)), f"`{field}` array<struct<_any: string>>", STRICT)[field]
    sized = with_json(df, answer, "_json").withColumn("_items", F.size(items))
    reason = F.when(F.col("_json").isNull(), "no_json").when(F.coalesce("_items", F.lit(-1)) < 0, "no_array").when(F.col("_items") == 0, "empty_array")
    return sized.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("_json", "_items")


def ingest_reply_responses(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Replies of batch answers; the index is shifted by ``chunk_start``, missing counts as 1."""
    schema = f"replies array<struct<review_index: string, {REPLY}>>"
    return (
        unnest(df, _others(df, answer), _parsed(schema, answer)["replies"], "_pos", "_reply")
        .withColumn("review_index", F.col("chunk_start") + F.coalesce(_whole(F.col("_reply.review_index")), F.lit(1)))
        .select("*", *[f"_reply.{c}" for c in ("reply", "tone", "key_points_addressed", "suggested_action")])
        .drop("_reply", "_pos")
    )


def ingest_single_replies(df: DataFrame, answer: str = "answer") -> DataFrame:
    """One reply per answer; an unusable answer is itself the reply, the rest is empty."""
    schema = ", ".join(part.replace(": ", " ", 1) for part in REPLY.split(", "))
    good = F.col("_parsed.reply").isNotNull()
    empty = F.array().cast("array<string>")
    return (
        df.withColumn("_parsed", _parsed(schema, answer))
        .withColumns({
            "reply": F.when(good, F.col("_parsed.reply")).otherwise(F.col(answer)),
            "tone": F.when(good, F.col("_parsed.tone")).otherwise(""),
            "key_points_addressed": F.when(good, F.col("_parsed.key_points_addressed")).otherwise(empty),
            "suggested_action": F.when(good, F.col("_parsed.suggested_action")).otherwise(""),
        })
        .drop("_parsed", answer)
    )


def ingest_knn_responses(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Category, issue and confidence per review; an unusable answer is ``other`` with 0."""
    good = F.col("_parsed.category").isNotNull()
    return (
        df.withColumn("_parsed", _parsed(SINGLE, answer))
        .withColumns({
            "category": F.coalesce(F.col("_parsed.category"), F.lit("other")),
            "brief_issue": F.when(good, F.coalesce(F.col("_parsed.reasoning"), F.lit(""))).otherwise(
                "Error during analysis"
            ),
            "confidence": F.when(good, F.coalesce(F.col("_parsed.confidence"), F.lit(0.0))).otherwise(0.0),
        })
        .drop("_parsed", answer)
    )


def ingest_vote_responses(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Votes with a category; answers without one are left out.

    The test is part of the generator: as a filter it would be moved below the
    parsing and parse each answer a second time.
    """
    vote = F.filter(F.array(_parsed(SINGLE, answer)), lambda v: v["category"].isNotNull())
    return df.select(*_others(df, answer), F.inline(vote))
