"""Finding and repairing the JSON inside a model's free-text answer."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrays import let
from .text import strip

# How answers mark JSON, and the one repair that is tried.
FENCED_BLOCK = r"(?is)```(?:json)?\n(.*?)\n```"
COMMA_BEFORE_CLOSE = r",\s*([}\]])"


def json_candidate(answer: Column) -> Column:
    """Fenced block, else first ``{`` to last ``}``, else the whole text."""

    def between(place: Column) -> Column:
        size = place["last"] - place["first"] + 1
        return F.when((place["first"] > 0) & (size > 1), F.substring(answer, place["first"], size))

    place = F.struct(
        F.locate("{", answer).alias("first"),
        (F.length(answer) - F.length(F.substring_index(answer, "}", -1))).alias("last"),
    )
    is_fenced = answer.contains("```") & answer.rlike(FENCED_BLOCK)
    return F.when(is_fenced, strip(F.regexp_extract(answer, FENCED_BLOCK, 1))).otherwise(
        F.coalesce(let(place, between), strip(answer))
    )


def is_json(text: Column) -> Column:
    """True if the text is exactly one JSON value.

    The parser ignores whatever follows a complete value, so the text is parsed
    as the first item of an array with its own hash as the second one: that comes
    second only if the text is one value and nothing else. No text holds its hash.
    """
    own = F.md5(text.cast("binary"))
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), own, F.lit('"]')))
    return F.coalesce(F.try_variant_get(pair, "$[1]", "string") == own, F.lit(False))


def repaired(text: Column) -> Column:
    """Doubled braces made single, commas before a closing bracket dropped."""
    single = F.replace(F.replace(text, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    return F.regexp_replace(single, COMMA_BEFORE_CLOSE, "$1")


def json_of(answer: Column) -> Column:
    """The JSON text inside an answer, repaired if need be, else null."""

    def checked(text: Column) -> Column:
        fixed = let(repaired(text), lambda fixed: F.when(is_json(fixed), fixed))
        return F.when(is_json(text), text).otherwise(fixed)

    return let(json_candidate(answer), checked)
