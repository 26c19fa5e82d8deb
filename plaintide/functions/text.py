"""Text expressions with Unicode-wide whitespace and letters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Every character Python's ``str.strip`` and ``str.split`` treat as blank; the
# plain ``trim`` and ``\s`` cover fewer. All of them lie below U+3001.
BLANKS = "".join(char for char in map(chr, range(0x3001)) if char.isspace())
# The same as a character class. The intersection sends ordinary letters past
# the rare blanks with one range check.
_COMMON = r"\x09-\x0D\x1C-\x20\x85\xA0"
_RARE = r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
BLANK = f"[{_COMMON}{_RARE}]"
NOT_LETTER_OR_BLANK = rf"[^\p{{L}}{_COMMON}{_RARE}]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def tokens(text: Column, stopwords: Sequence[str], min_letters: int = 2) -> Column:
    """Array of lower-case words, letters only, short words and stopwords out.

    Dropping non-letters before the split gives the same words as cleaning each
    word after it, with one pass over the text.
    """
    letters = F.regexp_replace(F.lower(text), NOT_LETTER_OR_BLANK, "")
    words = F.split(letters, f"{BLANK}+")
    stop = list(stopwords)
    return F.filter(words, lambda w: (F.length(w) >= min_letters) & ~w.isin(stop))


def preview(text: Column, size: int, dots: str = "longer") -> Column:
    """First ``size`` characters; ``...`` follows if ``longer``, ``always`` or ``never``."""
    head = F.substring(text, 1, size)
    if dots == "never":
        return head
    if dots == "always":
        return F.concat(head, F.lit("..."))
    if dots == "longer":
        return F.when(F.length(text) > size, F.concat(head, F.lit("..."))).otherwise(text)
    raise ValueError(f"dots must be 'longer', 'always' or 'never', not {dots!r}")


def length_bucket(text: Column) -> Column:
    """very_short, short, medium or long by characters."""
    n = F.length(text)
    return (
        F.when(n < 50, "very_short").when(n < 150, "short").when(n < 300, "medium").otherwise("long")
    )


def title_and_body(title: Column, body: Column) -> Column:
    """Title, line break, body; body alone without a title; null if nothing is left."""
    title, body = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    joined = F.when(title != "", F.concat(title, F.lit("\n"), body)).otherwise(body)
    return F.nullif(strip(joined), F.lit(""))


def display_name(key: Column) -> Column:
    """``a_b`` as ``A B``."""
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def rating_key(rating: Column) -> Column:
    """A rating as text: whole numbers without a decimal part."""
    return F.when(rating == F.floor(rating), rating.cast("bigint").cast("string")).otherwise(
        rating.cast("string")
    )
