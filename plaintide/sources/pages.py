"""Reviews from captured API pages and page texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import let, unnest
from ..functions.text import strip, title_and_body
from ..functions.vocabulary import PAGE_RATING_PATTERNS, PAGE_SCRIPT_PATTERN, PAGE_SKIP_WORDS

API_PAGE = """
rData struct<
    paging: struct<contents: array<struct<rating: double, title: string, content: string>>>,
    ratingSummaryTotal: struct<
        ratingCount: bigint, ratingSummaries: array<struct<rating: int, count: bigint>>>>
"""


def ingest_review_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row per rated item of captured API pages; text is null if there is none."""
    parsed = pages.withColumn("_page", F.from_json(body, API_PAGE))
    contents = parsed["_page"]["rData"]["paging"]["contents"]
    items = unnest(parsed, [c for c in pages.columns if c != body], contents, "item_pos", "_item")
    return items.filter(F.col("_item.rating").isNotNull()).select(
        *[c for c in items.columns if c != "_item"],
        F.col("_item.rating").alias("rating"),
        title_and_body(F.col("_item.title"), F.col("_item.content")).alias("review_text"),
    )


def page_rating_summary(pages: DataFrame, body: str = "body", order: str = "page_id") -> DataFrame:
    """The rating distribution stated by the first page that has one."""
    total = F.from_json(body, API_PAGE)["rData"]["ratingSummaryTotal"]
    first = (
        pages.select(order, total.alias("_total")).filter(F.col("_total").isNotNull())
        .orderBy(order).limit(1)
    )
    return first.select(F.explode("_total.ratingSummaries").alias("_s")).select("_s.rating", "_s.count")


def line_rating(line: Column, patterns: Sequence[str] = PAGE_RATING_PATTERNS) -> Column:
    """The digit of the first pattern that matches, else null."""
    return F.coalesce(*[
        F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).cast("int") for pattern in patterns
    ])


def extract_reviews_from_text(
    pages: DataFrame,
    text: str = "page_text",
    patterns: Sequence[str] = PAGE_RATING_PATTERNS,
    script: str = PAGE_SCRIPT_PATTERN,
    skip_words: Sequence[str] = PAGE_SKIP_WORDS,
    min_chars: int = 15,
    platform: str | None = None,
) -> DataFrame:
    """Review lines of page texts with the rating line above them.

    A line with a rating sets the rating of the lines below it and is no review
    itself. Lines before the first rating drop, and so do lines that are short,
    have no character of ``script``, or hold a skip word. With ``platform``
    only pages whose ``platform`` column is equal to it are read.

    The lines of a page never leave their row until they are reviews: the text
    is cut at its rating lines, and each cut becomes rows. No shuffle, no sort,
    and every line is copied once, however many ratings a page has.
    """
    if platform is not None:
        pages = pages.filter(F.col("platform") == platform)
    kept = [c for c in pages.columns if c != text]

    def marks(lines: Column) -> Column:
        """Place and rating of every rating line."""
        rated = F.transform(
            lines, lambda line, at: F.struct(at.alias("at"), line_rating(line, patterns).alias("rating"))
        )
        return F.filter(rated, lambda mark: mark["rating"].isNotNull())

    def sections(lines: Column) -> Column:
        """Each rating with the lines below it, up to the next rating line."""

        def section(mark: Column, place: Column, all_marks: Column) -> Column:
            first = mark["at"] + 1
            end = F.coalesce(F.get(all_marks, place + 1)["at"], F.size(lines))
            return F.struct(
                mark["rating"].alias("rating"), first.alias("first"),
                F.slice(lines, first + 1, end - first).alias("lines"),
            )

        return let(marks(lines), lambda found: F.transform(found, lambda m, i: section(m, i, found)))

    lines = F.transform(F.split(F.col(text), "\n"), lambda line: strip(line))
    cut = unnest(pages, kept, let(lines, sections), "_place", "_section")
    rows = cut.select(
        *kept, F.col("_section.rating").alias("rating"), F.col("_section.first").alias("_first"),
        F.posexplode("_section.lines").alias("_offset", "review_text"),
    )
    line = F.col("review_text")
    good = (F.length(line) >= min_chars) & line.rlike(script)
    for word in skip_words:
        good = good & ~line.contains(word)
    return rows.filter(good).select(
        *kept, (F.col("_first") + F.col("_offset")).alias("line_no"), "rating", "review_text"
    )
