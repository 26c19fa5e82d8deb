"""Text and answer expressions against plain Python on many random strings."""

import json
import random

from pyspark.sql import functions as F

from plaintide.functions.answers import json_of
from plaintide.functions.text import strip, title_and_body, tokens
from plaintide.functions.vocabulary import STOPWORDS
from plaintide.sources.pages import extract_reviews_from_text
from tests.test_answers import plain_tokens


def strings(seed, pieces, count, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(longest))) for _ in range(count)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string")


TEXT_PIECES = [" ", "\t", "\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　", "​", "﻿",
               "a", "The", "É", "배송", "9", "-", "'", "ß", "好", "x1y", "́", "ª", "Ⅷ"]


def test_strip_and_tokens(spark):
    texts = strings(1, TEXT_PIECES, 3000, 14)
    rows = frame(spark, texts).select("i", strip(F.col("t")).alias("s"), tokens(F.col("t"), STOPWORDS).alias("w")).collect()
    for row in rows:
        assert row.s == texts[row.i].strip(), repr(texts[row.i])
        assert row.w == plain_tokens(texts[row.i]), repr(texts[row.i])


def test_title_and_body(spark):
    parts = strings(2, TEXT_PIECES, 800, 4)
    pairs = list(zip(parts[::2], parts[1::2]))
    data = spark.createDataFrame([(i, *pair) for i, pair in enumerate(pairs)], "i int, a string, b string")
    for row in data.select("i", title_and_body(F.col("a"), F.col("b")).alias("t")).collect():
        title, body = pairs[row.i]
        joined = f"{title}\n{body}" if title else body
        assert row.t == (joined.strip() or None)


def random_value(rng, depth=0):
    """A JSON value; strings hold no brace, so that wrapping cannot change it."""
    kind = rng.randrange(6 if depth < 3 else 4)
    if kind == 0:
        return rng.choice(["", "late, very late", "배송 지연", 'say "no"', "two\nlines", "back\\slash"])
    if kind == 1:
        return rng.choice([0, -7, 2.5, 1e3])
    if kind in (2, 3):
        return rng.choice([True, False, None])
    if kind == 4:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}": random_value(rng, depth + 1) for i in range(rng.randrange(4))}


# How models set their JSON. The text outside holds no brace.
HABITS = [
    "{0}", "  {0}\n", "Here it is: {0} That is all.", "```json\n{0}\n```", "```\n{0}\n```",
    "Sure!\n```JSON\n{0}\n```\nAnything else?",
]


def test_json_survives_its_wrapping(spark):
    rng = random.Random(3)
    values = [{"answer": random_value(rng), "n": i} for i in range(3000)]
    texts = [rng.choice(HABITS).format(json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))) for v in values]
    for row in frame(spark, texts).select("i", json_of(F.col("t")).alias("j")).collect():
        assert row.j is not None and json.loads(row.j) == values[row.i], texts[row.i]


def test_trailing_commas_are_repaired(spark):
    """Flat lists only: the repair also touches doubled braces, see the next test."""
    rng = random.Random(4)
    values = [{"items": [rng.randrange(9) for _ in range(rng.randrange(1, 5))]} for _ in range(500)]
    texts = [json.dumps(v).replace("]", rng.choice([",", " ,", ",\n "]) + "]") for v in values]
    texts = [rng.choice(HABITS).format(text) for text in texts]
    for row in frame(spark, texts).select("i", json_of(F.col("t")).alias("j")).collect():
        assert json.loads(row.j) == values[row.i], texts[row.i]


def test_damaged_json_is_lost(spark):
    rng = random.Random(5)
    damages = [
        lambda t: t[:-1], lambda t: t[1:], lambda t: t.replace('"', "'"), lambda t: t.replace(":", "=", 1),
        lambda t: t + " " + t, lambda t: t + "]}", lambda t: t.replace('"n"', "n"),
    ]
    whole = [json.dumps({"n": rng.randrange(99), "m": [1, {"x": 2}]}) for _ in range(700)]
    texts = [damages[i % len(damages)](text) for i, text in enumerate(whole)]
    assert frame(spark, texts).filter(json_of(F.col("t")).isNotNull()).count() == 0


def random_page(rng):
    """A page put together from parts, and the reviews that must come out."""
    lines, expected, rating = [], [], None
    for _ in range(rng.randrange(12)):
        part = rng.choice(["stars", "points", "review", "short", "skip", "latin", "blank"])
        star = rng.randrange(1, 6)
        text = {
            "stars": f"별점 {star}", "points": f"{star}점 드려요", "short": "짧은 글",
            "review": "이 제품은 정말 좋습니다 배송도 빨라요" + " 네" * rng.randrange(3),
            "skip": "옵션 검정색 그리고 길이가 충분히 긴 글입니다", "latin": "a line that is long enough but latin", "blank": "",
        }[part]
        if part in ("stars", "points"):
            rating = star
        elif part == "review" and rating:
            expected.append((len(lines), rating, text))
        lines.append(rng.choice(["", " ", "\t", "　"]) + text + rng.choice(["", " ", "\r"]))
    return "\n".join(lines), expected


def test_page_reviews(spark):
    rng = random.Random(6)
    pages = [random_page(rng) for _ in range(3000)]
    found = extract_reviews_from_text(frame(spark, [text for text, _ in pages]).withColumnRenamed("t", "page_text"))
    got = {}
    for row in found.orderBy("i", "line_no").collect():
        got.setdefault(row.i, []).append((row.line_no, row.rating, row.review_text))
    assert got == {i: rows for i, (_, rows) in enumerate(pages) if rows}
