"""Model answers, pages, URLs, requests."""

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from plaintide.functions.answers import is_json
from plaintide.functions.text import display_name, tokens
from plaintide.functions.urls import platform_of, product_id_of
from plaintide.functions.vocabulary import STOPWORDS
from plaintide.operators import labeling, requests, responses
from plaintide.sources import pages

CASES = [
    ('{"fruit": [{"name": "pear"}]}', {"fruit": [{"name": "pear"}]}),
    ('```json\n{"town": "Ulm"}\n```', {"town": "Ulm"}),
    ('```\n{"town": "Graz"}\n```', {"town": "Graz"}),
    ('```JSON\n{"town": "x\\ny"}\n``` or {else}', {"town": "x\ny"}),
    ('My answer is {"town": "Bern"}, I think.', {"town": "Bern"}),
    ('{{"depth": 7}}', {"depth": 7}),
    ('{"left": 10, "right": 20,}', {"left": 10, "right": 20}),
    ('{"steps": [4, 5, ]}', {"steps": [4, 5]}),
    ('{"box": {"lid": true}}', {"box": {"lid": True}}),
    ("I would rather not say", None),
    ("", None),
    ("}{", None),
    ("{depth: 7}", None),
    ("{'depth': '7'}", None),
    ('{"left": 1} or {"right": 2}', None),
    ('{"box": {"lid": 1,}}', None),  # the repair of the braces breaks the nesting
    ("[8, 9]", [8, 9]),
    ("12", 12),
]


@pytest.mark.parametrize("text, value", CASES)
def test_json_in_answer(spark, text, value):
    row = responses.with_json(spark.createDataFrame([(text,)], "answer string")).first()
    assert (None if row.answer_json is None else json.loads(row.answer_json)) == value
    lost = responses.quarantine(spark.createDataFrame([(text,)], "answer string")).count()
    assert lost == (1 if value is None else 0)


def test_exactly_one_value(spark):
    texts = ['{"a":1}', '{"a":1} x', '{"a":1},{"b":2}', '{"a":1}] x', '1,"y":2', "", " [1] ", '"x"']
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(is_json(F.col("t")).alias("ok"))
    assert [r.ok for r in frame.collect()] == [True, False, False, False, False, False, True, True]


def test_categories_answer(spark):
    items = [{"review_number": 4, "category": "size_issue", "brief_issue": "Runs small"},
             {"review_number": 9, "category": "other"}, {"review_number": 2, "category": "price_issue", "brief_issue": "Dear"}]
    answer = "Sure:\n```json\n" + json.dumps({"categories": items}) + "\n```"
    rows = responses.ingest_model_responses(spark.createDataFrame([(7, answer)], "batch int, answer string")).collect()
    assert [(r.batch, r.item_pos, r.review_number, r.category, r.brief_issue) for r in rows] == [
        (7, 0, 4, "size_issue", "Runs small"), (7, 1, 9, "other", None), (7, 2, 2, "price_issue", "Dear")]


def test_odd_fields_lose_no_answer(spark):
    """Each answer gives rows or is quarantined with a reason."""
    item = '{"review_number": %s, "category": "other"}'
    shapes = {
        "quoted": ('{"categories": [%s, %s]}' % (item % '"2"', item % 3), [2, 3], None), "decimal": ('{"categories": [%s]}' % (item % "1.0"), [1], None),
        "half": ('{"categories": [%s]}' % (item % "1.5"), [None], None), "word": ('{"categories": [%s]}' % (item % '"two"'), [None], None),
        "object": ('{"categories": {"a": 1}}', [], "no_array"), "other name": ('{"result": []}', [], "no_array"), "bare": ("[%s]" % (item % 1), [], "no_array"),
        "empty": ('{"categories": []}', [], "empty_array"), "text": ("no idea", [], "no_json"), "null": (None, [], "no_json"),
    }
    frame = spark.createDataFrame([(k, v[0]) for k, v in shapes.items()], "name string, answer string")
    rows, lost = responses.ingest_model_responses(frame).collect(), responses.quarantine_with_reason(frame).collect()
    for name, (_, numbers, reason) in shapes.items():
        assert [r.review_number for r in rows if r.name == name] == numbers
        assert [r.reason for r in lost if r.name == name] == ([reason] if reason else [])


def test_replies(spark):
    good = json.dumps({"replies": [{"review_index": 2, "reply": "x", "key_points_addressed": ["p"]}, {"reply": "y"}]})
    frame = spark.createDataFrame([(20, good), (30, "not json")], "chunk_start bigint, answer string")
    rows = responses.ingest_reply_responses(frame).collect()
    assert sorted((r.review_index, r.reply) for r in rows) == [(21, "y"), (22, "x")]
    single = spark.createDataFrame([("not json at all",), ('{"reply": "r", "tone": "t"}',), ('{"tone": "t"}',)], "answer string")
    got = [(r.reply, r.tone) for r in responses.ingest_single_replies(single).collect()]
    assert got == [("not json at all", ""), ("r", "t"), ('{"tone": "t"}', "")]


def test_knn_and_vote_answers(spark):
    answers = ['{"category": "a", "confidence": 0.5, "reasoning": "why"}', '{"category": "b"}', "none", '{"confidence": 1}']
    frame = spark.createDataFrame(list(enumerate(answers)), "review_id int, answer string")
    rows = responses.ingest_knn_responses(frame).orderBy("review_id").collect()
    assert [(r.category, r.brief_issue, r.confidence) for r in rows] == [
        ("a", "why", 0.5), ("b", "", 0.0), ("other", "Error during analysis", 0.0), ("other", "Error during analysis", 0.0)]
    assert [r.review_id for r in responses.ingest_vote_responses(frame).collect()] == [0, 1]


LONG = "주말에 처음 써 봤는데 소리가 작고 청소가 쉬워서 마음에 들어요."
PAGES = [
    (f"별점 2\n{LONG}\n별점 5\n손잡이가 헐거워서 며칠 만에 빠졌고 설명서도 읽기 어려웠어요.", [2, 5]),
    (f"별점 1\n너무짧다\n{LONG}", [1]),
    (f"별점 3\n작성일자 2023년 11월 2일 구매확인 표시가 있는 줄입니다\n{LONG}", [3]),
    (f"2점\n{LONG}\n  {LONG}  ", [2, 2]),
    (f"{LONG}\n별점1\n", []),
    (f"별점 3\n별점 1\n{LONG}\n색깔은 4점 정도라고 생각하고 적어 둡니다\n{LONG}", [1, 4]),
    ("별점 4\nNothing here is written in the script that is looked for", []),
    ("", []),
]


@pytest.mark.parametrize("text, ratings", PAGES)
def test_page_text(spark, text, ratings):
    frame = spark.createDataFrame([(1, "naver", text), (2, "coupang", text)], "page_id int, platform string, page_text string")
    rows = pages.extract_reviews_from_text(frame, platform="naver").orderBy("line_no").collect()
    assert [r.rating for r in rows] == ratings
    assert all(r.page_id == 1 and r.review_text == r.review_text.strip() for r in rows)


def test_api_pages(spark):
    body = {"rData": {"paging": {"contents": [
        {"rating": 5, "title": "T", "content": " c "}, {"rating": None, "content": "x"}, {"rating": 1, "title": "", "content": " "},
        {"rating": 2, "title": None, "content": "only"}]},
        "ratingSummaryTotal": {"ratingCount": 4, "ratingSummaries": [{"rating": 5, "count": 3}]}}}
    frame = spark.createDataFrame([(1, json.dumps(body)), (2, "{}")], "page_id int, body string")
    rows = pages.ingest_review_pages(frame).collect()
    assert [(r.item_pos, r.rating, r.review_text) for r in rows] == [(0, 5.0, "T\n c"), (2, 1.0, None), (3, 2.0, "only")]
    assert [tuple(r) for r in pages.page_rating_summary(frame).collect()] == [(5, 3)]


@pytest.mark.parametrize("url, platform, product", [
    ("https://www.coupang.com/vp/products/55501", "coupang", "55501"),
    ("https://smartstore.naver.com/lamps/products/808", "naver", "808"),
    ("https://shopping.naver.com/window/77", "naver", None),
    ("https://shop.example.org/window/77", "unknown", None),
    ("https://M.Coupang.com:8443/vm/products/4242?vendor=9", "coupang", "4242"),
    ("https://shop.example.org/?from=coupang.com", "unknown", None),
    ("no address at all", "unknown", None),
])
def test_urls(spark, url, platform, product):
    row = spark.createDataFrame([(url,)], "url string").select(platform_of(F.col("url")), product_id_of(F.col("url"))).first()
    assert tuple(row) == (platform, product)


def plain_tokens(text):
    """Letters and blanks of the whole text, by Unicode category, then split."""
    kept = [ch for ch in (text or "").lower() if ch.isspace() or unicodedata.category(ch)[0] == "L"]
    return [word for word in "".join(kept).split() if word[1:] and word not in STOPWORDS]


@pytest.mark.parametrize("text", [
    "The price, is TOO high!!", "배송이 　늦었어요 x y", "a1b c-d  e f1g", None, "  ", "don't it's ÉTÉ naïve", "\x1cab\x1dcd"])
def test_tokens_as_in_python(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"), STOPWORDS).alias("w")).first()
    assert (row.w or []) == plain_tokens(text)


def test_display_name(spark):
    assert spark.createDataFrame([("few_shot_3",)], "k string").select(display_name(F.col("k"))).first()[0] == "Few Shot 3"


@pytest.mark.parametrize("text, category", [
    ("품질이 기대보다 낮고 금방 고장 났어요", "poor_quality"),
    ("그냥 그래요", "other"), (None, "other"), ("Wrong item in the parcel, I had asked for a lamp", "wrong_item"),
])
def test_rules(spark, text, category):
    assert labeling.label_by_rules(spark.createDataFrame([(text,)], "review_text string")).first().category == category


def test_reply_request_text(spark):
    rows = [(1, 2, "배송 늦음", "delivery_delay"), (2, 1, "품질 불량", None)]
    frame = spark.createDataFrame(rows, "review_id bigint, rating int, review_text string, category string")
    assert requests.build_reply_requests(frame).first().request_text == (
        "\n### 리뷰 1 (평점: 2점) [카테고리: delivery_delay]\n배송 늦음\n\n### 리뷰 2 (평점: 1점)\n품질 불량\n")


def test_category_request_text(spark, reviews):
    rows = requests.build_category_requests(reviews, ["rating"], size=1, chars=5).orderBy("rating").collect()
    assert [(r.review_count, r.request_text) for r in rows][:2] == [(1, "1. Refun"), (1, "1. The l")]
    both = requests.build_category_requests(reviews.filter("rating = 1"), ["rating"], chars=5).first()
    assert both.request_text == "1. Refun\n---\n2. Two s"
