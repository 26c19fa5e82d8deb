from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plaintide.operators import priority
from plaintide.operators.positions import page_counts, paginate

NOW = datetime(2024, 6, 1, 12)
SCHEMA = "review_id int, rating double, review_text string, created_at string"


def score(spark, *rows):
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], SCHEMA)
    return priority.with_priority(frame, as_of=NOW).orderBy("review_id").collect()


@pytest.mark.parametrize("rating, points", [(1.0, 40), (2.0, 25), (3.0, 10), (3.7, 10), (4.0, 0), (None, 10)])
def test_rating(spark, rating, points):
    assert score(spark, (rating, "x", None))[0].rating_score == points


@pytest.mark.parametrize("text, points", [("가" * 200, 20), ("가" * 199, 12), ("가" * 100, 12), ("가" * 50, 6), ("짧음", 2), ("", 2), (None, 2)])
def test_length(spark, text, points):
    assert score(spark, (3.0, text, None))[0].length_score == points


@pytest.mark.parametrize("text, points", [("바로 환불 원해요", 25), ("조금 실망했어요", 15), ("그냥 그래요", 5)])
def test_keywords(spark, text, points):
    assert score(spark, (3.0, text, None))[0].keyword_score == points


@pytest.mark.parametrize("age, points", [
    (timedelta(hours=12), 15), (timedelta(days=1), 15), (timedelta(days=1, seconds=1), 10), (timedelta(days=3), 10),
    (timedelta(days=5), 5), (timedelta(days=7), 5), (timedelta(days=30), 2), (timedelta(days=-2), 15),
])
def test_recency(spark, age, points):
    assert score(spark, (3.0, "x", (NOW - age).isoformat()))[0].recency_score == points


def test_recency_of_odd_values(spark):
    rows = score(spark, (3.0, "x", None), (3.0, "x", "not-a-date"), (3.0, "x", ""), (3.0, "x", "2024-06-01T11:00:00Z"),
                 (3.0, "x", "2024-06-01T13:00:00+09:00"))
    assert [r.recency_score for r in rows] == [8, 8, 8, 15, 15]
    rows = score(spark, *[(3.0, "x", text) for text in ("2024", "2024-06", " 2024-06-01", "2024-05-31", "2024-06-01 10:00:00.5")])
    assert [r.recency_score for r in rows] == [8, 8, 8, 10, 15]


def test_levels(spark):
    high, low = score(spark, (1.0, "환불 부탁드려요 " + "전원이 켜지지 않고 소리만 나요 " * 13, NOW.isoformat()), (3.0, "그저 그럼", None))
    assert high.level == "critical" and high.score >= 80
    assert low.level == "low" and low.score < 40
    assert all(r.score == r.rating_score + r.length_score + r.keyword_score + r.recency_score for r in (high, low))


def test_empty_record(spark):
    row = priority.with_priority(spark.range(1).withColumnRenamed("id", "review_id")).first()
    assert (row.score, row.level) == (25, "low")
    nested = priority.nested_priority(priority.with_priority(spark.range(1))).first().priority
    assert nested.factors.asDict() == {"rating": 10, "length": 2, "keyword": 5, "recency": 8}


def test_all_rows_kept_and_sorted(spark):
    frame = spark.createDataFrame([(1, 3.0, "쓸 만해요", None), (2, 1.0, "환불 바랍니다", None), (3, 2.0, "실망했어요", None)], SCHEMA)
    top = priority.priority_top(priority.with_priority(frame, as_of=NOW))
    assert [r.review_id for r in top.collect()] == [2, 3, 1]


@pytest.mark.parametrize("page, ids", [(1, [0, 1]), (3, [4]), (4, [])])
def test_pages(spark, page, ids):
    assert [r.id for r in paginate(spark.range(5), ["id"], page, 2).collect()] == ids
    assert tuple(page_counts(spark.range(5), 2).first()) == (5, 3)


def test_page_arguments(spark):
    with pytest.raises(ValueError):
        paginate(spark.range(5), ["id"], 0)
    with pytest.raises(ValueError):
        paginate(spark.range(5), ["id"], 1, 101)


def test_scored_stream(spark, tmp_path):
    """The column operators take a stream as it is."""
    rows = spark.createDataFrame([(1, 1.0, "환불", None), (2, 5.0, "좋아요", None)], SCHEMA)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    scored = priority.with_priority(stream, as_of=NOW).select("review_id", F.col("score"))
    run = scored.writeStream.format("memory").queryName("scored").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "state")).start()
    run.awaitTermination(60)
    assert {tuple(r) for r in spark.table("scored").collect()} == {(1, 75), (2, 15)}
