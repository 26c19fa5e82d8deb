import pytest
from pyspark.sql import functions as F

from plaintide.operators import issues, stats
from tests.conftest import COMPARISON, RECENT, items


def both(spark, recent, comparison):
    return items(spark, recent).union(items(spark, comparison, "comparison"))


def test_top_issues(spark):
    top = issues.top_issues(items(spark, RECENT)).collect()
    assert [(r.category, r.n, r.percentage) for r in top] == [
        ("size_issue", 5, 41.7), ("price_issue", 3, 25.0), ("other", 2, 16.7),
    ]
    assert top[0].examples == ["issue 2", "issue 4", "issue 6"]


def test_top_issues_limits(spark):
    assert issues.top_issues(items(spark, RECENT), n=1).count() == 1
    assert issues.top_issues(items(spark, RECENT).limit(0)).count() == 0
    one = issues.top_issues(items(spark, ["poor_quality"] * 5)).first()
    assert (one.n, one.percentage) == (5, 100.0)


def test_emerging_includes_growth(spark):
    rows = issues.emerging_issues(both(spark, RECENT, COMPARISON)).collect()
    assert [(r.category, r.recent_count, r.comparison_count, r.increase_rate) for r in rows] == [
        ("wrong_item", 2, 1, 100.0), ("size_issue", 5, 4, 25.0)
    ]


@pytest.mark.parametrize("count, expected", [(6, [float("inf")]), (5, [float("inf")]), (4, []), (3, [])])
def test_new_category_needs_volume(spark, count, expected):
    rows = issues.emerging_issues(items(spark, ["new"] * count)).collect()
    assert [r.increase_rate for r in rows] == expected
    assert all(r.is_new for r in rows)


def test_twenty_percent_is_not_enough(spark):
    assert issues.emerging_issues(both(spark, ["a"] * 6, ["a"] * 5)).count() == 0


def test_decrease_and_empty(spark):
    assert issues.emerging_issues(both(spark, ["a"], ["a"] * 5)).count() == 0
    assert issues.emerging_issues(items(spark, [])).count() == 0


def test_at_most_three_and_ties_by_first_appearance(spark):
    recent = [f"cat_{i % 5}" for i in range(50)]
    comparison = [f"cat_{i}" for i in range(5)]
    rows = issues.emerging_issues(both(spark, recent, comparison)).collect()
    assert [r.category for r in rows] == ["cat_0", "cat_1", "cat_2"]


@pytest.mark.parametrize("parts", [1, 8])
def test_order_does_not_depend_on_partitions(spark, parts):
    data = both(spark, ["b", "a", "c", "a", "b", "c"] * 3, ["a", "b", "c"]).repartition(parts)
    assert [r.category for r in issues.top_issues(data.filter("period = 'recent'")).collect()] == ["b", "a", "c"]
    assert [r.category for r in issues.emerging_issues(data).collect()] == ["b", "a", "c"]


def test_brief(spark):
    rows = issues.issue_brief(both(spark, RECENT + ["size_issue"] * 3, COMPARISON)).collect()
    assert rows[0].category == "size_issue" and rows[0].increase_rate == 100.0
    assert len(rows[0].examples) == 3 and len(rows[0].complaints) == 5
    assert rows[1].increase_rate is None


def test_chart(spark):
    counts = issues.category_counts(items(spark, list("aaabbbccddeefg")))
    shown = {r.category: r.n for r in issues.chart_top(counts).collect()}
    assert shown == {"a": 3, "b": 3, "c": 2, "d": 2, "e": 2, "others": 2}
    few = issues.chart_top(issues.category_counts(items(spark, list("aab"))))
    assert {r.category for r in few.collect()} == {"a", "b"}


def test_labels(spark):
    frame = spark.createDataFrame([("delivery_delay",), ("Camera Issue",), ("",), (None,)], "category string")
    assert [r.label for r in issues.label_lookup(frame).collect()] == ["배송 지연", "Camera Issue", "", None]
    dim = spark.createDataFrame([("delivery_delay", "late")], "k string, v string")
    assert {r.label for r in issues.label_lookup(frame, dim).collect()} == {"late", "Camera Issue", "", None}


def test_share_of_input(spark):
    labeled = spark.createDataFrame([("a",), ("a",), (None,), ("",)], "category string")
    rows = stats.category_share_input(labeled, spark.range(8)).collect()
    assert {(r.category, r.n, r.percentage) for r in rows} == {("a", 2, 25.0), ("unknown", 2, 25.0)}
    none = stats.category_share_input(labeled, spark.range(0)).collect()
    assert {r.percentage for r in none} == {0.0}


def test_stats(spark, reviews):
    row = stats.review_stats(reviews).first()
    assert (row.total_reviews, row.negative_reviews, row.negative_ratio) == (10, 6, 60.0)
    empty = stats.review_stats(reviews.limit(0)).first()
    assert (empty.total_reviews, empty.negative_ratio) == (0, 0.0)
    assert stats.review_stats(reviews.filter("rating = 5")).first().negative_ratio == 0.0


def test_distribution_keys(spark):
    rated = spark.createDataFrame([(3.0,), (3.5,), (3.0,), (None,), (1.0,)], "rating double")
    assert [(r.rating_key, r.n) for r in stats.rating_distribution(rated).collect()] == [("1", 1), ("3", 2), ("3.5", 1)]


def test_crawl_summary_of_nothing(spark):
    none = spark.createDataFrame([], "rating double, review_text string")
    assert tuple(stats.crawl_summary(none).first()) == (0, 0.0, 0)
    assert stats.crawl_summary(none.union(none)).select(F.col("total_count")).first()[0] == 0
