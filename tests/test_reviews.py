"""Filters, periods, positions, CSV files, joins."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plaintide.operators import filters, joins, periods, positions, training
from plaintide.sources import results, tables

AS_OF = "2024-06-30 00:00:00"


@pytest.mark.parametrize("threshold, count", [(3, 6), (2, 4), (5, 10), (0, 0)])
def test_negative(reviews, threshold, count):
    found = filters.filter_negative(reviews, threshold)
    assert found.count() == count and found.columns == reviews.columns


def test_two_negative_rules(spark):
    rated = spark.createDataFrame([("3.7",), ("3",), ("4.0",), ("",), (" ",), ("bad",), (None,)], "rating string")
    assert [r.rating for r in filters.filter_negative_truncated(rated).collect()] == ["3.7", "3"]
    numbers = spark.createDataFrame([(3.7,), (3.0,), (None,)], "rating double")
    assert filters.filter_negative(numbers).count() == 1
    assert filters.filter_negative_truncated(numbers).count() == 2


def test_periods(reviews):
    split = periods.split_by_period(reviews).collect()
    assert {r.review_id for r in split if r.period == "recent"} == set(range(101, 107))
    assert {r.review_id for r in split if r.period == "comparison"} == set(range(107, 111))
    fixed = periods.split_by_period(reviews, as_of="2024-05-20").collect()
    assert sorted(fixed) == sorted(split)


def test_full_analysis(spark, reviews):
    from plaintide.plans.composites import full_analysis

    labeled = reviews.withColumns({"category": F.lit("poor_quality"), "brief_issue": F.col("review_text")})
    parts = full_analysis(labeled, as_of="2024-05-20")
    assert parts["stats"].first().negative_reviews == 6
    assert [(r.category, r.n) for r in parts["top_issues"].collect()] == [("poor_quality", 4)]
    assert [r.increase_rate for r in parts["emerging_issues"].collect()] == [100.0]
    assert [r.review_id for r in parts["priority_reviews"].collect()][:2] == [103, 106]
    none = full_analysis(labeled.filter("rating > 3"), as_of="2024-05-20")
    counts = {name: part.count() for name, part in none.items()}
    assert counts == {"stats": 1, "rating_distribution": 2, "top_issues": 0, "all_categories": 0,
                      "emerging_issues": 0, "priority_reviews": 0}


def test_period_bounds(spark):
    base = datetime(2024, 6, 1)
    rows = [(d, base - timedelta(days=d)) for d in (0, 30, 31, 60, 61)] + [(99, None)]
    frame = spark.createDataFrame(rows, "d int, created_at timestamp_ntz")
    split = {r.d: r.period for r in periods.split_by_period(frame).collect()}
    assert split == {0: "recent", 30: "recent", 31: "comparison", 60: "comparison"}
    assert periods.split_by_period(frame.limit(0)).count() == 0


def test_cleaning(spark):
    rows = [(1, " Other ", " a "), (2, "OTHER", "a"), (3, "nope", "b"), (4, None, "c"), (5, "", "d"),
            (6, "other", " 　"), (7, "size_issue", None), (8, "size_issue\n", "e ")]
    frame = spark.createDataFrame(rows, "review_id int, manual_label string, review_text string")
    clean = filters.clean_labels(frame)
    assert [(r.review_id, r.manual_label, r.review_text) for r in clean.orderBy("review_id").collect()] == [
        (1, "other", "a"), (2, "other", "a"), (8, "size_issue", "e")]
    assert [r.review_id for r in training.dedup_text(clean).orderBy("review_id").collect()] == [1, 8]
    report = training.cleaning_report(frame).first().asDict()
    assert report == {"rows_in": 8, "bad_label": 3, "blank_text": 2, "rows_kept": 2, "duplicates": 1, "removed_total": 6}
    assert tuple(filters.unlabeled_guard(frame).first()) == (8, 2)
    with_category = frame.withColumn("category", F.when(F.col("review_id") == 8, "Other "))
    assert [(r.review_id, r.category) for r in filters.clean_labels(with_category).collect()] == [(8, "other")]


@pytest.mark.parametrize("width", [3, 1 << 20])
@pytest.mark.parametrize("parts", [1, 8])
def test_positions(spark, width, parts):
    ids = [-7, -6, -1, 0, 1, 2, 3, 5, 8, 13, 21, 1000]
    frame = spark.createDataFrame([(i,) for i in reversed(ids)], "id bigint").repartition(parts)
    placed = positions.with_position(frame, "id", block_width=width).orderBy("id").collect()
    assert [(r.id, r.position) for r in placed] == list(zip(ids, range(len(ids))))


def test_chunks(spark):
    chunks = positions.chunk_requests(spark.range(100, 125), "id", 10, block_width=7).orderBy("id").collect()
    assert [(r.batch, r.chunk_start, r.review_index) for r in chunks] == [(i // 10, i // 10 * 10, i % 10 + 1) for i in range(25)]


def test_newest(reviews):
    assert [r.review_id for r in positions.newest_first(reviews).limit(3).collect()] == [101, 102, 103]
    per_rating = positions.newest_sample(reviews, 1, ["rating"])
    assert {r.review_id for r in per_rating.collect()} == set(range(101, 106))


def test_newest_of_large_groups(spark):
    """A group with most rows, and a size above the optimizer's own limit."""
    frame = spark.range(6000).select(
        F.col("id").alias("review_id"), F.when(F.col("id") % 6 == 0, "rare").otherwise("hot").alias("product"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 7919 % 3000).cast("int"))).alias("created_at"),
    )
    kept = positions.newest_sample(frame, 1500, ["product"]).collect()
    rows = frame.collect()
    for product in ("rare", "hot"):
        ordered = sorted((r for r in rows if r.product == product), key=lambda r: (-r.created_at.timestamp(), r.review_id))
        assert {r.review_id for r in kept if r.product == product} == {r.review_id for r in ordered[:1500]}


def test_read_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('Ratings,Reviews,Other\n5,Good,x\n1,,y\n3,"two\nlines, ""quoted""",z\n,NA,z\n2, spaced ,z\n')
    rows = tables.read_reviews_csv(spark, str(path), AS_OF).orderBy("review_id").collect()
    assert [(r.review_id, r.rating, r.review_text) for r in rows] == [
        (1, 5.0, "Good"), (3, 3.0, 'two\nlines, "quoted"'), (5, 2.0, " spaced ")]
    assert [r.created_at.day for r in rows] == [30, 28, 26]


def test_read_many_files(spark, tmp_path):
    lines = spark.range(1000).select((F.col("id") % 5 + 1).alias("rating"), F.col("id").cast("string").alias("review_text"))
    tables.write_reviews_csv(lines.repartition(7), str(tmp_path / "many"))
    rows = tables.read_reviews_csv(spark, str(tmp_path / "many"), AS_OF).collect()
    assert sorted(r.review_id for r in rows) == list(range(1, 1001))
    assert {r.review_text for r in rows} == {str(i) for i in range(1000)}


def test_files_are_read_in_order_of_path(spark, tmp_path):
    """Files of very unequal size, which a scan packs into tasks by size."""
    folder, want = tmp_path / "unequal", []
    folder.mkdir()
    for name, rows in (("a", 3), ("b", 4000), ("c", 1), ("d", 900), ("e", 2)):
        texts = [f"{name}{i} " + "x" * (i % 50) for i in range(rows)]
        want += texts
        (folder / f"{name}.csv").write_text("Ratings,Reviews\n" + "".join(f"3,{t}\n" for t in texts))
    rows = tables.read_reviews_csv(spark, str(folder), AS_OF).orderBy("review_id").collect()
    assert [r.review_id for r in rows] == list(range(1, len(want) + 1))
    assert [r.review_text.strip() for r in rows] == [t.strip() for t in want]


def test_split_of_repeated_texts(spark):
    rows = [(i, "the same text" if i % 2 else f"text {i}") for i in range(100)]
    frame = spark.createDataFrame(rows, "review_id bigint, review_text string").repartition(5)
    split = training.train_valid_split(frame)
    assert {r.part: r.n for r in split.groupBy("part").agg(F.count("*").alias("n")).collect()} == {"train": 80, "valid": 20}
    assert sorted(split.collect()) == sorted(training.train_valid_split(frame.repartition(2)).collect())


def test_labeled_csv_round_trip(spark, reviews, tmp_path):
    sample = training.sample_for_labeling(reviews)
    filled = sample.withColumn("manual_label", F.when(F.col("rating") < 4, " Other ").otherwise(""))
    path = tables.write_labeling_csv(filled, str(tmp_path / "labels"))
    read = tables.read_labeled_csv(spark, path)
    assert tuple(filters.unlabeled_guard(read).first()) == (10, 4)
    assert {r.rating for r in filters.clean_labels(read).collect()} == {1.0, 2.0, 3.0}
    with pytest.raises(ValueError, match="manual_label"):
        tables.read_labeled_csv(spark, tables.write_reviews_csv(reviews, str(tmp_path / "plain")))


def test_uploaded_csv(spark, tmp_path):
    (tmp_path / "u.csv").write_text("review_text,rating,more\nbad,2.0,x\n,3.9,x\nok,4,x\nno stars,,x\n")
    upload = tables.read_uploaded_csv(spark, str(tmp_path / "u.csv"))
    assert [tuple(r) for r in filters.filter_negative_truncated(upload).collect()] == [("2.0", "bad"), ("3.9", None)]
    assert [r.review_text for r in filters.fill_null_preview(upload, "rating", 2).collect()] == ["no stars", "bad"]


def test_analyze_csv(spark, tmp_path):
    from plaintide.plans.jobs import analyze_csv

    lines = [f"{i % 5 + 1},{'late' if i % 2 else 'broke at once'}" for i in range(200)]
    (tmp_path / "in.csv").write_text("Ratings,Reviews\n" + "\n".join(lines) + "\n")
    out = analyze_csv(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), "run_1", AS_OF)
    stats = spark.read.json(f"{out}/kind=stats").first()
    assert (stats.total_reviews, stats.negative_reviews, stats.negative_ratio) == (200, 120, 60.0)
    top = {r.category for r in spark.read.json(f"{out}/kind=top_issues").collect()}
    assert top == {"delivery_delay", "poor_quality"}
    assert spark.read.json(f"{out}/kind=priority_reviews").count() == 20


def test_read_csv_needs_columns(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("Name,Value\nA,1\n")
    with pytest.raises(ValueError, match="Ratings.*Reviews"):
        tables.read_reviews_csv(spark, str(path), AS_OF)


def test_read_csv_with_mark(spark, tmp_path):
    path = tmp_path / "bom.csv"
    path.write_text("Ratings,Reviews\n5,좋아요\n", encoding="utf-8-sig")
    assert tables.read_reviews_csv(spark, str(path), AS_OF).first().review_text == "좋아요"


def test_schema_spellings(spark):
    both = spark.createDataFrame([(1, "a", 2, "b")], "Ratings int, Reviews string, rating int, review_text string")
    assert tuple(tables.normalize_review_schema(both).first()) == (1, "a")
    assert tuple(tables.normalize_review_schema(both.select("rating", "review_text")).first()) == (2, "b")
    with pytest.raises(ValueError):
        tables.normalize_review_schema(both.select("Ratings", "review_text"))


def test_real_time_is_kept(spark, reviews):
    kept = positions.synthesize_id_time(reviews.drop("rating"), AS_OF, "review_id")
    assert kept.select("created_at").subtract(reviews.select("created_at")).count() == 0


def test_reviews_with_orders_csv(spark, tmp_path):
    (tmp_path / "r.csv").write_text("review_id,order_id,review_score,review_comment_message\na,1,5,ok\nb,2,1,\nc,3,2,late\n")
    (tmp_path / "o.csv").write_text("order_id,x,order_purchase_timestamp\n1,q,2018-01-02 03:04:05\n1,q,2018-01-03 00:00:00\n")
    rows = tables.read_reviews_with_orders(spark, str(tmp_path / "r.csv"), str(tmp_path / "o.csv")).collect()
    assert sorted((r.review_id, r.rating, str(r.created_at)) for r in rows) == [
        ("a", 5.0, "2018-01-02 03:04:05"), ("a", 5.0, "2018-01-03 00:00:00"), ("c", 2.0, "None")]


def test_attach_last_answer(spark):
    items = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (9, 2, "z")], "review_number int, item_pos int, category string")
    rows = joins.attach_predictions(spark.createDataFrame([(1,), (2,)], "review_number int"), items).collect()
    assert sorted((r.review_number, r.prediction, r.is_matched) for r in rows) == [(1, "b", True), (2, "other", False)]


def test_latest_breaks_ties(spark):
    at = datetime(2024, 1, 1)
    rows = [("a", at, -5, 1.0), ("a", at, 3, 2.0), ("b", at, 1, 5.0), ("b", at - timedelta(seconds=1), 9, 6.0)]
    history = spark.createDataFrame(rows, "kind string, run_at timestamp_ntz, run bigint, value double")
    latest = joins.latest_results(history, "kind", "run_at", "run", ["value"]).collect()
    assert {r.kind: r.value for r in latest} == {"a": 2.0, "b": 5.0}


def test_metrics_files(spark, tmp_path):
    path = str(tmp_path / "m")
    for kind, run, value in [("base", "20240101_000000", 0.5), ("base", "20240102_000000", 0.7), ("final", "20230101_000000", 0.9)]:
        results.write_metrics_json(spark.createDataFrame([("accuracy", value)], "metric string, value double"), path, kind, run)
    rows = results.read_latest_metrics(spark, path, "metric string, value double").collect()
    assert {(r.kind, r.value) for r in rows} == {("base", 0.7), ("final", 0.9)}
