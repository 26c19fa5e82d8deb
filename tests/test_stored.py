"""Stored day counts, stored pages, results written again, jobs from files."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plaintide.operators import issues, period_counts, periods, requests, stored_pages
from plaintide.plans import jobs
from plaintide.sources import results, tables

NEWEST = datetime(2024, 5, 20, 14, 30)


@pytest.fixture
def dated(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "b", "c", None]), NEWEST - timedelta(minutes=rng.randrange(70 * 24 * 60)) if i else NEWEST) for i in range(400)]
    rows += [(400, "a", None), (401, "b", datetime(2024, 4, 20, 14, 30)), (402, "b", datetime(2024, 4, 20, 14, 29, 59)), (403, "c", datetime(2024, 3, 21, 14, 30))]
    return spark.createDataFrame(rows, "review_number int, category string, created_at timestamp_ntz")


def rows(df):
    return sorted((str(r.category), r.recent_count, r.comparison_count, r.first_position) for r in df.collect())


@pytest.mark.parametrize("as_of", [None, "2024-05-20", "2024-05-10 23:59:59", "2024-06-19 00:00:00", "2030-01-01 01:00:00"])
def test_same_as_full_comparison(spark, tmp_path, dated, as_of):
    path = period_counts.store_days(dated, str(tmp_path / "days"))
    expected = rows(issues.period_compare(periods.split_by_period(dated, as_of=as_of)))
    assert rows(period_counts.stored_period_compare(spark, path, as_of, items=dated)) == expected
    found = period_counts.stored_period_compare(spark, path, as_of, items=dated)
    assert [tuple(r) for r in issues.emerging_issues(None, compared=found).collect()] == [
        tuple(r) for r in issues.emerging_issues(periods.split_by_period(dated, as_of=as_of)).collect()]


def test_days_are_replaced(spark, tmp_path, dated):
    path, day = str(tmp_path / "days"), date(2024, 5, 18)
    period_counts.store_days(dated, path)
    before = {(r.day, r.category): r.n for r in period_counts.read_days(spark, path).collect()}
    on_day = F.to_date("created_at") == F.lit(day)
    added = dated.where(~on_day).union(spark.createDataFrame([(900 + i, "new", datetime(2024, 5, 18, 5)) for i in range(7)], dated.schema))
    period_counts.store_days(added, path, [day])
    period_counts.store_days(added, path, [day])
    after = {(r.day, r.category): r.n for r in period_counts.read_days(spark, path).collect()}
    assert after == {k: n for k, n in before.items() if k[0] != day} | {(day, "new"): 7}
    period_counts.store_days(dated.where(~on_day), path, [day])
    assert not [r for r in period_counts.read_days(spark, path).collect() if r.day == day]


def test_one_day_reads_one_day(spark, tmp_path, dated):
    dated.write.parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    plan = period_counts._on_days(items, [date(2024, 5, 18)], "created_at")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):].split("ReadSchema")[0].replace(" ", "")
    assert "GreaterThanOrEqual(created_at,2024-05-18" in pushed and "LessThan(created_at,2024" in pushed, pushed
    path = period_counts.store_days(items, str(tmp_path / "days"))
    plan = period_counts.stored_period_compare(spark, path, "2024-05-10")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-03-11" in plan
    with pytest.raises(ValueError, match="within a day"):
        period_counts.stored_period_compare(spark, path, "2024-05-10 12:00:00")


def test_nothing_stored(spark, tmp_path, dated):
    path = period_counts.store_days(dated.limit(0), str(tmp_path / "days"), [date(2024, 5, 18)])
    assert period_counts.stored_period_compare(spark, path).count() == 0


@pytest.mark.parametrize("per_file, size", [(7, 5), (100, 20), (1000, 33)])
def test_pages(spark, tmp_path, dated, per_file, size):
    order = stored_pages.newest_order(key="review_number")
    path = stored_pages.store_pages(dated, str(tmp_path / "pages"), order, per_file)
    expected = [r.review_number for r in dated.orderBy(F.desc("created_at"), "review_number").collect()]
    assert expected[-1] == 400
    got = [r.review_number for page in range(1, 404 // size + 3) for r in stored_pages.stored_page(spark, path, page, size).collect()]
    assert got == expected
    totals = stored_pages.stored_totals(spark, path, size).first()
    assert (totals.total, totals.total_pages) == (404, -(-404 // size))


def test_a_page_opens_its_file(spark, tmp_path, dated):
    path = stored_pages.store_pages(dated, str(tmp_path / "pages"), stored_pages.newest_order(key="review_number"), 50)
    assert len(spark.read.parquet(f"{path}/rows").inputFiles()) == 9
    plan = stored_pages.stored_page(spark, path, 8, 10)._jdf.queryExecution()
    plan.toRdd().count()
    text = plan.executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in text or "PartitionFilters: [(part" in text
    found = stored_pages.stored_page(spark, path, 8, 10).select("rank", F.col("_metadata.file_path").alias("file"))
    assert found.select("file").distinct().count() == 1
    stored_pages.store_pages(dated.limit(3), path, stored_pages.newest_order(key="review_number"), 50)
    assert stored_pages.stored_page(spark, path, 1, 10).count() == 3 and stored_pages.stored_page(spark, path, 2, 10).count() == 0


def test_results_written_again(spark, tmp_path):
    path, schema = str(tmp_path / "results"), "metric string, n int"
    first = spark.createDataFrame([("a", 1), ("b", 2)], schema)
    for run in ("2024-01-01 10:00", "2024-01-02 10:00", "2024-01-02 10:00"):
        results.write_metrics_json(first, path, "base/line", run)
    results.write_metrics_json(first.limit(1), path, "é", "x")
    found = sorted((r.kind, r.run_id, r.metric) for r in results.read_latest_metrics(spark, path, schema).collect())
    assert found == [("base/line", "2024-01-02 10:00", "a"), ("base/line", "2024-01-02 10:00", "b"), ("é", "x", "a")]
    results.write_metrics_json(first.limit(0), path, "é", "x")
    assert {r.kind for r in results.read_latest_metrics(spark, path, schema).collect()} == {"base/line"}


def test_answers_that_fit_no_review(spark):
    numbers = spark.createDataFrame([("g", 1, 11), ("g", 2, 12), ("h", 1, 21)], "g string, review_number int, review_id int")
    items = spark.createDataFrame([("g", 1, "a"), ("g", 9, "b"), ("g", None, "c"), ("h", 2, "d")], "g string, review_number int, category string")
    assert [r.review_id for r in requests.attach_answers(items, numbers, ["g"]).collect()] == [11]
    assert {(r.category, r.reason) for r in requests.unknown_answers(items, numbers, ["g"]).collect()} == {
        ("b", "unknown number"), ("c", "no number"), ("d", "unknown number")}
    assert {(r.review_id, r.category) for r in requests.unanswered(items, numbers, ["g"]).collect()} == {(12, "other"), (21, "other")}


def test_evaluation_with_failures(spark, tmp_path):
    rows = [(i, f"text {i}", 1 + i % 5, ["good", " BAD ", "what", None][i % 4], "") for i in range(40)]
    sample = spark.createDataFrame(rows, "review_id int, review_text string, rating int, manual_label string, notes string")
    path = tables.write_labeling_csv(sample, str(tmp_path / "labeled"))

    def make():
        def label(batch):
            if "16" in batch.column("review_id").to_pylist():
                raise RuntimeError("no answer")
            return ["good"] * batch.num_rows

        return label

    out = jobs.evaluate_csv(spark, path, make, str(tmp_path / "out"), "r1", "new", keys=["good", "bad"])
    read = lambda kind, schema: results.read_latest_metrics(spark, out, schema).where(F.col("kind") == f"new_{kind}").collect()
    assert [r.accuracy for r in read("overall", "accuracy double")] == [9 / 20]
    assert [(r.review_id, r.label_error) for r in read("failures", "review_id string, label_error string")] == [("16", "RuntimeError: no answer")]
    assert len(read("errors", "review_id string")) == 11


def test_orders_job(spark, tmp_path):
    reviews = [(f"r{i}", f"o{i}", 1 + i % 3, f"late, \"again\"\n{i}") for i in range(30)]
    orders = [(f"o{i}", str(NEWEST - timedelta(days=i))) for i in range(30)]
    tables.write_csv(spark.createDataFrame(reviews, "review_id string, order_id string, review_score int, review_comment_message string"), str(tmp_path / "r"))
    tables.write_csv(spark.createDataFrame(orders, "order_id string, order_purchase_timestamp string"), str(tmp_path / "o"))
    out = jobs.analyze_orders_csv(spark, str(tmp_path / "r"), str(tmp_path / "o"), str(tmp_path / "out"), "r1", NEWEST)
    found = results.read_latest_metrics(spark, out, "total_reviews bigint, negative_reviews bigint").where("kind = 'stats'").first()
    assert (found.total_reviews, found.negative_reviews) == (30, 30)


@pytest.mark.parametrize("ids, kept", [([9, 10, 100], "good"), (["b9", "b10", "a100"], "bad")])
def test_training_files_keep_the_smallest_id(spark, tmp_path, ids, kept):
    """Ids of a CSV are text; 9 still comes before 10."""
    kind = "bigint" if isinstance(ids[0], int) else "string"
    rows = [(ids[0], "same", 1.0, "good"), (ids[1], "same", 1.0, "bad"), (ids[2], "same", 1.0, "bad")]
    sample = spark.createDataFrame(rows, f"review_id {kind}, review_text string, rating double, manual_label string").withColumn("notes", F.lit(""))
    path = tables.write_labeling_csv(sample, str(tmp_path / "labels"))
    files = jobs.training_files_csv(spark, path, str(tmp_path / "out"), ["good", "bad"])
    lines = [r.value for name in ("train", "valid") for r in spark.read.text(files[name]).collect()]
    assert len(lines) == 1 and f'"content":"{kept}"' in lines[0]
