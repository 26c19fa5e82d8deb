"""What the plans of the named queries must and must not contain."""

import pytest

from plaintide.plans import catalog
from tests.conftest import TABLES

ALL = catalog.QUERIES
WRITERS = {name for name in ALL if name.startswith(("write_", "read_reviews_csv"))}


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(ALL) - WRITERS))
def test_no_pair_products(spark, name):
    plan = plan_of(ALL[name](spark, TABLES))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


@pytest.mark.parametrize("name", [
    "extract_reviews_from_text", "label_by_rules", "priority_score", "ingest_vote_responses", "text_preview",
    "detect_platform", "filter_level", "normalize_review_schema", "response_quarantine",
])
def test_row_work_does_not_shuffle(spark, name):
    assert "Exchange" not in plan_of(ALL[name](spark, TABLES))


@pytest.mark.parametrize("name", ["knn_retrieve", "knn_retrieve_cells"])
def test_neighbours_stay_in_batches(spark, name):
    plan = plan_of(ALL[name](spark, TABLES))
    assert "MapInPandas" in plan
    assert ("Exchange" in plan) == (name == "knn_retrieve_cells")


@pytest.mark.parametrize("name", ["first_k_examples", "newest_sample_per_group", "dedup_text", "confusion_keywords"])
def test_groups_are_cut_before_the_shuffle(spark, name):
    plan = plan_of(ALL[name](spark, TABLES))
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("name", ["newest_sample", "priority_top", "sample_for_labeling", "emerging_issues", "paginate_reviews"])
def test_top_k_is_no_full_sort(spark, name):
    assert "TakeOrderedAndProject" in plan_of(ALL[name](spark, TABLES))


def test_filters_reach_the_scan(spark):
    from plaintide.operators.filters import filter_negative

    lines = spark.read.parquet(f"{TABLES}/lineitem.parquet")
    plan = plan_of(filter_negative(lines, 3, "l_quantity").select("l_orderkey"))
    assert "LessThanOrEqual(l_quantity,3.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
