"""Ranks by any key: against plain sorting, and what meets in one task."""

import random

import pytest
from pyspark.sql import functions as F

from plaintide.operators import positions


@pytest.mark.parametrize("key", ["xxhash64(id)", "cast(id % 1000 * 1000003 - id as bigint)", "md5(cast(id as string))", "timestamp_seconds(id * 977 % 100003)"])
def test_any_key(spark, key):
    frame = spark.range(3000).select("id", F.expr(key).alias("key")).repartition(5)
    expected = {r.id: place for place, r in enumerate(sorted(frame.collect(), key=lambda r: r.key))}
    placed = positions.with_position(frame, "key", rows_per_block=100)
    assert placed.columns == ["id", "key", "position"]
    assert {r.id: r.position for r in placed.collect()} == expected


def test_few_rows_meet_in_the_running_sum(spark):
    frame = spark.range(20000).select(F.expr("xxhash64(id)").alias("key"))
    cuts = positions.splitters(frame, ["key"], rows_per_block=500)
    assert 30 <= len(cuts) <= 40 and cuts == sorted(cuts)
    tagged = frame.withColumn("_block", positions.block_of(frame, ["key"], cuts))
    counts = tagged.groupBy("_block").count().collect()
    assert len(counts) == positions.block_offsets(tagged).count() == len(cuts) + 1
    assert max(r["count"] for r in counts) < 4 * 500
    assert len(positions.splitters(frame, ["key"], rows_per_block=1, most_blocks=8)) <= 8


def test_groups_nulls_and_ties(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2, 3]), i) for i in range(2000)] + [("c", 5, 2000)]
    frame = spark.createDataFrame(rows, "g string, key int, id int")
    expected = {}
    for g, key, i in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2])):
        expected[i] = sum(1 for j in expected if rows[j][0] == g)
    placed = positions.with_position(frame, ["key", "id"], "place", group=["g"], rows_per_block=50)
    assert {r.id: r.place for r in placed.collect()} == expected


def test_empty_and_single(spark):
    assert positions.with_position(spark.range(0), "id").count() == 0
    assert positions.with_position(spark.range(7, 8), "id").collect()[0].position == 0


def test_chunks_of_random_keys(spark):
    frame = spark.range(1005).select(F.expr("xxhash64(id)").alias("key"))
    chunks = positions.chunk_requests(frame, "key", 10).orderBy("key").collect()
    assert [r.batch for r in chunks] == [i // 10 for i in range(1005)]
    assert [r.review_index for r in chunks] == [i % 10 + 1 for i in range(1005)]


def test_texts_are_ranked_in_smaller_ranges(spark):
    """Rows that carry texts do not meet in one task long before rows of numbers would."""
    frame = spark.range(30000).select(F.expr("id * 7 % 30011").alias("key"), F.expr("repeat('x', 10)").alias("text"))
    placed = positions.with_position(frame, "key")
    assert "_block" in placed._jdf.queryExecution().analyzed().toString()
    assert "_block" not in positions.with_position(frame.select("key"), "key")._jdf.queryExecution().analyzed().toString()
    wrong = placed.join(frame.select("key").withColumn("below", F.col("key")), "key").where("position > key or position < key - 11")
    assert placed.count() == 30000 and wrong.count() == 0
    assert placed.agg(F.countDistinct("position"), F.max("position")).first() == (30000, 29999)
