"""Labelers of the caller's, their failures, and words found by one automaton."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plaintide.functions.scoring import keyword_factor
from plaintide.operators import labelers
from plaintide.operators.labeling import label_by_rules


def found(df):
    return {r.review_id: (r.category, r.label_error) for r in df.collect()}


@pytest.fixture
def rows(spark):
    data = [(i, None if i == 3 else f"text {i}") for i in range(20)]
    return spark.createDataFrame(data, "review_id bigint, review_text string").repartition(3)


def test_labels_and_columns(rows):
    def make():
        seen = []  # once for each task

        def label(batch):
            seen.append(batch.num_rows)
            assert batch.schema.names == ["review_id", "review_text"] and batch.num_rows <= 4
            texts = batch.column("review_text").to_pylist()
            return pa.table({"size": [len(t or "") for t in texts], "category": [t and t.upper() for t in texts]})

        return label

    labeled = labelers.label_with(rows, make, "category string, size bigint", rows=4)
    assert labeled.columns == ["review_id", "review_text", "category", "size", "label_error"]
    assert sorted((r.review_id, r.category, r.size, r.label_error) for r in labeled.collect()) == [
        (i, None if i == 3 else f"TEXT {i}", 0 if i == 3 else len(f"text {i}"), None) for i in range(20)]


def test_failing_rows(rows):
    def make():
        def label(batch):
            texts = batch.column("review_text").to_pylist()
            return ["k" + re.fullmatch(r"text (\d)", t).group(1) for t in texts]

        return label

    got = found(labelers.label_with(rows, make))
    assert {i for i, (_, error) in got.items() if error} == {3, *range(10, 20)}
    assert got[5] == ("k5", None) and got[12][1].startswith("AttributeError") and got[3][1].startswith("TypeError")


@pytest.mark.parametrize("label, reason", [
    (lambda batch: ["a"] * (batch.num_rows + 1), "gave 2 labels for 1 rows"),
    (lambda batch: [object()] * batch.num_rows, "Arrow"),
    (lambda batch: pa.table({"other": ["a"] * batch.num_rows}), "no column category"),
])
def test_wrong_answers(rows, label, reason):
    got = found(labelers.label_with(rows, lambda: label))
    assert len(got) == 20 and all(c is None and reason in e for c, e in got.values())


def test_labeler_that_cannot_be_made(rows):
    def make():
        raise OSError("no model")

    assert set(found(labelers.label_with(rows, make)).values()) == {(None, "OSError: no model")}
    assert labelers.label_with(rows.limit(0), make).count() == 0
    with pytest.raises(ValueError, match="already"):
        labelers.label_with(rows.withColumn("category", F.lit("x")), make)


def test_words_like_patterns(spark):
    """Random words, some inside others and some equal, against the rules by patterns and plain regular expressions."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 4)))
    for _ in range(3):
        rules = {f"c{i}": [word() for _ in range(rng.randrange(1, 5))] for i in range(4)} | {"none": []}
        texts = ["".join(rng.choice("abcÉé B.") for _ in range(rng.randrange(14))) for _ in range(300)] + [None]
        frame = spark.createDataFrame(list(enumerate(texts)), "review_id bigint, review_text string")
        key = lambda r: (r.review_id, r.category, r.rule_hits)
        full = {k: v for k, v in rules.items() if v}
        expected = sorted(map(key, label_by_rules(frame, full).collect()))
        assert sorted(map(key, labelers.label_by_many_words(frame, rules).collect())) == expected
        lowered = frame.withColumn("review_text", F.lower(F.coalesce("review_text", F.lit(""))))
        hooked = labelers.label_with(lowered, labelers.rules_labeler(rules), "category string, rule_hits int", ["review_text"])
        assert sorted(map(key, hooked.collect())) == expected
        hits = labelers.find_words(frame, list(rules.values())).collect()
        for r in hits:
            for words, got in zip(rules.values(), r.word_hits):
                plain = list(re.finditer("|".join(map(re.escape, words)), (r.review_text or "").lower())) if words else []
                assert (got.hits, got.first) == (len(plain), plain[0].start() if plain else -1)
        points = labelers.keyword_points(frame, rules["c0"], rules["c1"]).select("review_id", "keyword_score")
        assert sorted(map(tuple, points.collect())) == sorted(map(tuple, frame.select(
            "review_id", keyword_factor(F.col("review_text"), rules["c0"], rules["c1"])).collect()))


def test_no_words(spark):
    frame = spark.createDataFrame([(1, "x")], "review_id bigint, review_text string")
    assert labelers.label_by_many_words(frame, {"a": []}).first().category == "other"
    assert labelers.find_words(frame, []).first().word_hits == []
    with pytest.raises(ValueError, match="empty word"):
        labelers.find_words(frame, [[""]])
