"""Operators 6 and 10: statistics against plain code, outliers and rules."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from plaintide.llm import quality_classifier, quality_rules
from plaintide.llm.queries import QUERIES
from plaintide.llm.statistics import text_statistics

from .conftest import TABLES, hard_rows

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    words, seen = re.findall(WORD, text), set()
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    for i, w in enumerate(windows):
        if counts[w] > 1:
            seen.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(seen)


def numbers(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_statistics(docs, hard, nothing):
    for df in (docs, hard):
        for r in text_statistics(df, keep=("text",)).collect():
            assert numbers(r) == plain(r.text or "")
    assert text_statistics(nothing).collect() == []


def test_chi_squared():
    assert abs(quality_rules.chi2_quantile(0.95, 4) - 9.4877) < 1e-3
    assert abs(quality_rules.chi2_below(12.592, 6) - 0.95) < 1e-4


def test_query(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = QUERIES["op6_quality_rules"](spark, TABLES).collect()
    assert len(found) == len(texts)
    for r in found:
        want = plain(texts[r.doc_id])
        assert numbers(r) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)


def test_outliers_do_not_hide_each_other(spark):
    rng = np.random.default_rng(3)
    clean = [(i, " ".join("abcdefgh"[:n] + str(i) for n in rng.integers(2, 9, 80)), "en", None) for i in range(200)]
    # A fifth of the group is alike and far off: mean and covariance of all rows would follow it.
    odd = [(1000 + i, " ".join("abcdefgh"[:n] + "###" + str(i) for n in rng.integers(2, 9, 80)), "en", None) for i in range(50)]
    small = [(2000 + i, "### " * 30 + " ".join(f"w{j}" for j in range(300)), "fr", "s") for i in range(3)]
    df = spark.createDataFrame(clean + odd + small, "doc_id bigint, text string, lang string, source string")
    found = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert all(found[i].kept for i in range(200))
    assert not any(found[1000 + i].kept for i in range(50))
    # Three rows are no group to learn from: base rules alone.
    assert all(found[2000 + i].distance is None and found[2000 + i].kept for i in range(3))


def test_hard_rows(hard, nothing):
    found = quality_rules.quality_rules(hard, least_rows=3).collect()
    assert len(found) == len(hard_rows())
    assert quality_rules.quality_rules(nothing).collect() == []


def test_classifier(spark):
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    found = QUERIES["op10_quality_classifier"](spark, TABLES).join(labels, "doc_id").toPandas()
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.7)).all()
    held = found[found.held_out]
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert len(bad) and np.mean(good.to_numpy()[:, None] > bad.to_numpy()[None, :]) > 0.9


def test_rules_are_paths():
    printed = """RandomForestClassificationModel: uid=x, numTrees=1
  Tree 0 (weight 1.0):
    If (feature 3 <= 0.5)
     If (feature 1 <= 2.0)
      Predict: 1.0
     Else (feature 1 > 2.0)
      Predict: 0.0
    Else (feature 3 > 0.5)
     Predict: 0.0
"""
    first, second = (3, "<=", 0.5), (1, "<=", 2.0)
    assert quality_classifier.paths(printed) == {(first,), (second, first), ((1, ">", 2.0), first), ((3, ">", 0.5),)}


def test_classifier_without_labels(hard, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (None, 0), (99, 0)], "doc_id bigint, quality int")
    for some in (labels, labels.where("false")):
        found, fitted = quality_classifier.quality_classifier(hard, some)
        assert found.count() == len(hard_rows()) and fitted.rules == ()
        assert found.where(F.col("score").between(0, 1)).count() == len(hard_rows())
    assert quality_classifier.quality_classifier(nothing, labels)[0].collect() == []
