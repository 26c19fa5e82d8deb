"""Operator 5: the forward algorithm against all cuts, and held-out accuracy."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plaintide.llm import language_id
from plaintide.llm.language_id import Unigrams
from plaintide.llm.queries import QUERIES

from .conftest import PIECES, TABLES


def cuts(word):
    if not word:
        return [[]]
    return [[word[:i], *rest] for i in range(1, len(word) + 1) for rest in cuts(word[i:])]


def test_score_sums_all_cuts():
    table = {"▁": (.1, .2), "▁a": (.05, .01), "a": (.1, .3), "b": (.2, .1), "ab": (.05, .2), "ba": (.01, .02), "bab": (.02, .001)}
    model = Unigrams(table, ["x", "y"])
    for word in ("a", "ab", "abab", "babba", "cab"):
        for i in (0, 1):
            p = lambda piece: table[piece][i] if piece in table else language_id.FLOOR if len(piece) == 1 else 0.0
            want = sum(math.prod(map(p, cut)) for cut in cuts("▁" + word))
            assert math.isclose(model.score(word)[i], math.log(want), rel_tol=1e-9)


def test_expected_counts_sum_all_cuts():
    table = {"▁": (.1,), "▁a": (.05,), "a": (.1,), "b": (.2,), "ab": (.05,)}
    model, got = Unigrams(table, ["x"]), dict.fromkeys(table, 0.0)
    model.expected("abab", 0, got, 3.0)
    weights = [(cut, math.prod(table.get(p, (0.0,))[0] for p in cut)) for cut in cuts("▁abab")]
    total = sum(w for _, w in weights)
    for piece in table:
        assert math.isclose(got[piece], 3 * sum(w * cut.count(piece) for cut, w in weights) / total, rel_tol=1e-9, abs_tol=1e-12)


def test_held_out_accuracy(spark, docs):
    found = QUERIES["op5_language_id"](spark, TABLES).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 20 and right / n > 0.97


def test_hard_rows(hard, nothing):
    model = language_id.train(hard, PIECES, rounds=2)
    assert model.languages == ["de", "en", "fr"]
    found = language_id.predict(hard, model, keep=("text",)).collect()
    assert len(found) == hard.count()
    for r in found:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in model.languages and 0 <= r.score <= 1
    by = {r.text: r.lang_pred for r in found if r.text}
    assert [v for k, v in by.items() if k.startswith(("le rapport", "der bericht"))] in (["fr", "de"], ["de", "fr"])
    empty = language_id.train(nothing, PIECES)
    assert empty.languages == []
    assert {r.lang_pred for r in language_id.predict(hard, empty).collect()} == {"und"}
    assert language_id.predict(nothing, model).collect() == []


def test_words_are_learnt_once_and_from_shared_starts(monkeypatch):
    table = {"▁": (.1, .2), "a": (.1, .3), "b": (.2, .1), "ab": (.05, .2), "▁ab": (.02, .001)}
    model, read = Unigrams(table, ["x", "y"]), []
    model.score("a")
    after = model.endings.after
    monkeypatch.setattr(model.endings, "after", lambda state, letter: read.append(letter) or after(state, letter))
    texts = [["abab", "ababc", "b"], [], ["ababc", "abab"]]
    found = model.predict_all(texts)
    # The mark, "abab" and one "c" after it, and "b".
    assert len(read) == 7
    assert found == [Unigrams(table, ["x", "y"]).predict(words) for words in texts]
    assert found[1] == ("und", 0.0)


def test_forgetting_words_changes_nothing(monkeypatch):
    table = {"▁": (.1, .2), "a": (.1, .3), "b": (.2, .1), "ab": (.05, .2)}
    texts = [["a"], ["ab", "ba"], ["a", "abba"], ["bab"], ["ab"]]
    want = Unigrams(table, ["x", "y"]).predict_all(texts)
    monkeypatch.setattr(language_id, "REMEMBERED", 2)
    model = Unigrams(table, ["x", "y"])
    assert [model.predict(words) for words in texts] == want
