"""Spelling variants against brute force over all pairs."""

import random
import zlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaintide.llm import spelling

from .conftest import hard_rows


def plain_words(rows, one_in=199, least=6):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if code % one_in == 0:
                at = code % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= least:
                counts[run] = counts.get(run, 0) + 1
    return counts


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_variants(counts):
    forms, out = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best and counts[best] >= 5 * n else None
        out[w] = (n, len(near))
    def root(w):
        while forms[w]:
            w = forms[w]
        return w
    return {w: (n, near, forms[w], counts[forms[w]] if forms[w] else None, root(w)) for w, (n, near) in out.items()}


def got(words):
    rows = spelling.spelling_variants(words).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def test_vocabulary(spark, docs, hard):
    for frame, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (hard, [r[:2] for r in hard_rows()])):
        for one_in in (199, 3):
            expected = {w: n for w, n in plain_words(rows, one_in).items() if n >= 5}
            assert {r.word: r.n for r in spelling.vocabulary(frame, one_in=one_in).collect()} == expected


@pytest.mark.parametrize("letters", ["ab", "aeé", "abcdefghÀÿß"])
def test_all_pairs(spark, letters):
    """Few letters, so that most words are near many; counts that make chains of forms and ties."""
    rng = random.Random(len(letters))
    counts = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))): 5 ** rng.randrange(1, 7) for _ in range(250)}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    expected = plain_variants(counts)
    assert got(words) == expected
    assert any(root != form for _, _, form, _, root in expected.values() if form) or letters != "ab"


def test_documents(spark, docs):
    counts = {w: n for w, n in plain_words([(r.doc_id, r.text) for r in docs.collect()]).items() if n >= 5}
    frame = spelling.vocabulary(docs)
    assert got(frame) == plain_variants(counts)


def test_hard_rows(hard, nothing):
    counts = {w: n for w, n in plain_words([r[:2] for r in hard_rows()]).items() if n >= 5}
    assert got(spelling.vocabulary(hard)) == plain_variants(counts)
    assert got(spelling.vocabulary(nothing)) == {}


def test_long_words(spark):
    """Words of a hundred thousand letters, one edit apart."""
    word = "xyzé" * 25000
    rows = [(i, f"{word} {word}q {word[:50000]}{word[50001:]}") for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = got(spelling.vocabulary(frame, one_in=1 << 40))
    assert {w: v[1] for w, v in found.items()} == {word: 2, word + "q": 1, word[:50000] + word[50001:]: 1}


def test_neighbours_are_all():
    for word in ("a", "abca", "ffffff"):
        symbols = [chr(ord("a") + i) for i in range(spelling.SYMBOLS)]
        every = {word} | {word[:i] + s + word[i:] for i in range(len(word) + 1) for s in symbols} \
            | {word[:i] + s + word[i + 1:] for i in range(len(word)) for s in [*symbols, ""]}
        expected = sorted(int(spelling.codes([w], len(w))[0]) for w in every)
        assert [int(c) for c in spelling.neighbours([word], len(word))[0]] == expected
    assert spelling.neighbours(["ab", "ba"], 2)[1].dtype == np.uint64


def test_one_edit(spark, monkeypatch):
    """Both ways of comparing against the plain rule."""
    rng = random.Random(2)
    words = ["", *["".join(rng.choice("aé") for _ in range(rng.randrange(1, 7))) for _ in range(60)]]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for most in (64, 0):
        monkeypatch.setattr(spelling, "LONG", most)
        for r in pairs.select("a", "b", spelling.one_edit(F.col("a"), F.col("b")).alias("near")).collect():
            assert r.near == one_edit(r.a, r.b), r


def test_reduced(spark):
    row = spark.createDataFrame([("azÀÿß",)], "w string").select(spelling.reduced(F.col("w")).alias("r")).first()
    assert len(row.r) == 5 and set(row.r) <= {chr(ord("a") + i) for i in range(spelling.SYMBOLS)}
