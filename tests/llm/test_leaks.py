"""Operators 2 and 4 against brute force."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from plaintide.llm import decontamination, licences
from plaintide.llm.decontamination import Items, plain
from plaintide.llm.licences import TEMPLATES, bigrams, words
from plaintide.llm.queries import QUERIES

from .conftest import TABLES, hard_rows


def distance(pattern, text):
    """Least edits between the pattern and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edits_up_to_the_budget(spark):
    rng = random.Random(5)
    texts = [r.text for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").orderBy("item_id").limit(12).collect()]
    items = Items(list(range(len(texts))), texts, 10, 0.08)
    for _ in range(60):
        i = rng.randrange(len(texts))
        letters = list(texts[i])
        for _ in range(rng.randint(0, items.edits[i] + 3)):
            at = rng.randrange(len(letters))
            letters[at:at + 1] = rng.choice([["z"], [letters[at], "q"], []])
        text = "Some words before. " * rng.randint(0, 3) + "".join(letters) + " and after" * rng.randint(0, 3)
        want = distance(list(items.codes[i]), list(plain(text)[0]))
        found = [h for h in items.search([plain(text)])[0] if h[0] == i]
        assert bool(found) == (want <= items.edits[i])
        assert not found or min(h[3] for h in found) == want


def test_windows_change_nothing(spark, monkeypatch):
    """Many repeats, and passages on every border of small windows."""
    rng = random.Random(7)
    texts = ["ab" * 30, "a" * 45, "the quick brown fox jumps over the lazy dog and runs away", "abcabcabd" * 9]
    items = Items(list(range(len(texts))), texts, 10, 0.08)
    documents = [plain("".join(rng.choice([*texts, "x", "a" * 7, "ab" * 11, " fox jumps over "]) for _ in range(rng.randrange(1, 14)))) for _ in range(25)]
    want = items.search(documents)
    assert sum(map(len, want)) > 100
    monkeypatch.setattr(decontamination, "ROWS", 0)
    for size in (1, 300, 1 << 13):
        monkeypatch.setattr(decontamination, "WINDOW", size)
        assert items.search(documents) == want


@pytest.mark.parametrize("part, item, count", [("a", "a" * 300, (1 << 18) - 299), ("1,", "a" * 300, 0), ("ab", "ab" * 100 + "c", 0), ("\t", "b" * 60, 0)])
def test_long_texts_of_one_thing(part, item, count):
    items = Items([1], [item], 10, 0.08)
    text = part * ((1 << 18) // len(part))
    begin = time.perf_counter()
    found = items.search([plain(text)])[0]
    assert time.perf_counter() - begin < 60
    assert sum(f[3] == 0 for f in found) == count


def test_query_finds_what_is_there(spark, docs):
    items = spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items if i.text in d.text}
    found = QUERIES["op4_decontamination"](spark, TABLES)
    assert want <= {(r.doc_id, r.item_id) for r in found.collect()}
    texts, passages = {d.doc_id: d.text for d in docs.collect()}, {i.item_id: i.text for i in items}
    for r in found.collect():
        if r.distance == 0:
            assert list(plain(texts[r.doc_id][r.start:r.end])[0]) == list(plain(passages[r.item_id])[0])


def test_hard_leaks(hard, nothing, spark, monkeypatch):
    items = [(1, hard_rows()[0][1].upper()), (2, None), (3, ""), (4, "..."), (5, "123"), (5, "123"), (None, "x" * 40)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    want = None
    for size in (500_000, 60):  # in one block, in several
        monkeypatch.setattr(decontamination, "BLOCK_CHARACTERS", size)
        found = decontamination.leaks(hard, benchmark, keep=("text",)).collect()
        assert len(found) == len(hard_rows())
        got = sorted(repr((r.doc_id, r.text[:20] if r.text else r.text, sorted({(x.item_id or 0, x.start) for x in r.leaks})[:50])) for r in found)
        assert want in (None, got)
        want = got
    by = {r.doc_id: {x.item_id for x in r.leaks} for r in found}
    assert by[1] == by[10] == by[8] == {1} and by[9] == {5} and by[7] == {None} and by[2] == by[3] == by[5] == set()
    assert sum(x.item_id == 5 for r in found for x in r.leaks if r.doc_id == 9) == 1
    assert decontamination.leaks(nothing, benchmark).collect() == []
    assert all(r.leaks == [] for r in decontamination.leaks(hard, benchmark.where("false")).collect())


def brute_licences(rows):
    known, out = {n: bigrams(words(t)) for n, t in TEMPLATES.items()}, []
    for i, text in rows:
        if not text:
            continue
        paragraphs = re.split(r"\n[\x20\t\r]*\n", text)
        parts = [("line", k, x) for k, x in enumerate(text.split("\n"))] + [("paragraph", k, x) for k, x in enumerate(paragraphs) if "\n" in x]
        for scope, k, x in parts + ([("text", 0, text)] if len(paragraphs) > 1 else []):
            have = bigrams(words(x))
            best = max(((2 * len(have & b) / (len(have) + len(b)), n) for n, b in sorted(known.items())), key=lambda z: z[0])
            if have and best[0] * 100 >= 80:
                out.append((i, scope, k, best[1], round(best[0], 9)))
    return sorted(out, key=repr)


def listed(df):
    return sorted(((r.doc_id, r.scope, r.part, r.licence, round(r.dice, 9)) for r in df.collect()), key=repr)


def test_licences(spark, docs, hard, nothing):
    assert listed(QUERIES["op2_licences"](spark, TABLES)) == brute_licences([(r.doc_id, r.text) for r in docs.collect()])
    mit, isc = TEMPLATES["mit"], TEMPLATES["isc"].replace("fee", "charge")
    rows = [(1, "Copyright 2020 X\n\n" + mit), (2, mit.replace("\n", " ")), (2, mit.replace("\n", " ")), (3, "x\n\n" + isc + "\n\nmore"), (4, "License"),
            (None, "ALL   rights\treserved!!"), (5, "released under mit license"), (6, None), (7, ""), (8, mit[:700])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("part", F.lit("own"))
    assert listed(licences.licences(df)) == brute_licences(rows)
    assert listed(licences.licences(hard)) == [] == licences.licences(nothing).collect()
