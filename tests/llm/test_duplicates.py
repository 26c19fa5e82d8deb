"""Operators 3 and 7 against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaintide.llm import ngram_join, passages
from plaintide.llm.common import saved
from plaintide.llm.components import components
from plaintide.llm.queries import QUERIES

from .conftest import TABLES, hard_rows


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingle_sets(rows, size=3):
    out = {}
    for i, text in rows:
        w = tokens(text)
        out[i] = frozenset(tuple(w[j:j + size]) for j in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    return out


def brute_components(rows, size=3, percent=90):
    sets, index = shingle_sets(rows, size), defaultdict(list)
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in index[x]:
                shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def families():
    """Three families around an original, texts under one common heading, and very short texts."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, "a"), (3, "A b"), (4, "a B"), (5, "a")]
    for _ in range(3):
        base = rng.choices(words, k=150)
        for _ in range(100):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(w))
                w[at:at + 1] = rng.choice([[rng.choice(words) + "x"], [], [w[at], f"new{rng.randrange(10**6)}"]])
            rows.append((len(rows) + 10, rng.choice([" ", "\n"]).join(w)))
    for _ in range(100):
        own = " ".join(f"r{rng.randrange(10**6)}" for _ in range(rng.randint(5, 80)))
        rows.append((len(rows) + 10, "the same heading stands here on top of it all " + own))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [2, 32])
def test_components_of_families(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    rows = families()
    out, _ = ngram_join.shingle_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert found(out) == brute_components(rows)


def test_query(spark, docs):
    assert found(QUERIES["op7_ngram_join"](spark, TABLES)) == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_tree_walk():
    rng = np.random.default_rng(4)
    for _ in range(40):
        probe = np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64))
        sets = [np.unique(np.concatenate([rng.permutation(probe)[:rng.integers(0, len(probe) + 1)], rng.integers(0, 60, rng.integers(0, 5)).astype(np.uint64)]))
                for _ in range(30)]
        sets = [s for s in sets if len(s)]
        for percent in (50, 90):
            want = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= percent * len(np.union1d(s, probe))]
            assert ngram_join.walk(probe, sets, percent) == want


def test_tree_walk_reads_little():
    """Unrelated sets are left after their first members, and what many sets begin with is read once."""
    rng = np.random.default_rng(5)
    draw = lambda n: np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
    probe, sets, read = draw(500), [draw(500) for _ in range(256)], []
    assert ngram_join.walk(probe, sets, 90, read) == [] and sum(read) < 256 * 500 / 4
    alike, read = [np.concatenate([probe[:480], np.uint64(1 << 63) + np.arange(20 + i, dtype=np.uint64) * np.uint64(7 + i)]) for i in range(100)], []
    want = [i for i, s in enumerate(alike) if 100 * 480 >= 90 * (len(s) + 500 - 480)]
    assert ngram_join.walk(probe, alike, 90, read) == want and sum(read) < 100 * 500 / 4


def test_hard_rows(hard, nothing):
    out = ngram_join.shingle_components(hard)[0].collect()
    assert len(out) == len(hard_rows())
    by = {r.doc_id: r for r in out}
    assert by[10].component_id == by[1].component_id == 1 and by[None].component_id in (None, 1)
    assert (by[2].n_shingles, by[2].component_id) == (0, 2) and (by[3].n_shingles, by[3].component_id) == (0, 3)
    assert ngram_join.shingle_components(nothing)[0].collect() == []


def test_components_of_chains(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100)] + [(200 + i, 200) for i in range(50)] + [(300, 300), (None, 3), (5, 4), (5, 4)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{200 + i: 200 for i in range(50)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("few", [True, False])
def test_components_of_random_links(spark, few):
    rng = random.Random(7)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    links += [(400 + i, 400 + 20 * j) for i in range(60) for j in range(3) if rng.random() < 0.5]
    want = {x: x for ab in links for x in ab if ab[0] != ab[1]}
    for _ in links:
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint"), few=few).collect()}
    assert got == want


def test_links_between_components(spark):
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)], "k bigint, component bigint")
    between = spark.createDataFrame([(2, 4), (9, 8), (7, 6)], "ka bigint, kb bigint")
    got = {r.k: r.component for r in ngram_join._merged(found, between).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5, 8: 8, 9: 8}


def test_filter_bits(spark):
    places = [0, 5, 5, 32767, 32768, ngram_join.FILTER - 1]
    got = ngram_join._bitmap(spark.createDataFrame([(p,) for p in places], "h bigint"))
    assert len(got) == ngram_join.FILTER and np.flatnonzero(got).tolist() == sorted(set(places))


def test_compact_windows():
    rng = np.random.default_rng(1)
    for n, t in ((10, 20), (20, 20), (21, 20), (100, 7), (300, 20), (64, 1)):
        toks = rng.integers(0, 40 if n == 100 else 10**9, n).astype(np.uint64)
        _, centre, left, right = passages.compact_windows(toks, t, 2)
        key = ((ngram_join._mix(toks ^ passages._SEEDS[2]) >> np.uint64(20) << np.uint64(20)) | np.arange(n, dtype=np.uint64)).tolist()
        want = []
        for i in range(n):
            a = b = i
            while a > 0 and key[a - 1] > key[i]:
                a -= 1
            while b < n - 1 and key[b + 1] > key[i]:
                b += 1
            if b - a + 1 >= t:
                want.append((a, i, b))
        assert list(zip(left.tolist(), centre.tolist(), right.tolist())) == want


def test_texts_together_are_as_alone(docs):
    texts = ["", "a b c", *(r.text for r in docs.limit(20).collect()), "x " * 200, "\n\n", "one two three four five"]
    toks, begins = passages.sequences(texts)
    for i, text in enumerate(texts):
        assert toks[begins[i]:begins[i + 1]].tolist() == passages.sequence(text).tolist()
    for f in (0, 3):
        together = passages.compact_windows(toks, 20, f, begins)
        rows = set(zip(*(x.tolist() for x in together)))
        alone = set()
        for i, text in enumerate(texts):
            g, *places = passages.compact_windows(passages.sequence(text), 20, f)
            alone |= set(zip(g.tolist(), *((p + begins[i]).tolist() for p in places)))
        # Ties go by place modulo a power of two, which differs; texts without ties are the same.
        assert rows == alone or len(rows ^ alone) < 4
        assert passages.compact_windows(toks, 20, f, begins, True)[1].tolist() == together[1].tolist()


def test_passages(spark, docs):
    rows = {r.doc_id: tokens(r.text) for r in docs.collect()}
    runs = defaultdict(set)
    for i, w in rows.items():
        for k in range(len(w) - 50):
            runs[tuple(w[k:k + 51])].add(i)
    repeated = {i for s in runs.values() if len(s) > 1 for i in s}
    got = QUERIES["op3_passages"](spark, TABLES).collect()
    assert repeated and repeated <= {r.doc_id for r in got} | {r.like_id for r in got}
    for r in got:
        a, b = rows[r.doc_id][r.start:r.start + r.n_words], rows[r.like_id][r.like_start:r.like_start + r.like_words]
        x, y = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert abs(len(x & y) / len(x | y) - r.similarity) < 1e-9 and r.similarity >= 0.8 and min(len(a), len(b)) >= 50


def test_planted_passages(spark, hard, nothing):
    rng = random.Random(8)
    own = lambda n: [f"u{rng.randrange(10**7)}" for _ in range(n)]
    passage, other = own(60), own(120)
    near = list(other)
    for at in (10, 60, 110):
        near[at] = "changed"
    rows = [(i, " ".join([*own(rng.randint(0, 80)), *passage, *own(rng.randint(0, 80))])) for i in range(40)]
    rows += [(100, " ".join(own(30) + other)), (101, " ".join(near + own(30))), (102, " ".join(own(300))), (103, " ".join(passage[:40] + own(100)))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id for r in got if r.like_id == 0} == set(range(1, 40)) and len(got) == 40
    place = {i: text.split().index(passage[0]) for i, text in rows if i < 40}
    assert all((r.start, r.n_words) == (place[r.doc_id], 60) for r in got if r.like_id == 0)
    assert [(r.doc_id, r.like_id) for r in got if r.like_id != 0] == [(101, 100)]
    # Ids 1 and 1 are one text; 8 repeats a shorter text than a passage; 10 is as short.
    assert passages.repeated_passages(hard, least_words=20).where(F.col("doc_id") == 10).count() == 1
    assert passages.repeated_passages(nothing).collect() == []


def test_passages_behind_a_shorter_first_text(spark):
    rng = random.Random(21)
    own = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for k in range(40):
        passage, first = own(50), 100 * k
        rows.append((first, " ".join([*own(60), *passage[:(30, 40, 45, 48)[k % 4]], *own(60)])))
        rows += [(first + i, " ".join([*own(60), *passage, *own(60)])) for i in range(1, 5)]
        want |= {first + i: first + 1 for i in range(2, 5)}
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.like_id for r in got} == want and len(got) == len(want)
    assert all((r.start, r.n_words, r.like_start, r.similarity) == (60, 50, 60, 1.0) for r in got)


def test_passages_of_ids_with_one_hash(spark):
    rng = random.Random(23)
    own = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage = own(80)
    rows = [(i, " ".join([*own(30), *passage, *own(30)])) for i in (-5155911707605380554, -4823705812181403090)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert frame.select(F.hash("doc_id")).distinct().count() == 1
    got = passages.repeated_passages(frame).collect()
    assert [(r.doc_id, r.like_id, r.start, r.n_words) for r in got] == [(rows[1][0], rows[0][0], 30, 80)]


def test_passages_with_a_block_replaced(spark):
    rng = random.Random(22)
    own = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    for size, at in ((84, 40), (84, 38), (90, 46), (160, 40), (80, 48)):
        passage = own(size)
        near = passage[:at] + own(4) + passage[at + 4:]
        a, b = passages.sequence(" ".join(own(50) + passage + own(50))), passages.sequence(" ".join(own(20) + near + own(50)))
        ends = (50, 50 + size - 4), (20, 20 + size - 4)
        x, y = set(a[slice(*ends[0])].tolist()), set(b[slice(*ends[1])].tolist())
        jaccard = len(x & y) / len(x | y)
        assert jaccard >= 0.8
        assert passages.verify(a, b, (0, len(a)), (0, len(b)), 46, 0.8) == [(*ends[0], *ends[1], jaccard)]
    rows = []
    for k in range(0, 60, 2):
        passage = own(84)
        rows += [(k, " ".join(own(30) + passage + own(40))), (k + 1, " ".join(own(50) + passage[:40] + own(4) + passage[44:] + own(20)))]
    got = {(r.like_id, r.doc_id) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    # The chance that enough min-hashes agree is not 1.
    assert got <= {(k, k + 1) for k in range(0, 60, 2)} and len(got) >= 27


def test_a_family_makes_few_rows():
    """What a task tells of a block is less than its sets, however many pairs are similar; pairs that are not similar are not told."""
    rng = np.random.default_rng(9)
    base, parts = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64)), ngram_join.MANY_PARTS
    draw = lambda k: np.unique(np.concatenate([rng.permutation(base)[k:], rng.integers(0, 1 << 62, k).astype(np.uint64)]))
    sets = [draw(int(k)) for k in rng.integers(0, 30, 200)]
    n, block = np.array([len(x) for x in sets]), np.arange(200) % 2
    counts = np.stack([np.bincount((x & np.uint64(parts - 1)).astype(np.int64), minlength=parts) for x in sets])
    linked = np.array([[100 * len(np.intersect1d(x, y)) >= 90 * len(np.union1d(x, y)) for y in sets] for x in sets])
    similar = lambda i, j: ngram_join.walk(sets[i], [sets[x] for x in j], 90)
    assert linked.sum() > 10 * 200

    def groups(pairs):
        label = np.arange(200)
        for _ in range(200):
            for i, j in pairs:
                label[i] = label[j] = min(label[i], label[j])
        return label.tolist()

    alone = np.arange(200)
    for blocks, want in ((np.zeros(200, np.int64), linked), (block, linked & (block[:, None] != block))):
        told = ngram_join.forest(n, counts, alone, alone, blocks, 90, similar=similar)
        assert told.shape[1] < 200 and want[tuple(told)].all() and groups(told.T) == groups(np.argwhere(want))
    # Sets of one component are not compared; by the bounds alone, all that is linked is in one cluster.
    assert ngram_join.forest(n, counts, np.zeros(200), np.zeros(200), np.zeros(200), 90, similar=similar).shape == (2, 0)
    cluster = np.array(groups(ngram_join.forest(n, counts, alone, alone, np.zeros(200), 90).T))
    assert all(cluster[i] == cluster[j] for i, j in np.argwhere(linked))


@pytest.mark.parametrize("block", [16, 512])
def test_families_without_a_hub(spark, monkeypatch, block):
    """Copies with changes of their own, nearly similar enough to each other: links are found in blocks, and in few rows."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    told = []
    monkeypatch.setattr(ngram_join, "saved", lambda df, name: told.append((name, out := saved(df, name))) or out)
    rng = random.Random(12)
    base, rows = [f"w{rng.randrange(10**6)}" for _ in range(200)], []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(200), rng.randint(1, 6)):
            w[at] = f"own{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    out, links = ngram_join.shingle_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = brute_components(rows)
    assert found(out) == want and 10 < len({c for _, c in want.values()}) < 140
    made = dict(told)
    assert {"near", "placed"} <= set(made) and made["pairs"].count() <= 150
    # Links by smallest ids, and no more than two blocks' sets for each two blocks.
    ends = [(r.a, r.b) for r in links.collect()]
    assert all(want[a][1] == want[b][1] for a, b in ends) and len(ends) < (2 * 150 if block == 512 else 150 * 11)


def test_candidates_are_verified_once(spark, monkeypatch):
    """Windows that stay open meet the texts of earlier rounds again; the candidates they made then are not verified again."""
    made = []
    monkeypatch.setattr(passages, "saved", lambda df, name: made.append((name, out := saved(df, name))) or out)
    rng = random.Random(24)
    own = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for k in range(20):
        passage, first = own(50), 100 * k
        rows.append((first, " ".join([*own(60), *passage[:45], *own(60)])))
        rows += [(first + i, " ".join([*own(60), *passage, *own(60)])) for i in range(1, 4)]
        want |= {first + i: first + 1 for i in (2, 3)}
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.like_id for r in got} == want and len(got) == len(want)
    rounds = [[tuple(r) for r in df.collect()] for name, df in made if name == "places"]
    every = [place for places in rounds for place in places]
    assert len(rounds) > 1 and rounds[0] and len(every) > len(rounds[0]) and len(set(every)) == len(every)
