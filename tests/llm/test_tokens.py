"""Operators 1 and 8 against the libraries of the vocabularies."""

from __future__ import annotations

import random
import time

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plaintide.llm import common, merges, sentence_pieces, token_counts
from plaintide.llm.sentence_pieces import Pieces
from plaintide.llm.token_counts import ByteCounter

from .conftest import BPE, PIECES, hard_rows

COUNTER = ByteCounter(open(BPE, "rb").read())
LIBRARY = Tokenizer.from_file(BPE)
OWN = Pieces(open(PIECES, "rb").read())
OTHER = sentencepiece.SentencePieceProcessor(model_file=PIECES)
PARTS = [" ", "  ", "\n", "\t", "a", "b", "the", "'s", "'ll", "'", "1", "23", "é", "日本", "\U0001F600", "<|endoftext|>", "!", "!!", "\x1c",
         "\x85", "　", "▁", "ing", "Th", "ER", "ö", "é", "<s>", "\x00"]


def count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def samples(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS if k % 2 else "etaoinshr  .", k=rng.randint(0, 30))) for k in range(n)]


def test_counts_are_the_librarys():
    texts = samples(2000, 1)
    assert [sum(c) for _, c in COUNTER.cut_all(texts)] == [count(t) for t in texts]


def test_ids_are_the_librarys_and_decode():
    for text in samples(2000, 2):
        ids = OWN.encode(text)
        assert ids == OTHER.encode(text), text
        assert OWN.decode(ids) == OTHER.decode(ids) == text.replace("▁", " ")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    assert COUNTER.total(text) == count(text)
    assert OWN.encode(text) == OTHER.encode(text)


def test_every_prefix():
    for text in samples(300, 3):
        counts = [count(text[:n]) for n in range(len(text) + 1)]
        for budget in (0, 1, 3, 7):
            best = max(n for n, c in enumerate(counts) if c <= budget)
            assert COUNTER.within(text, budget) == best, (text, budget)
        ends, sums = COUNTER.prefix_counts(text)
        assert not text or (ends[-1], sums[-1]) == (len(text), counts[-1])


def test_every_prefix_of_runs():
    """Runs of blanks, signs and apostrophes, alone and between words."""
    rng = random.Random(8)
    runs = ["\t" * 40, " " * 30, "\n \t" * 12, "'" * 25, "!" * 30, "\x1c" * 9, "\u3000\u00a0" * 7, "1" * 30]
    for k in range(60):
        text = "".join(rng.choice([*runs, "a", " the", "'s", "<|endoftext|>"]) for _ in range(rng.randint(1, 5)))
        counts = [count(text[:n]) for n in range(len(text) + 1)]
        for budget in (1, 2, 5, 11):
            assert COUNTER.within(text, budget) == max(n for n, c in enumerate(counts) if c <= budget), (text, budget)


@pytest.mark.parametrize("part", ["\t", "1,", "a", " ", "\n\n ", "'", "!?", "é", "<|endoftext|>"])
def test_a_megabyte_of_one_thing(part):
    text = part * ((1 << 20) // len(part))
    begin = time.perf_counter()
    total = COUNTER.total(text)
    within = COUNTER.within(text, 1024)
    assert time.perf_counter() - begin < 20
    assert total > 1024 and count(text[:within]) <= 1024
    longer = [n for n in range(within + 1, within + 40) if count(text[:n]) <= 1024]
    assert longer == []


def test_forgetting_changes_nothing(monkeypatch):
    from plaintide.llm import merges

    texts = samples(200, 4)
    want = [OTHER.encode(t) for t in texts]
    for module in (merges, sentence_pieces):
        monkeypatch.setattr(module, "REMEMBERED", 5)
    assert [OWN.encode(t) for t in texts] == want


def test_token_counts_of_hard_rows(hard, nothing):
    want = sorted((str(r[0]), len((r[1] or "").encode()), count(r[1] or "")) for r in hard_rows())
    found = token_counts.token_counts(hard, BPE, budget=20, prefixes=True).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in found) == want
    assert all((r.counts[-1] if r.counts else 0) == r.n_tokens for r in found)
    assert token_counts.token_counts(nothing, BPE).collect() == []


def test_pieces_of_hard_rows(hard, nothing):
    found = sentence_pieces.encode(hard, PIECES, keep=("text",))
    for r in found.collect():
        assert r.ids == (None if r.text is None else OTHER.encode(r.text)) and r.n_pieces == len(r.ids or [])
    back = sentence_pieces.decode(found, PIECES, keep=("text",), out_col="again").collect()
    assert len(back) == len(hard_rows()) and all(r.again == r.text for r in back)
    assert sentence_pieces.encode(nothing, PIECES).collect() == []


def test_borders_of_any_vocabulary():
    """Whether two pieces stay apart is found without merging them, also where ranks do not rise and merges tie."""
    rng = random.Random(11)
    for k in range(300):
        letters = "ab" if k % 2 else "abc"
        pieces = {*letters, *("".join(rng.choices(letters, k=rng.randint(2, 5))) for _ in range(rng.randint(1, 14)))}
        ranks = {p: rng.randint(0, 12) for p in pieces if len(p) > 1}
        lattice = merges.Lattice({p: i for i, p in enumerate(sorted(pieces))}, lambda a, b: ranks.get(a + b))
        alone = [p for p in pieces if lattice.merged(p) == [p]]
        for piece in pieces:
            assert lattice.fits("", piece) == (piece in alone)
            for before in alone:
                assert lattice.fits(before, piece) == (lattice.merged(before + piece) == [before, piece]), (ranks, before, piece)


def test_pieces_that_end_at_each_place():
    pieces = {"a": 0, "ab": 1, "b": 2, "bab": 3, "abab": 4, "c": 5}
    endings, state = merges.Endings(pieces), 0
    for end in range(1, len(word := "babababxcab") + 1):
        state = endings.after(state, word[end - 1])
        want = [(end - i, pieces[word[i:end]]) for i in range(end) if word[i:end] in pieces]
        assert list(endings.pieces[state]) == want


def test_words_cost_few_merges_looked_up():
    """Pairs of pieces are not merged anew for each word."""
    rng = random.Random(12)
    words = sorted({"".join(rng.choices("etaoinshrdlu", k=rng.randint(6, 12))).encode() for _ in range(3000)})
    counter = ByteCounter(open(BPE, "rb").read())
    rank, calls = counter.lattice.rank, []
    counter.lattice.rank = lambda a, b: calls.append(1) or rank(a, b)
    for _ in counter.lattice.folds(words):
        pass
    assert len(calls) < 10 * len(counter.lattice.apart)


def test_a_long_text_is_cut_once(monkeypatch):
    counter, seen = ByteCounter(open(BPE, "rb").read()), []
    split = counter.split
    monkeypatch.setattr(counter, "split", lambda text: seen.append(text) or split(text))
    text = "one and two. " * 400
    cut = counter.cut(text)
    assert counter.within(text, 1024, cut) == COUNTER.within(text, 1024)
    assert seen.count(text) == 1


def test_a_worker_keeps_one_model():
    made = []
    make = lambda x: lambda: made.append(x) or x
    assert [common.kept(k, make(k)) for k in (("a", 1), ("a", 1), ("b", 1), ("a", 1))] == [("a", 1), ("a", 1), ("b", 1), ("a", 1)]
    assert made == [("a", 1), ("b", 1), ("a", 1)] and len(common._KEPT) == 1
    common.release()
    assert not common._KEPT
