"""Language ID (5): segmentation-marginalised unigrams over a fixed public vocabulary.

A word ``w`` is drawn in language ``l`` by drawing pieces; its probability is the
sum over all ways to cut it into pieces of the vocabulary,

    P_l(w) = sum over cuts of product of p_l(piece),

which the forward algorithm adds up in one pass over the word. A text's score is
the product over its words; the prediction is the language with the largest.
``p_l`` is found by expectation-maximisation over the same lattice: expected
counts of every piece (forward times backward), added up by Spark.

Words are runs of letters in lower case, cut every 48 letters; the whole text is
read. A letter outside the vocabulary has one small probability in all languages.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_tasks, kept, saved, slices
from .merges import Endings, shared_start

MARK = "▁"
LONGEST = 48
#: Smallest probability of a piece: a word of 48 such pieces is still a double.
FLOOR = 1e-6
SMOOTHING = 0.1
REMEMBERED = 300_000
#: A table of languages, not of names: more than these are refused.
MOST_LANGUAGES = 1000


def vocabulary(model: str) -> list[str]:
    """The lower-case pieces of a SentencePiece file: letters only, a word mark in front or not."""
    table = sentencepiece.SentencePieceProcessor(model_file=model)
    names = {table.id_to_piece(i) for i in range(table.get_piece_size())}
    return sorted(p for p in names if (body := p.removeprefix(MARK)).isalpha() and body == body.lower())


class Unigrams:
    """Piece probabilities of each language; ``table`` maps a piece to one value for each."""

    def __init__(self, table: dict[str, tuple[float, ...]], languages: list[str]):
        self.table, self.languages = table, languages
        self.longest = max(map(len, table), default=1)
        self.unknown = (FLOOR,) * len(languages)
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((1024, len(languages)))
        self.endings: Endings | None = None  # made when first needed

    def edges(self, word: str) -> list[tuple[int, int, str]]:
        """Start, end and piece of every piece in the marked word; single unknown letters as they are."""
        text, table, out = MARK + word, self.table, []
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - self.longest), end):
                piece = text[start:end]
                if piece in table or start == end - 1:
                    out.append((start, end, piece))
        return out

    def score(self, word: str) -> list[float]:
        """log P of the word in each language, all cuts summed."""
        return next(self.scores([word]))

    def scores(self, words: Iterable[str]) -> Iterator[list[float]]:
        """``score`` of each word; what it shares with the start of the one before is not added up again."""
        if self.endings is None:
            self.endings = Endings(self.table)
        after, pieces, unknown = self.endings.after, self.endings.pieces, self.unknown
        before, states, ahead = "", [0], [[1.0] * len(unknown)]
        for word in words:
            text = MARK + word
            shared = shared_start(before, text)
            del states[shared + 1:], ahead[shared + 1:]
            before, state = text, states[shared]
            for end, letter in enumerate(text[shared:], shared + 1):
                state = after(state, letter)
                states.append(state)
                size, total = 0, [0.0] * len(unknown)
                for size, p in pieces[state]:
                    total = [t + x * y for t, x, y in zip(total, ahead[end - size], p)]
                if size != 1:  # a single letter outside the vocabulary
                    total = [t + x * y for t, x, y in zip(total, ahead[end - 1], unknown)]
                ahead.append(total)
            yield [math.log(x) if x > 0 else -708.0 for x in ahead[-1]]

    def expected(self, word: str, language: int, into: dict[str, float], times: float) -> None:
        """Adds ``times`` the expected count of every piece in the word to ``into``."""
        edges, size = self.edges(word), len(word) + 2
        weight = [self.table.get(p, self.unknown)[language] for _, _, p in edges]
        ahead, behind = [1.0] + [0.0] * (size - 1), [0.0] * (size - 1) + [1.0]
        for (start, end, _), p in zip(edges, weight):
            ahead[end] += ahead[start] * p
        for (start, end, _), p in zip(reversed(edges), reversed(weight)):
            behind[start] += behind[end] * p
        if ahead[-1] > 0:
            for (start, end, piece), p in zip(edges, weight):
                if piece in self.table:
                    into[piece] += times * ahead[start] * p * behind[end] / ahead[-1]

    def learn(self, words: Iterable[str]) -> None:
        """Scores the words that are not in ``rows`` yet; beyond ``REMEMBERED`` all are forgotten first."""
        if len(self.rows) >= REMEMBERED:
            self.rows, self.logs = {}, np.zeros((1024, len(self.languages)))
        known, fresh = self.rows, sorted(set(words).difference(self.rows))
        if len(known) + len(fresh) > len(self.logs):
            more = np.zeros((len(known) + len(fresh), len(self.languages)))
            self.logs = np.concatenate([self.logs, more])
        for word, logs in zip(fresh, self.scores(fresh)):
            k = known[word] = len(known)
            self.logs[k] = logs

    def predict(self, words: list[str]) -> tuple[str, float]:
        return self.predict_all([words])[0]

    def predict_all(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        """Language and its share of the probability for the words of each text."""
        self.learn(chain.from_iterable(texts))
        return [self._best(words) if words else ("und", 0.0) for words in texts]

    def _best(self, words: list[str]) -> tuple[str, float]:
        total, row = np.zeros(len(self.languages)), self.rows.__getitem__
        for at in range(0, len(words), 100_000):
            total += self.logs[list(map(row, words[at:at + 100_000]))].sum(axis=0)
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.languages[best], float(odds[best] / odds.sum())


def _words(text_col) -> F.Column:
    return F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(rf"\p{{L}}{{1,{LONGEST}}}"), F.lit(0)))


def train(df: DataFrame, model: str, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          documents_per_language: int = 600, rounds: int = 3) -> Unigrams:
    """Fits piece probabilities on about ``documents_per_language`` whole texts of each language.

    Which texts depends on a hash of the id alone. Rows without text or language
    are not used. With no usable row the model knows no language.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")) \
        .where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages, pieces = sorted(sizes), vocabulary(model)
    if not languages:
        return Unigrams({}, [])
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, documents_per_language / sizes[lang]))])
    draw = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1_000_003)) / 1_000_003.0
    chosen = rows.where(draw < share[F.col("lang")])
    counted = saved(chosen.select("lang", _words("text").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")),
                    "language-words")
    fitted = Unigrams({p: (1.0,) * len(languages) for p in pieces}, languages)
    for step in range(rounds):
        shared = df.sparkSession.sparkContext.broadcast((fitted.table, languages))
        first = step == 0

        def gather(batches, shared=shared, first=first):
            table, names = shared.value
            unigrams, index = Unigrams(table, names), {n: i for i, n in enumerate(names)}
            sums = [defaultdict(float) for _ in names]
            for batch in batches:
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                    if first:  # every piece in the word, longer ones count more
                        for start, end, piece in unigrams.edges(word):
                            if piece in table:
                                sums[index[lang]][piece] += n * (end - start) ** 2
                    else:
                        unigrams.expected(word, index[lang], sums[index[lang]], n)
            for name, counts in zip(names, sums):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(counts)), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.float64())],
                    names=["lang", "piece", "n"])

        found: dict[str, dict[str, float]] = {n: {} for n in languages}
        # At most one row for each piece of the fixed vocabulary and language.
        totals = in_tasks(counted, gather, "lang string, piece string, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        for r in totals.collect():
            found[r.lang][r.piece] = r.n
        whole = {n: sum(c.values()) + SMOOTHING * len(pieces) for n, c in found.items()}
        fitted = Unigrams({p: tuple(max(FLOOR, (found[n].get(p, 0.0) + SMOOTHING) / whole[n]) for n in languages)
                           for p in pieces}, languages)
    return fitted


def predict(df: DataFrame, fitted: Unigrams, *, id_col: str = "doc_id", text_col: str = "text",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """Id, the columns in ``keep``, ``lang_pred`` and ``score`` (the language's share of the probability).

    A null text, one without a letter, and any text when the model knows no
    language are ``und`` with score 0. Ties go to the first language in text
    order. Each row gives a row, whatever its id.
    """
    key = hash((tuple(fitted.languages), sum(map(sum, fitted.table.values()))))
    shared = df.sparkSession.sparkContext.broadcast((fitted.table, fitted.languages))
    columns = [id_col, *keep]

    def run(batches):
        unigrams, words = kept(("languages", key), lambda: Unigrams(*shared.value)), regex.compile(rf"\p{{L}}{{1,{LONGEST}}}")
        for batch in slices(batches, size=1 << 20):
            found = unigrams.predict_all([words.findall(t.lower()) if t and unigrams.languages else [] for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*columns, "lang_pred", "score"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return in_tasks(df.select(F.col(text_col).alias("__text"), *columns), run, f"{fields}, lang_pred string, score double")
