"""Words that are one edit from a much more frequent word.

Reduced-alphabet generation: the letters of every word are mapped to a few
symbols, and for each different reduced word all words of that alphabet at one
edit are generated. A word over a few symbols has few of them, whatever the
alphabet of the texts. They are joined with the reduced vocabulary; words whose
reduced forms meet are candidates and are compared as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .common import in_tasks, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = f"A-Za-z{chr(0xC0)}-{chr(0xFF)}"
#: Symbols of the reduced alphabet: more make more neighbours of each word, fewer make more candidates.
SYMBOLS = 6
#: Base of the hash of reduced words: odd, so that it has an inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(BASE, -1, 1 << 64))
#: Neighbours that a task holds at a time; a longer word than that allows is alone.
AT_ONCE = 1 << 18
#: Code points up to which words are compared by Spark's edit distance.
LONG = 64


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6,
               least_count: int = 5, one_in: int = 199) -> DataFrame:
    """``word, n``: the words of all texts with so many code points and occurrences.

    Words are runs of letters with A-Z lower-cased. Where ``one_in`` divides the
    CRC-32 of ``<id>:<word>`` the word has lost one letter (a planted
    misspelling); a null id is written as nothing. Null texts have no words.
    Counts are made in the tasks before anything is shuffled, so a word with a
    third of all occurrences is one row from each of them.
    """
    # Shorter runs cannot give a word; a run that is long enough is matched from its first letter to its last.
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode_outer(runs).alias("run")).where("run is not null")
    coded = found.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.length("run")))
    words = coded.select(F.when(F.col("h") % one_in == 0, short).otherwise(F.col("run")).alias("word"))
    counts = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least_count)


def reduced(word: Column) -> Column:
    """Each letter as one of the few symbols."""
    letters = [chr(c) for c in [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]]
    return F.translate(word, "".join(letters), "".join(chr(ord("a") + ord(c) % SYMBOLS) for c in letters))


def _symbols(words: list[str], size: int) -> np.ndarray:
    """Words of one length as rows of numbers from 1."""
    return (np.frombuffer("".join(words).encode("ascii"), np.uint8).reshape(len(words), size) - (ord("a") - 1)).astype(np.uint64)


def _powers(size: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, BASE, np.uint64)]), dtype=np.uint64)


def codes(words: list[str], size: int) -> np.ndarray:
    """Sum of symbol times ``BASE`` to the power of its place, modulo 2 ** 64."""
    return (_symbols(words, size) * _powers(size)[:size]).sum(axis=1, dtype=np.uint64)


def neighbours(words: list[str], size: int) -> list[np.ndarray]:
    """Codes of each word of that length and of all words at one edit from it, each code once.

    They follow from the sums before and after the place of the edit, so a word
    of a million letters costs a million steps a symbol, not as many words.
    """
    c, power = _symbols(words, size), _powers(size)
    sums = np.concatenate([np.zeros((len(words), 1), np.uint64), np.cumsum(c * power[:size], axis=1, dtype=np.uint64)], axis=1)
    total = sums[:, -1:]
    own = np.arange(1, SYMBOLS + 1, dtype=np.uint64)
    replaced = total[:, :, None] + (own - c[:, :, None]) * power[:size, None]
    deleted = sums[:, :-1] + (total - sums[:, 1:]) * _INVERSE
    inserted = sums[:, :, None] + own * power[:, None] + ((total - sums) * np.uint64(BASE))[:, :, None]
    every = np.concatenate([replaced.reshape(len(words), -1), deleted, inserted.reshape(len(words), -1)], axis=1)
    return [np.unique(row) for row in every]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[list[str], int]]:
    """Words of equal length, as many at a time as their neighbours allow."""
    words = sorted(batch.column(0).to_pylist(), key=len)
    start = 0
    while start < len(words):
        size = len(words[start])
        most = start + max(1, AT_ONCE // (2 * SYMBOLS * (size + 1)))
        end = start
        while end < min(most, len(words)) and len(words[end]) == size:
            end += 1
        yield words[start:end], size
        start = end


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, size in _by_length(batch):
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(codes(words, size).view(np.int64))], ["reduced", "code"])


def _generated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for words, size in _by_length(batch):
            found = neighbours(words, size)
            near = np.repeat(np.array([numbers[w] for w in words], np.int64), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.concatenate(found).view(np.int64))], ["near", "code"])


def one_edit(a: Column, b: Column) -> Column:
    """Whether two words differ by exactly one inserted, deleted or replaced code point.

    Spark's edit distance takes the square of the length, however small the
    distance asked for. Beyond ``LONG`` the first difference is found by
    halving, and what follows it is compared: the same answer in linear time.
    """
    shorter = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    same = lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)
    first = F.aggregate(steps, F.lit(0), lambda at, step: F.when((step <= shorter - at) & same(at + step), at + step).otherwise(at))

    def rest_is_same(at: Column) -> Column:
        rest = lambda word, skipped: F.substring(word, at + 1 + skipped, F.length(word))
        return F.when(F.length(a) == F.length(b), (a != b) & (rest(a, 1) == rest(b, 1))) \
            .when(F.length(a) == F.length(b) + 1, rest(a, 1) == rest(b, 0)) \
            .when(F.length(b) == F.length(a) + 1, rest(b, 1) == rest(a, 0)).otherwise(False)

    return F.when(F.greatest(F.length(a), F.length(b)) <= LONG, F.levenshtein(a, b, 1) == 1).otherwise(let(first, rest_is_same))


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, other, other_n``: all ordered pairs of ``words`` (``word, n``) at exactly one edit.

    Two reduced words meet at most once, because the neighbours of each are
    different codes, so no pair of words comes twice. Equal codes of different
    neighbours only make candidates that the comparison rejects.
    """
    forms = words.select("word", "n", reduced(F.col("word")).alias("reduced"))
    coded = in_tasks(forms.select("reduced").distinct(), _coded, "reduced string, code bigint")
    # Numbered once, so that what is joined by millions of rows is a number and not a word.
    coded = saved(coded.withColumn("id", F.monotonically_increasing_id()), "reduced")
    known = saved(forms.join(coded, "reduced").select("word", "n", "id"), "words")
    generated = in_tasks(coded.select("reduced", "id"), _generated, "near bigint, code bigint")
    meet = generated.join(coded.select("code", F.col("id").alias("other_id")), "code").select("near", "other_id")
    left = known.select("word", F.col("id").alias("near"))
    right = known.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("id").alias("other_id"))
    candidates = meet.join(left, "near").join(right, "other_id")
    return candidates.where(one_edit(F.col("word"), F.col("other"))).select("word", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where ``word, form`` leads in the end, by doubling the steps each round.

    Forms have to lead nowhere back. A round writes its table in the shared folder.
    """
    known = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = saved(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        known = step.select("word", "root")


def spelling_variants(words: DataFrame, times: int = 5) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every row of ``words`` (``word, n``, each word once).

    ``n_near`` counts the words at one edit; ``form`` is the most frequent of
    them, of equal ones the first by code points, if it is ``times`` as frequent
    as the word, else null; ``root`` follows the forms to the last. Words must be
    of the letters that ``vocabulary`` takes. An empty vocabulary gives no rows.
    """
    words = saved(words.select("word", "n"), "vocabulary")
    # The most frequent near word is the least by (-n, word).
    near = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    found = saved(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(-F.col("best.m") >= times * F.col("n"), F.col("best")).alias("best")), "near")
    forms = found.select("word", "n", "n_near", F.col("best.other").alias("form"), (-F.col("best.m")).alias("form_n"))
    ends = roots(forms.where("form is not null"))
    return forms.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
