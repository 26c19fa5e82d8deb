"""Benchmark decontamination (4): q-gram lemma filtering and banded alignment.

Texts and benchmark items are compared as sequences of their letters and digits
in lower case. An item of ``m`` characters that occurs with at most ``k`` edits
shares at least ``m - q + 1 - k * q`` of its q-grams with the place where it
occurs, and their diagonals (place in the text minus place in the item) differ
by at most ``k``. So shared q-grams are counted in overlapping bands of
diagonals, each twice as wide as the step between them and the step wider than
``k``; only bands that reach the bound are aligned, inside the band, and kept if
the distance is at most ``k``.

Everything about a document happens in the task that holds its text: no
shuffle. The benchmark, a query set, is read in blocks of a fixed number of
characters, and each block goes to the tasks as a broadcast.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_tasks, slices

#: Characters of benchmark text in one broadcast; more are handled block by block.
BLOCK_CHARACTERS = 500_000
#: Characters of documents hashed at a time.
CHUNK = 1 << 20
#: Shared q-grams handled at a time, and places of a text looked at together where they are more. Results do not depend on them.
ROWS, WINDOW = 1 << 22, 1 << 13


def _plain() -> np.ndarray:
    """For every code point its lower-case letter or digit, 0 for others."""
    out = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalnum():
            low = c.lower()
            out[code] = ord(low) if len(low) == 1 else code
        elif unicodedata.category(c) == "Mn":
            out[code] = code
    return out


_PLAIN: list[np.ndarray] = []


def plain(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The compared characters of a text, and where in the text each stands."""
    if not _PLAIN:
        _PLAIN.append(_plain())
    codes = _PLAIN[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    at = np.flatnonzero(codes)
    return codes[at], at


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the ``q`` characters from each place on."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power = (codes.astype(np.uint64) + np.uint64(0x51ED27)) * np.uint64(0x9E3779B97F4A7C15)
        power ^= power >> np.uint64(29)
        out, size, have, width = None, 0, power, 1
        # Hashes of 1, 2, 4, ... characters make up one of q.
        factor = np.uint64(0xBF58476D1CE4E5B9)
        n = len(codes) - q + 1
        while True:
            if q & width:
                part = have[size:size + n]
                out = part.copy() if out is None else out * factor + part
                size += width
            width *= 2
            if width > q:
                break
            have = (have[:-(width // 2)] * factor ^ (have[:-(width // 2)] >> np.uint64(31))) + have[width // 2:]
        out *= np.uint64(0x94D049BB133111EB)
        return out ^ (out >> np.uint64(32))


def align(item: np.ndarray, region: np.ndarray, shift: int, width: int) -> tuple[int, int, int]:
    """Least edits between ``item`` and a part of ``region``, and the part's start and end.

    Only cells with ``shift <= column - row < shift + width`` are looked at.
    """
    far = np.int64(1 << 30)
    steps = np.arange(width, dtype=np.int64)
    size = len(region)
    col = shift + steps
    best = np.where((col >= 0) & (col <= size), 0, far)
    starts = np.clip(col, 0, size)
    for row in range(len(item)):
        col = shift + row + 1 + steps  # columns after this row
        same = np.zeros(width, bool)
        ok = (col >= 1) & (col <= size)
        same[ok] = region[col[ok] - 1] == item[row]
        diagonal = best + np.where(same, 0, 1)
        above = np.append(best[1:], far) + 1
        cost = np.minimum(diagonal, above)
        begin = np.where(diagonal <= above, starts, np.append(starts[1:], 0))
        cost = np.where((col >= 0) & (col <= size), cost, far)
        left = np.minimum.accumulate(cost - steps)  # a run of region characters too many
        source = np.maximum.accumulate(np.where(cost - steps == left, steps, 0))
        best, starts = np.minimum(left + steps, far), begin[source]
    end = int(best.argmin())
    return int(best[end]), int(starts[end]), min(size, max(0, shift + len(item) + end))


@dataclass
class Items:
    """A block of benchmark items, indexed by q-gram."""

    ids: list
    texts: list[str]
    q: int
    rate: float
    by_length: dict[int, tuple] = field(default_factory=dict)

    def __post_init__(self):
        self.codes = [plain(t)[0] for t in self.texts]
        self.edits = [min(int(self.rate * len(c)), max(0, (len(c) - self.q) // self.q)) for c in self.codes]
        self.needed = [len(c) - min(self.q, len(c)) + 1 - k * self.q for c, k in zip(self.codes, self.edits)]
        self.step = np.array([1 << k.bit_length() for k in self.edits] or [1], np.int64)
        # Items of fewer than q characters are looked up whole, with windows of their length.
        groups: dict[int, list[int]] = {}
        for i, c in enumerate(self.codes):
            if len(c):
                groups.setdefault(min(self.q, len(c)), []).append(i)
        for length, members in groups.items():
            hashes = [grams(self.codes[i], length) for i in members]
            keys = np.concatenate(hashes)
            item = np.repeat(np.array(members, np.int64), [len(h) for h in hashes])
            place = np.concatenate([np.arange(len(h), dtype=np.int64) for h in hashes])
            order = np.argsort(keys, kind="stable")
            bits = max(16, int(32 * len(keys)).bit_length())
            there = np.zeros(1 << bits, bool)
            there[keys >> np.uint64(64 - bits)] = True
            self.by_length[length] = (keys[order], item[order], place[order], there, np.uint64(64 - bits))

    def hits(self, codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in ``codes`` of every q-gram that items have, and where and how often the index has it."""
        keys, item, place, there, shift = self.by_length[length]
        hashes = grams(codes, length)
        at = np.flatnonzero(there[hashes >> shift])
        found = hashes[at]
        first = np.searchsorted(keys, found)
        at, found, first = (x[keys[np.minimum(first, len(keys) - 1)] == found] for x in (at, found, first))
        many = np.searchsorted(keys, found, side="right") - first
        return at, first, many

    def expanded(self, length: int, at: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row for each shared q-gram: place in the codes, item and place in the item."""
        _, item, place, _, _ = self.by_length[length]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        entry = np.repeat(first, many) + nth
        return np.repeat(at, many), item[entry], place[entry]

    def search(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple]]:
        """For each text (:func:`plain`): item id, start, end and distance of every occurrence."""
        gap = np.zeros(self.q, np.uint32)
        codes = np.concatenate([x for c, _ in documents for x in (c, gap)]) if documents else gap
        offset = np.cumsum([0] + [len(c) + self.q for c, _ in documents])
        out: list[list[tuple]] = [[] for _ in documents]
        for length in self.by_length:
            at, first, many = self.hits(codes, length)
            for begin, end in self._windows(length, at, many, len(codes)):
                self._bands(length, at, first, many, begin, end, documents, offset, out)
        return [sorted(set(found), key=lambda x: (x[1], x[2], str(x[0]))) for found in out]

    def _reach(self, length: int) -> int:
        """How far after the beginning of a band its last q-gram can stand."""
        _, item, place, _, _ = self.by_length[length]
        return int(place.max()) + 2 * int(self.step[item].max()) + 1

    def _windows(self, length: int, at: np.ndarray, many: np.ndarray, size: int):
        """Ranges of diagonals whose q-grams make up few rows: all of them at once, unless the text repeats what an item repeats."""
        if not len(at):
            return
        if many.sum() <= ROWS:
            yield -(1 << 20), size
            return
        wide = max(self._reach(length), WINDOW)
        for begin in range(0, size, wide):
            yield begin if begin else -(1 << 20), min(begin + wide, size)

    def _bands(self, length, at, first, many, begin, end, documents, offset, out) -> None:
        """Looks at the bands of diagonals that begin in a window, with all their q-grams."""
        a, b = np.searchsorted(at, [begin, end + self._reach(length)])
        if a == b:
            return
        at, item, place = self.expanded(length, at[a:b], first[a:b], many[a:b])
        diagonal = at - place + (1 << 20)
        band = diagonal // self.step[item]
        key = (item << 40) | band
        values, counts = np.unique(key, return_counts=True)
        # A band is looked at together with the next one, so that a passage on the border of two is whole in one.
        pairs = np.concatenate([values, values - 1])
        values, where = np.unique(pairs, return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([counts, counts])).astype(np.int64)
        lows = (values & ((1 << 40) - 1)) * self.step[values >> 40] - (1 << 20)
        chosen = (counts >= np.array(self.needed)[values >> 40]) & (lows >= begin) & (lows < end)
        if not chosen.any():
            return
        spot = (item << 40) | diagonal
        order = np.argsort(spot, kind="stable")
        spot, at, place = spot[order], at[order], place[order]
        for value, low in zip(values[chosen], lows[chosen]):
            i, step = int(value >> 40), int(self.step[value >> 40])
            x, y = np.searchsorted(spot, [(i << 40) | (int(low) + (1 << 20)), (i << 40) | (int(low) + 2 * step + (1 << 20))])
            self._verify(i, int(low), 2 * step, at[x:y], place[x:y], documents, offset, out)

    def _verify(self, i, low, width, at, place, documents, offset, out) -> None:
        pattern, k = self.codes[i], self.edits[i]
        # A band may touch several short texts; each is looked at alone.
        for d in np.unique(np.searchsorted(offset, at, side="right") - 1):
            codes, where = documents[d]
            own = (at >= offset[d]) & (at < offset[d + 1])
            if own.sum() < self.needed[i]:
                continue
            diagonals = np.unique(at[own] - place[own]) - offset[d]
            exact = [int(s) for s in diagonals if 0 <= s <= len(codes) - len(pattern) and np.array_equal(codes[s:s + len(pattern)], pattern)]
            if exact:
                out[d] += [(self.ids[i], int(where[s]), int(where[s + len(pattern) - 1]) + 1, 0) for s in exact]
                continue
            if k == 0:
                continue
            begin = max(0, low - int(offset[d]) - k)
            region = codes[begin:max(0, low - int(offset[d]) + width + len(pattern) + k)]
            distance, start, end = align(pattern, region, low - int(offset[d]) - begin - k, width + 2 * k)
            if distance <= k and end > start:
                out[d].append((self.ids[i], int(where[begin + start]), int(where[begin + end - 1]) + 1, distance))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[list[tuple]]:
    """The items in blocks; one block is on the driver at a time unless there is only one."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null and text != ''")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // BLOCK_CHARACTERS)
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b)
        yield [(r["item"], r["text"]) for r in part.orderBy("item", "text").collect()]


def leaks(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", keep: tuple[str, ...] = (), q: int = 10, rate: float = 0.08) -> DataFrame:
    """Each row's id, the columns in ``keep`` and ``leaks``: the benchmark items found in its whole text.

    An item of ``m`` letters and digits is found with up to ``rate * m`` edits,
    but no more than the q-gram bound can tell apart, and exactly if it is
    shorter than ``q``. A leak has ``item_id``, ``start`` and ``end`` (code
    points, end exclusive) and ``distance``. Null and empty texts have none, nor
    has anything when the benchmark is empty; null items and those without a
    letter or digit are found nowhere. Copies of a row each give a row;
    copies of an item, with the same id and text, count once.
    """
    kind = benchmark.schema[item_col].dataType
    one = T.StructType().add("item_id", kind).add("start", T.LongType()).add("end", T.LongType()).add("distance", T.IntegerType())
    columns = [id_col, *keep]
    source = df.select(F.col(text_col).alias("__text"), *columns, F.lit(None).cast(T.ArrayType(one)).alias("__leaks"))
    schema = T.StructType([source.schema["__text"], *[source.schema[c] for c in columns], T.StructField("__leaks", T.ArrayType(one))])
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = df.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            items = None
            for batch in slices(batches, 1024):
                if items is None:
                    items = Items([i for i, _ in shared.value], [t for _, t in shared.value], q, rate)
                texts, found, pending, size = batch.column(0).to_pylist(), [], [], 0
                for text in texts:
                    pending.append(plain(text or ""))
                    size += len(pending[-1][0])
                    if size >= CHUNK:
                        found += items.search(pending)
                        pending, size = [], 0
                found += items.search(pending)
                before = batch.column(batch.num_columns - 1).to_pylist()
                rows = [(b or []) + [dict(zip(("item_id", "start", "end", "distance"), x)) for x in f] for b, f in zip(before, found)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(rows, batch.schema.field(batch.num_columns - 1).type)], schema=batch.schema)

        source = in_tasks(source, run, schema)
    return source.select(*columns, F.coalesce("__leaks", F.array().cast(T.ArrayType(one))).alias("leaks"))
