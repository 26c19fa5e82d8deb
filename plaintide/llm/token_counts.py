"""Token counts (8): exact counts of a byte-level BPE at every prefix, by dynamic programming.

A text is cut into the words of the tokenizer's own pattern. For each word the
fold of :mod:`merges` gives the number of tokens of each of its prefixes;
running sums over the words give the count at every prefix of the text. A total,
the longest prefix within a token budget, and the cost of any prefix are then
lookups; no text is encoded a second time.

Near the end of a cut the pattern may cut words otherwise than inside the whole
text (blanks before a word, the start of a contraction). Those few last
characters are cut anew, so that the count of a prefix is exactly what the
tokenizer gives for that prefix alone.
"""

from __future__ import annotations

import json
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import in_tasks, slices
from .merges import REMEMBERED, Lattice

# The blanks and the word pattern of byte-level BPE vocabularies.
BLANK = r"\t-\r \x85\xa0  -     　"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
           rf"| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


def _printable() -> dict[str, int]:
    """Byte of each character that stands for one in the vocabulary file."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteCounter:
    """Counts tokens as the ``tokenizers`` library does for a byte-level BPE file."""

    def __init__(self, vocabulary: bytes):
        table, spec = _printable(), json.loads(vocabulary)
        raw = lambda piece: bytes(table[c] for c in piece)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        model = spec["model"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        ids = {raw(p): i for p, i in model["vocab"].items() if p not in self.specials}
        self.lattice = Lattice(ids, lambda a, b: ranks.get((a, b)))
        self.words = regex.compile(PATTERN)
        self.blank = regex.compile(f"[{BLANK}]+")
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) \
            if self.specials else None
        self.known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        """The words of a text, special strings among them."""
        if self.special is None or not any(s in text for s in self.specials):
            return self.words.findall(text)
        words, at = [], 0
        for m in self.special.finditer(text):
            words += [*self.words.findall(text[at:m.start()]), m.group()]
            at = m.end()
        return words + self.words.findall(text[at:])

    def cut_all(self, texts: list[str]) -> list[tuple[list[str], list[int]]]:
        """For each text its words and the tokens of each; every different word is folded once."""
        known = self.known
        if len(known) >= REMEMBERED:
            known.clear()
        rows = [self.split(t) for t in texts]
        fresh = {w.encode(): w for w in set(chain.from_iterable(rows)).difference(known)}
        for special in self.specials:
            known[special] = 1
            fresh.pop(special.encode(), None)
        for raw, _, _, counts in self.lattice.folds(sorted(fresh)):
            known[fresh[raw]] = counts[-1]
        return [(words, list(map(known.__getitem__, words))) for words in rows]

    def cut(self, text: str) -> tuple[list[str], list[int]]:
        return self.cut_all([text])[0]

    def total(self, text: str) -> int:
        return sum(self.cut(text)[1])

    def prefix_counts(self, text: str) -> tuple[list[int], list[int]]:
        """End of each word in code points, and the tokens up to there."""
        words, counts = self.cut(text)
        return list(accumulate(map(len, words))), list(accumulate(counts))

    def within(self, text: str, budget: int, cut: tuple[list[str], list[int]] | None = None) -> int:
        """Code points of the longest prefix that has at most ``budget`` tokens; ``cut`` is the text's, if known.

        Prefix counts need not rise with every character, so all prefixes that
        can still fit are looked at, longest first: a word that begins after
        more than ``budget`` tokens plus those of the words that a cut may
        change cannot.
        """
        words, counts = cut or self.cut(text)
        ends, sums = list(accumulate(map(len, words), initial=0)), list(accumulate(counts, initial=0))
        if sums[-1] <= budget:
            return len(text)
        k = max(i for i, n in enumerate(sums) if n <= budget)
        # A prefix inside a later word has the tokens of all words before it but the last two, whose cut may change.
        stop = next((i for i in range(k, len(sums)) if sums[max(0, i - 2)] > budget), len(sums) - 1)
        for i in range(stop, 0, -1):
            if best := self._inside(text, words, ends, sums, i - 1, budget):
                return best
        return 0

    def _inside(self, text, words, ends, sums, i, budget) -> int:
        """The longest fitting prefix that ends in word ``i`` (or at its end), 0 if none does."""
        first = max(0, i - 2)
        while first and (words[first - 1].isspace() or words[first].isspace() or words[first - 1].endswith("'")):
            first -= 1
        word, start = words[i], ends[i]
        if self.blank.fullmatch(word) and word not in self.specials:
            # A text that ends in blanks ends in one word of them all, of which every prefix is counted by one fold.
            first = i
            while first and self.blank.fullmatch(words[first - 1]) and words[first - 1] not in self.specials:
                first -= 1
            folded = self.lattice.counts(text[ends[first]:ends[i + 1]].encode())
            before = len(text[ends[first]:start].encode())
            counts = [folded[before + b] for b in accumulate(len(c.encode()) for c in word)]
        elif word in self.specials or len(word) == 1 or (word[0] == "'" and len(word) <= 3):
            # A few characters, which may be cut otherwise when they are the last: a special string, a contraction.
            counts = [self.total(text[ends[first]:start + n]) for n in range(1, len(word) + 1)]
        else:
            # Letters, numbers or signs: the word's prefixes are words too, and what stands before stays as it is.
            folded = self.lattice.counts(word.encode())
            sizes = list(accumulate(len(c.encode()) for c in word))
            counts = [sums[i] - sums[first] + folded[b] for b in sizes]
            if word[0] == " ":
                counts[0] = self.total(text[ends[first]:start + 1])
        for n in range(len(word), 0, -1):
            if sums[first] + counts[n - 1] <= budget:
                return start + n
        return 0


_COUNTERS: dict[int, ByteCounter] = {}


def _counter(broadcast) -> ByteCounter:
    """One counter for each worker process and vocabulary; it remembers words from task to task."""
    raw = broadcast.value
    if hash(raw) not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[hash(raw)] = ByteCounter(raw)
    return _COUNTERS[hash(raw)]


def token_counts(df: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text",
                 budget: int = 1024, prefixes: bool = False) -> DataFrame:
    """Id, ``n_bytes``, ``n_tokens``, ``within`` (code points of the longest prefix of at most ``budget`` tokens).

    With ``prefixes``, also ``ends`` and ``counts``: the end of each word in
    code points and the tokens up to there. ``vocabulary`` is a path the driver
    can read; the file goes to the tasks as a broadcast of its own fixed size.

    A null text counts as empty: 0 bytes, 0 tokens. Ids may be null or repeat;
    each row gives a row. Other columns are left out. An empty table gives an
    empty table. A text is handled whole, whatever its length.
    """
    with open(vocabulary, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())
    more = pa.list_(pa.int32())

    def run(batches):
        counter = _counter(shared)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = counter.cut_all(texts)
            totals = [sum(c) for _, c in rows]
            out = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(totals, pa.int64()),
                   pa.array([counter.within(t, budget, r) if n > budget else len(t) for t, n, r in zip(texts, totals, rows)], pa.int64())]
            names = [id_col, "n_bytes", "n_tokens", "within"]
            if prefixes:
                out += [pa.array([list(accumulate(map(len, w))) for w, _ in rows], more),
                        pa.array([list(accumulate(c)) for _, c in rows], more)]
                names += ["ends", "counts"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, within bigint"
    if prefixes:
        schema += ", ends array<int>, counts array<int>"
    return in_tasks(df.select(id_col, text_col), run, schema)
