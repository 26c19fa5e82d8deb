"""SentencePiece encoding and decoding (1): a lattice of pieces for each word, folded from left to right.

Blanks become ``▁`` and one is put in front. No piece holds anything before a
``▁`` but other ``▁``, and none holds a line break, so a text falls into words
that are encoded alone. The substrings of a word up to the longest piece are
looked up in the piece table; its hits are the edges of the word's lattice, and
the fold of :mod:`merges` follows the one path that the model's merges take.

The vocabulary is a BPE model: its scores are merge orders, not probabilities,
and the path with the best sum of scores is not what the model encodes. The fold
keeps, in place of the best sum, the one last piece that can stand at each
position; that gives the library's ids, which tests compare.

Relational explode, join and group-by of all substrings give the same ids but
have to carry each word of each document through a shuffle to the lattice and
back, several times the input. Here the lattice is made in the task that holds
the text, once for each different word; see README for figures.
"""

from __future__ import annotations

from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .common import in_tasks, kept, slices
from .merges import REMEMBERED, Lattice

MARK = "▁"


class Pieces:
    """Encodes and decodes as the library does for a BPE ``.model`` file with byte fallback."""

    def __init__(self, model: bytes):
        # The library reads the file; the encoding below is our own.
        table = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(table.get_piece_size())
        self.names = [table.id_to_piece(i) for i in every]
        self.bytes = {int(self.names[i][3:5], 16): i for i in every if table.is_byte(i)}
        self.codes = {i: b for b, i in self.bytes.items()}
        self.control = {i for i in every if table.is_control(i) or table.is_unknown(i)}
        ids = {self.names[i]: i for i in every if i not in self.control and i not in self.codes and not table.is_unused(i)}
        order = {name: -table.get_score(i) for name, i in ids.items()}
        self.unknown = table.unk_id()
        self.lattice = Lattice(ids, lambda a, b: order.get(a + b))
        self.words = regex.compile(self._pattern(ids))
        self.known: dict[str, bytes] = {}
        # What each id alone decodes to; bytes beyond ASCII only mean something together.
        plain = ["" if i in self.control else chr(c) if (c := self.codes.get(i, 128)) < 128 else self.names[i].replace(MARK, " ") for i in every]
        self.plain = np.array(plain, object)
        self.hard = np.array([self.codes.get(i, 0) >= 128 for i in every])

    @staticmethod
    def _pattern(ids: dict[str, int]) -> str:
        """Parts of a text that no piece reaches across, as far as this vocabulary allows."""
        letter = r"\p{L}\p{M}"
        if any(MARK in p.lstrip(MARK) or "\n" in p and len(p) > 1 for p in ids):
            return r"(?s).+"
        kinds = regex.compile(rf"[{letter}][^{letter}]|[^{letter}][{letter}]")
        if any(kinds.search(p.lstrip(MARK)) for p in ids):
            return rf"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n"
        return rf"{MARK}+(?:[{letter}]+|[^{letter}{MARK}\n]*)|[{letter}]+|[^{letter}{MARK}\n]+|\n"

    def _ids(self, word: str, last: list[int], starts: list[int]) -> bytes:
        out, end = [], len(word)
        while end:
            if last[end] >= 0:
                out.append(last[end])
            elif len(self.bytes) == 256:
                out += [self.bytes[b] for b in reversed(word[end - 1].encode())]
            else:
                out.append(self.unknown)
            end = starts[end]
        return array("i", out[::-1]).tobytes()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; every different word is folded once."""
        known = self.known
        if len(known) >= REMEMBERED:
            known.clear()
        rows = [self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = set(chain.from_iterable(rows)).difference(known)
        for word, last, starts, _ in self.lattice.folds(sorted(fresh)):
            known[word] = self._ids(word, last, starts)
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in rows]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        if not self.hard[ids].any():
            text = "".join(self.plain[ids].tolist())
        else:
            out, pending = [], bytearray()
            for i in ids.tolist():
                if i in self.codes:
                    pending.append(self.codes[i])
                    continue
                if pending:
                    out.append(pending.decode("utf-8", "replace"))
                    pending.clear()
                out.append(self.plain[i])
            text = "".join(out) + pending.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _pieces(broadcast) -> Pieces:
    raw = broadcast.value
    return kept(("pieces", hash(raw)), lambda: Pieces(raw))


def _shared(df: DataFrame, model: str):
    with open(model, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Id, the columns in ``keep``, ``ids`` (array of int) and ``n_pieces`` of every row's whole text.

    A null text has null ``ids`` and 0 pieces, an empty one an empty array. Ids
    may be null or repeat; each row gives a row. ``model`` is a path the driver
    can read; the file goes to the tasks as a broadcast of its own fixed size.
    """
    shared = _shared(df, model)
    columns = [id_col, *keep]

    def run(batches):
        pieces = _pieces(shared)
        for batch in slices(batches):
            texts = batch.column(0).to_pylist()
            rows = pieces.encode_all(texts)
            sizes = [len(r) for r in rows]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows)), mask=pa.array([t is None for t in texts]))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], ids, pa.array(sizes, pa.int64())], names=[*columns, "ids", "n_pieces"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    source = df.select(df[text_col].alias("__text"), *columns)
    return in_tasks(source, run, f"{fields}, ids array<int>, n_pieces bigint")


def decode(df: DataFrame, model: str, *, id_col: str = "doc_id", ids_col: str = "ids", out_col: str = "text",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """Id, the columns in ``keep`` and the text of every row's ids.

    Null ids give a null text, control ids no characters.

    ``decode(encode(text))`` is ``text``, but that ``▁`` in it comes back as a
    blank. Bytes that are not UTF-8 become replacement characters.
    """
    shared = _shared(df, model)

    def run(batches):
        pieces = _pieces(shared)
        for batch in slices(batches):
            texts = [pieces.decode(r.values.to_numpy(zero_copy_only=False)) if r.is_valid else None for r in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names=[*columns, out_col])

    columns = [id_col, *keep]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    return in_tasks(df.select(df[ids_col].alias("__ids"), *columns), run, f"{fields}, `{out_col}` string")
