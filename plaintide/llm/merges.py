"""Byte-pair encoding as a fold over a lattice of pieces.

Merging the best pair again and again gives a text one sequence of pieces. Two
facts make that sequence readable from a lattice (Berglund and van der Merwe,
"Formalizing BPE Tokenization", 2023):

* merges on both sides of a border that is never crossed do not depend on each
  other, so a sequence of pieces is the encoding exactly if every two
  neighbours, merged alone, stay those two pieces;
* every prefix has one encoding, so of the edges that end at a position exactly
  one fits behind the last piece of the prefix before it.

The fold therefore goes over the ends of a word from left to right, keeps the
last piece and the token count of every prefix, and takes the edge that fits.
Whether two pieces stay apart is found by merging them once and remembered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

#: Words and pairs a worker remembers before it starts anew, so that its memory is bounded.
REMEMBERED = 300_000
#: The rank of a merge that does not come.
NEVER = float("inf")


class Endings:
    """The pieces that end at each place of a word, found in one pass over its symbols (Aho and Corasick, 1975).

    A state is the longest end of what was read that begins some piece. From
    state 0, ``step[state]`` has the state behind each symbol that goes on,
    ``fail[state]`` is where to look when none does, and ``pieces[state]`` has
    size and value of every piece that ends there, longest first.
    """

    def __init__(self, values: dict):
        leaf: dict = {}
        self.step, self.fail, own = [{}], [0], {}
        for piece, value in values.items():
            state = 0
            for symbol in piece:
                if self.step[state] is leaf:
                    self.step[state] = {}
                to = self.step[state].get(symbol)
                if to is None:
                    to = self.step[state][symbol] = len(self.step)
                    self.step.append(leaf)
                    self.fail.append(0)
                state = to
            if state:
                own[state] = ((len(piece), value),)
        self.pieces = [()] * len(self.step)
        level = [0]
        while level:
            following = []
            for state in level:
                for symbol, to in self.step[state].items():
                    if state:
                        self.fail[to] = self.after(self.fail[state], symbol)
                    # What ends here but for the state's own piece is shared with a shorter state.
                    self.pieces[to] = own.get(to, ()) + self.pieces[self.fail[to]]
                    following.append(to)
            level = following

    def after(self, state: int, symbol) -> int:
        """The state once ``symbol`` is read."""
        while (to := self.step[state].get(symbol)) is None:
            if not state:
                return 0
            state = self.fail[state]
        return to


def shared_start(a: Sequence, b: Sequence) -> int:
    """How many symbols two words have in common from their start."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Lattice:
    """Encodes words over any alphabet whose slices can be looked up (``str`` or ``bytes``).

    ``ids`` has the id of every piece, 0 or more; ``rank(a, b)`` the order of the
    merge of two neighbouring pieces, smaller first, or None where they don't
    merge. Symbols outside ``ids`` never merge, so what follows one begins anew.
    """

    #: Stands for the start of a word, and for a symbol outside ``ids``.
    START = -1

    def __init__(self, ids: dict, rank: Callable):
        self.ids, self.rank = ids, rank
        self.endings = Endings(ids)
        self.apart: dict[int, bool] = {}
        self.sides: dict = {}  # what merging each piece alone does to its first and last part

    def merged(self, word: Sequence) -> list:
        """The pieces of a short word, by merging."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := self.rank(parts[i], parts[i + 1])) is not None),
                       default=None)
            if best is None:
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _sides(self, piece: Sequence) -> tuple[bool, bool, list, list]:
        """Whether a piece merged alone becomes whole, and by merges of rising rank; its first and its last parts.

        These are in order of time, each with the rank of the merge that takes it.
        """
        known = self.sides.get(piece)
        if known is None:
            parts = [piece[i:i + 1] for i in range(len(piece))]
            ranks = [self.rank(a, b) for a, b in zip(parts, parts[1:])]
            rising, time, first, last = True, NEVER, [], []
            while best := min(((r, i) for i, r in enumerate(ranks) if r is not None), default=None):
                r, i = best
                rising, time = rising and (time == NEVER or r >= time), r
                if i == 0:
                    first.append((parts[0], r))
                if i == len(parts) - 2:
                    last.append((parts[-1], r))
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = self.rank(parts[i - 1], parts[i])
                if i < len(ranks):
                    ranks[i] = self.rank(parts[i], parts[i + 1])
            known = self.sides[piece] = len(parts) == 1, rising, [*first, (parts[0], NEVER)], [*last, (parts[-1], NEVER)]
        return known

    def fits(self, before: Sequence, piece: Sequence) -> bool:
        """Whether ``piece`` stays whole behind the piece ``before`` (empty at a start).

        Both sides merge as they do alone until something crosses the border, so
        only the parts beside it are looked at, in order of time.
        """
        whole, rising, right, _ = self._sides(piece)
        if not before or not whole:
            return whole
        whole, also, _, left = self._sides(before)
        if not (whole and rising and also):
            return self.merged(before + piece) == [before, piece]
        i = j = 0
        time = None
        while True:
            (a, until_a), (b, until_b) = left[i], right[j]
            crossing = self.rank(a, b)
            if crossing is not None:
                if time is not None and crossing <= time:  # a merge that should have come before its own parts
                    return self.merged(before + piece) == [before, piece]
                # Of merges of one rank the leftmost is first.
                if crossing < until_a and crossing <= until_b:
                    return False
            if until_a == until_b == NEVER:
                return True
            time = min(until_a, until_b)
            if until_a <= until_b:
                i += 1
            else:
                j += 1

    def folds(self, words: Iterable[Sequence]) -> Iterator[tuple[Sequence, list[int], list[int], list[int]]]:
        """Each word with, for every prefix (the empty one first), its last piece's id and start, and its number of pieces.

        The fold goes on from the prefix that a word shares with the one before
        it, so sorted words cost least. The lists are only good until the next word.
        """
        step, fail, pieces, apart = self.endings.step, self.endings.fail, self.endings.pieces, self.apart
        if len(apart) >= REMEMBERED:
            apart.clear()
        last, starts, counts, states, before = [self.START], [0], [0], [0], None
        for word in words:
            shared = shared_start(before, word) if before is not None else 0
            del last[shared + 1:], starts[shared + 1:], counts[shared + 1:], states[shared + 1:]
            before, state, end = word, states[shared], shared
            for symbol in word[shared:]:
                end += 1
                while (to := step[state].get(symbol)) is None and state:
                    state = fail[state]
                state = to or 0
                states.append(state)
                for size, piece in pieces[state]:
                    start = end - size
                    previous = last[start]
                    key = (previous << 24) + piece
                    known = apart.get(key)
                    if known is None:
                        behind = word[starts[start]:start] if previous >= 0 else word[:0]
                        known = apart[key] = self.fits(behind, word[start:end])
                    if known:
                        break
                else:  # a symbol outside the pieces
                    piece, start = -1, end - 1
                last.append(piece)
                starts.append(start)
                counts.append(counts[start] + 1)
            yield word, last, starts, counts

    def counts(self, word: Sequence) -> list[int]:
        """The number of pieces of every prefix of a word."""
        return next(self.folds([word]))[3]
