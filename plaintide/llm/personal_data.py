"""Personal data (9): weak supervision over candidate spans.

Patterns propose candidate spans. Labelers, each knowing a little, vote on every
candidate: its format, a gazetteer of known beginnings and endings, words of
context for and against it, and what it touches. Expectation-maximisation finds
how reliable each labeler is and how likely each candidate is to be personal
data, from the counts of vote patterns alone. With these likelihoods as soft
labels a logistic span classifier is trained on kinds and votes, and compiled
into a column expression that keeps or drops the candidates found beyond the
base ones. Base spans always stay.

Columns and aggregates only. Candidates stay arrays inside their document's row;
only counts of vote patterns, at most kinds x 3^labelers, come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let

# The base kinds, in the order in which equal starts are listed.
BASE = ("email", "ip", "card", "phone")
ADDED = ("number", "national_phone", "national_id", "secret")
KINDS = BASE + ADDED

# The base patterns. What repeats is possessive, so that no text, however long,
# makes the matcher recurse; a run is entered at its start or where the last match ended.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # Runs of fewer digits than any rule wants are no matches; neither is any end of one.
    "card": r"(?=(?:[0-9][\x20-]?){12}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "national_phone": r"(?<![0-9+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
#: What a text must hold for the pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "national_phone": None, "national_id": "-", "secret": None}

# Gazetteer: how real ones of a kind begin or end.
KNOWN = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|io|info|de|fr|es|it|uk|eu|nl|at|ch)$",
    "ip": r"^(?:10|127|172|192|[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "number": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|3[0-9]|4[0-9]|6[0-6]|7|8[1246]|9[0-58])",
    "national_phone": r"^\(?[2-9][0-9]{2}",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "secret": r"(?i)^(?:sk|pk|gh[opsu]|xox[abp]|akia|[0-9a-f]{20,}$)",
}
# Words before a candidate that speak for its kind.
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|@)\W*$", "ip": r"(?i)(?:\bip\b|address|host|server|from)\W*(?:\w+\W+)?$",
    "card": r"(?i)(?:card|visa|pay|account)\W*(?:\w+\W+)?$", "number": r"(?i)(?:card|visa|pay|account|iban)\W*(?:\w+\W+)?$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax)\W*(?:\w+\W+)?$", "national_phone": r"(?i)(?:phone|tel|call|mobile|fax)\W*(?:\w+\W+)?$",
    "national_id": r"(?i)(?:ssn|social|security|\bid\b)\W*(?:\w+\W+)?$",
    "secret": r"(?i)(?:token|secret|key|passw\w*|pwd|bearer|auth\w*)\W*$",
}
#: Words before a candidate that speak for something else.
AGAINST = r"(?i)(?:version|release|isbn|issn|page|figure|chapter|section|order|invoice|sha\d*|md5|commit|doi)\W*(?:\w+\W+)?$"
LABELERS = ("format", "gazetteer", "cue", "against", "border")
CONTEXT = 32
#: Items that are folded into one array, and code points of a part of a text. Results do not depend on them.
FOLDED, PART = 256, 4096


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits; every second digit from the right counts double."""
    last = F.length(digits)
    value = lambda i: F.substring(digits, last - i, F.lit(1)).cast("int")
    term = lambda i: F.when(i % 2 == 0, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), last - 1), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def _in_chunks(items: Column) -> Column:
    """An array as arrays of at most ``FOLDED`` items each."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / FOLDED).cast("int")), lambda c: F.slice(items, c * FOLDED + 1, F.lit(FOLDED)))


def _places(text: Column, pattern: str, needs: str | None) -> Column:
    """All matches: ``s``, ``e`` (code points, end exclusive) and ``m``, the matched text.

    A fold that appends to an array copies it each time. So the matches are
    folded in chunks, each from its own beginning, and the chunks are moved to
    their places after that: a text of one match a word costs little more.
    """
    kind = "array<struct<s:int,e:int,m:string>>"
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(matches)).alias("g"))
    walk = lambda a, x: F.struct(
        (a["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
        F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["g"])).alias("s"),
                                            (a["at"] + F.length(x["g"]) + F.length(x["m"])).alias("e"), x["m"].alias("m")))).alias("out"))
    fold = lambda items: F.aggregate(items, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), walk)

    def long(found: Column) -> Column:
        moved = F.aggregate(
            F.transform(_in_chunks(found), fold), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
            lambda a, c: F.struct((a["at"] + c["at"]).alias("at"), F.concat(a["out"], F.array(F.transform(c["out"], lambda x: F.struct(
                (x["s"] + a["at"]).alias("s"), (x["e"] + a["at"]).alias("e"), x["m"].alias("m"))))).alias("out")))
        return F.flatten(moved["out"])

    found = let(both, lambda items: F.when(F.size(items) <= FOLDED, fold(items)["out"]).otherwise(long(items)))
    there = text.contains(needs) if needs else text.rlike("[0-9]")
    return F.when(there & text.rlike(pattern), found).otherwise(F.array().cast(kind))


def _parts(text: Column) -> Column:
    """The text in parts of ``PART`` code points."""
    return F.when(F.length(text) <= PART, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)))


def _cut(parts: Column, start: Column, size: Column) -> Column:
    """``size`` code points from ``start`` (from 0), from the parts they are in: a whole text would be counted through each time."""
    first = F.floor(start / PART).cast("int")
    last = F.floor((start + size) / PART).cast("int")
    return F.substring(F.concat_ws("", F.slice(parts, first + 1, last - first + 1)), start - first * PART + 1, size)


def _overlaps(a: Column, spans: Column) -> Column:
    """Whether ``a`` overlaps one of ``spans`` of one kind, which are in order and apart: only the last that begins before its end can."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    before = F.aggregate(steps, F.lit(0), lambda n, step: F.when(
        (step <= F.size(spans) - n) & (F.get(spans, n + step - 1)["s"] < a["e"]), n + step).otherwise(n))
    few = F.exists(spans, lambda b: (b["s"] < a["e"]) & (a["s"] < b["e"]))
    return F.when(F.size(spans) <= 32, few).otherwise(let(before, lambda n: F.coalesce(F.get(spans, n - 1)["e"] > a["s"], F.lit(False))))


def _valid(kind: str, m: Column) -> Column:
    digits = F.length(_digits(m))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when((digits >= 14) & (digits <= 19), _luhn(_digits(m))).otherwise(False)
    if kind == "number":
        return F.when((digits >= 13) & (digits <= 19), F.when(digits >= 14, ~_luhn(_digits(m))).otherwise(True)).otherwise(False)
    if kind == "phone":
        return (digits >= 10) & (digits <= 15)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def _votes(kind: str, m: Column, before: Column, after: Column) -> Column:
    """A vote of each labeler: 1 for, 0 against, -1 none."""
    sure = {"email": F.lit(1), "card": F.lit(1), "phone": F.lit(1), "ip": F.when(m.rlike(r"(?:^|\.)0[0-9]"), 0).otherwise(1),
            "number": F.when(m.rlike(r"^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), 1).otherwise(0),
            "national_phone": F.when(m.rlike(r"^(?:\(|[0-9]{3}([.-])[0-9]{3}\1)"), 1).otherwise(-1), "national_id": F.lit(1),
            "secret": F.when(m.rlike("[0-9].*[0-9].*[0-9].*[0-9]"), 1).otherwise(0)}[kind]
    return F.array(
        sure, F.when(m.rlike(KNOWN[kind]), 1).otherwise(-1), F.when(before.rlike(CUES[kind]), 1).otherwise(-1),
        F.when(before.rlike(AGAINST), 0).otherwise(-1),
        F.when(before.rlike("[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]"), 0).otherwise(1 if kind in ADDED else -1))


def candidates(df: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in ``keep`` and ``candidates``: ``s``, ``o`` (kind's place in ``KINDS``), ``e``, ``votes``."""
    text = F.col("__text")
    rows = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    found = rows.select("*", _parts(text).alias("__parts"), *[_places(text, p, NEEDS[k]).alias(f"__{k}") for k, p in PATTERNS.items()])
    parts = F.col("__parts")

    def of(kind: str, source: str) -> Column:
        valid = F.filter(F.col(f"__{source}"), lambda x: _valid(kind, x["m"]))
        start = lambda x: F.greatest(x["s"] - CONTEXT, F.lit(0))
        # The context is cut out once, all labelers read it.
        near = F.transform(valid, lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), _cut(parts, start(x), x["s"] - start(x)).alias("before"),
            _cut(parts, x["e"], F.lit(1)).alias("after")))
        return F.transform(near, lambda x: F.struct(
            x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("o"), x["e"].alias("e"),
            _votes(kind, x["m"], x["before"], x["after"]).alias("votes")))

    base = found.select(*keep, *[of(k, k).alias(f"__base_{k}") for k in BASE],
                        F.flatten(F.array(*[of(k, "card" if k == "number" else k) for k in ADDED])).alias("__added"))
    # What overlaps a base span is that span, or part of it.
    free = F.filter("__added", lambda a: ~reduce(Column.__or__, [_overlaps(a, F.col(f"__base_{k}")) for k in BASE]))
    return base.select(*keep, F.array_sort(F.concat(*[f"__base_{k}" for k in BASE], free)).alias("candidates"))


@dataclass(frozen=True)
class SpanModel:
    """A logistic classifier of spans: a weight for each kind, and for each labeler's vote."""

    kinds: tuple[float, ...]
    labelers: tuple[float, ...]
    reliability: tuple[tuple[float, float], ...]

    def score(self, span: Column) -> Column:
        # A vote of -1 (none) adds nothing, 1 adds the weight, 0 takes it away.
        vote = lambda j: F.element_at(F.array(F.lit(0.0), F.lit(-1.0), F.lit(1.0)), F.get(span["votes"], j) + 2)
        kind = F.element_at(F.array(*[F.lit(w) for w in self.kinds]), span["o"] + 1)
        return 1 / (1 + F.exp(-(kind + sum(vote(j) * w for j, w in enumerate(self.labelers)))))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def fit(found: DataFrame, *, rounds: int = 30) -> SpanModel:
    """EM over the counts of vote patterns, then the classifier, both on a table of bounded size."""
    counted = found.select(F.explode("candidates").alias("c")).groupBy(F.col("c.o").alias("o"), F.col("c.votes").alias("votes")).agg(F.count("*").alias("n"))
    rows = [(r.o, tuple(r.votes), float(r.n)) for r in counted.collect()]
    rows.sort()
    some = range(len(LABELERS))
    # Start: labelers are right four times in five; base kinds have passed a check.
    right = [(0.8, 0.8)] * len(LABELERS)
    prior = [0.9 if k in BASE else 0.5 for k in KINDS]
    belief: list[float] = []
    for _ in range(rounds):
        belief = []
        for o, votes, _ in rows:
            odds = math.log(prior[o] / (1 - prior[o]))
            for j in some:
                if votes[j] >= 0:
                    hit, no = right[j]
                    odds += math.log(hit / (1 - no)) if votes[j] else math.log((1 - hit) / no)
            belief.append(_sigmoid(odds))
        for k in range(len(KINDS)):
            mine = [(n, b) for (o, _, n), b in zip(rows, belief) if o == k]
            # Counts of a few imagined candidates keep every estimate off 0 and 1.
            prior[k] = (sum(n * b for n, b in mine) + (9 if KINDS[k] in BASE else 5)) / (sum(n for n, _ in mine) + 10)
        for j in some:
            yes = [(n * b, v[j]) for (_, v, n), b in zip(rows, belief) if v[j] >= 0]
            no_ = [(n * (1 - b), v[j]) for (_, v, n), b in zip(rows, belief) if v[j] >= 0]
            # No labeler is taken to be worse than chance.
            right[j] = (max(0.55, (sum(w for w, v in yes if v) + 8) / (sum(w for w, _ in yes) + 10)),
                        max(0.55, (sum(w for w, v in no_ if not v) + 8) / (sum(w for w, _ in no_) + 10)))
    kinds, labelers = [math.log(p / (1 - p)) for p in prior], [0.5] * len(LABELERS)
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(400):
        up_kinds, up_labelers = [0.0] * len(KINDS), [0.0] * len(LABELERS)
        for (o, votes, n), b in zip(rows, belief):
            signs = [0 if v < 0 else 1 if v else -1 for v in votes]
            error = n / total * (b - _sigmoid(kinds[o] + sum(s * w for s, w in zip(signs, labelers))))
            up_kinds[o] += error
            for j in some:
                up_labelers[j] += error * signs[j]
        kinds = [w + 2 * u for w, u in zip(kinds, up_kinds)]
        labelers = [w + 2 * u - 0.002 * w for w, u in zip(labelers, up_labelers)]
    return SpanModel(tuple(kinds), tuple(labelers), tuple(right))


def kept_spans(model: SpanModel, least: float = 0.5) -> Column:
    """Of the column ``candidates``: base spans, and others that the classifier takes for personal data."""
    return F.filter("candidates", lambda c: (c["o"] < len(BASE)) | (model.score(c) >= least))


def listed(spans: Column) -> Column:
    """``kind:start:end``, joined by commas; ``spans`` are in order of start, then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(
        ":", F.element_at(names, c["o"] + 1), c["s"].cast("string"), c["e"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first names the place."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def replaced(parts: Column) -> Column:
        step = lambda a, c: F.when(c["s"] >= a["at"], F.struct(
            c["e"].alias("at"), F.concat(a["out"], F.array(_cut(parts, a["at"], c["s"] - a["at"]), F.element_at(names, c["o"] + 1))).alias("out"))
        ).otherwise(F.struct(F.greatest(a["at"], c["e"]).alias("at"), a["out"].alias("out")))
        # As above: what is written is joined after each chunk of spans.
        chunk = lambda a, some: let(
            F.aggregate(some, F.struct(a["at"].alias("at"), F.array().cast("array<string>").alias("out")), step),
            lambda done: F.struct(done["at"].alias("at"), F.concat(a["out"], F.array(F.array_join(done["out"], ""))).alias("out")))
        return F.aggregate(_in_chunks(spans), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), chunk,
                           lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))

    return F.when(F.size(spans) > 0, let(_parts(text), replaced)).otherwise(text)


def personal_data(df: DataFrame, model: SpanModel | None = None, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and ``spans`` (array of ``s``, ``o``, ``e``, ``votes``) of every row's whole text.

    Without a ``model`` one is fitted to the same rows first. A null text counts
    as empty and has no spans, an empty table no rows; every row gives a row, so
    copies are found as often as they are there. Spans of different kinds may
    overlap if both are base kinds; added ones never overlap base ones.
    """
    found = candidates(df, text_col=text_col, keep=keep)
    return found.select(*keep, kept_spans(fit(found) if model is None else model).alias("spans"))
