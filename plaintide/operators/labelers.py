"""Labels from a function of the caller's, batch by batch.

This is where a model, a service or a rule set is plugged in. A labeler gets
Arrow batches of reviews and returns one label for each row, in columns of a
stated schema. Rows that it cannot label do not fail the job: they come back
with the reason, so that they can be sent again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StringType, StructField, StructType

from ..functions.arrays import let
from ..functions.vocabulary import RULE_WORDS
from ..workers import in_tasks

#: A batch of rows to labels: a batch or table with the label columns, or a list of their values if there is one column.
Labeler = Callable[[pa.RecordBatch], "pa.RecordBatch | pa.Table | Sequence"]


def _typed(found, size: int, schema: pa.Schema) -> list[pa.Array]:
    """The label columns in their types, or an error that says what is wrong with them."""
    if isinstance(found, pa.Table):
        found = found.combine_chunks()
    if isinstance(found, (pa.Table, pa.RecordBatch)):
        missing = [name for name in schema.names if name not in found.schema.names]
        if missing:
            raise ValueError(f"the labeler gave no column {missing[0]}")
        columns = [found.column(name) for name in schema.names]
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    elif len(schema) == 1:
        columns = [found if isinstance(found, pa.Array) else pa.array(list(found), schema.types[0])]
    else:
        raise ValueError("the labeler gave a list for several columns")
    if any(len(c) != size for c in columns):
        raise ValueError(f"the labeler gave {len(columns[0])} labels for {size} rows")
    return [c.cast(kind) for c, kind in zip(columns, schema.types)]


def _label(labeler: Labeler, rows: pa.RecordBatch, schema: pa.Schema) -> Iterator[tuple[list[pa.Array], str | None, int]]:
    """Labels of ``rows`` in order; where the labeler raises, of each half, down to the rows it raises for."""
    try:
        yield _typed(labeler(rows), rows.num_rows, schema), None, rows.num_rows
    except Exception as error:  # noqa: BLE001  whatever the caller's code raises belongs to the row
        if rows.num_rows == 1:
            yield [pa.nulls(1, kind) for kind in schema.types], f"{type(error).__name__}: {error}", 1
        else:
            half = rows.num_rows // 2
            yield from _label(labeler, rows.slice(0, half), schema)
            yield from _label(labeler, rows.slice(half), schema)


def label_with(
    df: DataFrame,
    make_labeler: Callable[[], Labeler],
    schema: str | StructType = "category string",
    inputs: Sequence[str] = ("review_id", "review_text"),
    rows: int = 256,
    allowed: Sequence[str] | None = None,
    error: str = "label_error",
) -> DataFrame:
    """``df`` with the label columns of ``schema`` and ``error``.

    ``make_labeler`` is called once for each task and returns the labeler (a
    model is loaded there); it gets batches of at most ``rows`` rows with the
    columns ``inputs``. A batch for which the labeler raises, or gives the wrong
    number of labels or labels of another type, is halved until the rows are
    found that it fails for: these have null labels and the reason in
    ``error``. If ``make_labeler`` raises, all rows of the task have its reason.
    ``allowed`` lists the values that the first label column may have; others
    are an error of their row. One task handles one partition; nothing is
    shuffled.
    """
    labels = schema if isinstance(schema, StructType) else DataType.fromDDL(schema)
    taken = [name for name in [*labels.names, error] if name in df.columns]
    if taken:
        raise ValueError(f"the rows have a column {taken[0]} already")
    arrow = to_arrow_schema(labels)
    wanted, names = list(inputs), [*df.columns, *labels.names, error]
    known = None if allowed is None else set(allowed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            labeler = make_labeler()
        except Exception as failed:  # noqa: BLE001
            reason = failed

            def labeler(batch):
                raise reason

        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                found = list(_label(labeler, part.select(wanted), arrow))
                columns = [pa.concat_arrays([f[0][i] for f in found]) for i in range(len(arrow))]
                errors = [reason for _, reason, size in found for _ in range(size)]
                if known is not None:
                    odd = [e is None and v is not None and v not in known for v, e in zip(columns[0].to_pylist(), errors)]
                    errors = [f"ValueError: {v} is not allowed" if o else e for o, v, e in zip(odd, columns[0].to_pylist(), errors)]
                    columns = [pa.array([None if o else v for o, v in zip(odd, c.to_pylist())], c.type) for c in columns]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns, pa.array(errors, pa.string())], names)

    out = StructType([*df.schema.fields, *labels.fields, StructField(error, StringType())])
    return in_tasks(df, run, out)


# --- words by one automaton ----------------------------------------------------


def word_finder(groups: Sequence[Sequence[str]]) -> Callable[[str], list[tuple[int, int]]]:
    """A function of a text: for each group of words, how often they occur and where the first one begins.

    Occurrences do not overlap: the leftmost counts, of several at one place
    the word that comes first in its group, as in a pattern of alternatives. One
    pass over the text finds the words of all groups, however many there are.
    """
    import ahocorasick

    places: dict[str, list[tuple[int, int]]] = {}
    for group, words in enumerate(groups):
        for order, word in enumerate(words):
            if not word:
                raise ValueError("an empty word is everywhere")
            places.setdefault(word, []).append((group, order))
    automaton = ahocorasick.Automaton()
    for word, at in places.items():
        automaton.add_word(word, (len(word), at))
    if places:
        automaton.make_automaton()

    def find(text: str) -> list[tuple[int, int]]:
        found: dict[int, list[tuple[int, int, int]]] = {}
        if places:
            for end, (size, at) in automaton.iter(text):
                for group, order in at:
                    found.setdefault(group, []).append((end - size + 1, order, size))
        out = [(0, -1)] * len(groups)
        for group, hits in found.items():
            hits.sort()
            count, free = 0, 0
            for start, _, size in hits:
                if start >= free:
                    count, free = count + 1, start + size
            out[group] = (count, hits[0][0])
        return out

    return find


def find_words(df: DataFrame, groups: Sequence[Sequence[str]], text: str = "review_text", name: str = "word_hits") -> DataFrame:
    """Adds ``name``: for each group of words ``hits`` and ``first`` (0-based, -1 if none) in the lower-case text.

    A null text has no words. Cost follows the length of the texts and the
    number of hits, not the number of words.
    """
    groups = [list(words) for words in groups]
    word_finder(groups) if any(groups) else None  # says at once if a word is empty
    schema = StructType([*df.schema.fields, StructField(name, DataType.fromDDL("array<struct<hits:int,first:int>>"))])
    kind = pa.list_(pa.struct([("hits", pa.int32()), ("first", pa.int32())]))
    lower = "__lower"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = word_finder(groups)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            hits = [[{"hits": n, "first": at} for n, at in find(t.as_py() or "")] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits, kind)], [*batch.schema.names[:-1], name])

    # Spark lowers the text, as everywhere else.
    return in_tasks(df.withColumn(lower, F.lower(F.coalesce(F.col(text), F.lit("")))), run, schema)


def label_by_many_words(
    df: DataFrame, rules: Mapping[str, Sequence[str]] = RULE_WORDS, text: str = "review_text", default: str = "other"
) -> DataFrame:
    """The rows of ``label_by_rules``, at a cost that does not grow with the number of words."""
    names = F.array(*[F.lit(name) for name in rules])

    def result(hits: Column) -> Column:
        scored = F.transform(hits, lambda h, i: F.struct(h["hits"].alias("hits"), (-h["first"]).alias("earlier"), (-i).alias("place")))
        best = F.array_max(scored)
        found = best["hits"] > 0
        return F.struct(F.when(found, F.get(names, -best["place"])).otherwise(default).alias("category"),
                        F.when(found, best["hits"]).otherwise(0).alias("rule_hits"))

    # A word that is not there has no place: it must not win a tie of 0 hits, and cannot, as none has hits then.
    found = find_words(df, list(rules.values()), text, "_hits")
    return found.withColumn("_rule", let(F.col("_hits"), result)).withColumns(
        {"category": F.col("_rule.category"), "rule_hits": F.col("_rule.rule_hits")}).drop("_rule", "_hits")


def keyword_points(df: DataFrame, severe: Sequence[str], medium: Sequence[str], text: str = "review_text", name: str = "keyword_score") -> DataFrame:
    """Adds the points of ``keyword_factor``, at a cost that does not grow with the number of words."""
    found = find_words(df, [severe, medium], text, "_hits")
    some = lambda i: F.get("_hits", F.lit(i))["hits"] > 0
    return found.withColumn(name, F.when(some(0), 25).when(some(1), 15).otherwise(5)).drop("_hits")


def rules_labeler(rules: Mapping[str, Sequence[str]], default: str = "other", text: str = "review_text") -> Callable[[], Labeler]:
    """The rules as a labeler for ``label_with``, with the schema ``category string, rule_hits int``; texts have to be in lower case."""
    rules = {name: list(words) for name, words in rules.items()}

    def make() -> Labeler:
        find, names = word_finder(list(rules.values())), list(rules)

        def label(batch: pa.RecordBatch) -> pa.RecordBatch:
            best = [max(((n, -at, -i) for i, (n, at) in enumerate(find(t.as_py() or ""))), default=(0, 0, 0)) for t in batch.column(text)]
            return pa.RecordBatch.from_arrays([
                pa.array([names[-place] if n else default for n, _, place in best], pa.string()),
                pa.array([n for n, _, _ in best], pa.int32())], ["category", "rule_hits"])

        return label

    return make
