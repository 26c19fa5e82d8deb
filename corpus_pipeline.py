"""From documents to training tokens: five stages, each a call of one operator of ``plaintide.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``, with one row for each document they keep.

Nulls, empty texts, repeated rows and further columns pass through every stage
as its docstring says; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaintide.llm import decontamination, language_id, ngram_join, personal_data, sentence_pieces
from plaintide.llm.common import saved
from plaintide.session import shared_dir

PIECES = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least share of the probability that the predicted language has in a document that stays.
LEAST_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told: no text, no letter, or no language ahead of the others.

    The model learns from ``lang`` of the same documents; the labels stay as
    they are. Each copy of a row is judged alike.
    """
    fitted = language_id.train(docs, PIECES)
    found = language_id.predict(docs, fitted, keep=tuple(c for c in COLUMNS if c != "doc_id"))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles (Jaccard 0.8 or more) the one with the smallest id stays.

    Rows are told apart by their place in the table, so that null and repeated
    ids do no harm; a null id counts as the largest. Texts without words are
    linked with nothing and stay.
    """
    # Written once: a later scan may be cut otherwise, and then the same number names another row.
    rows = saved(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()), "rows")
    groups, _ = ngram_join.shingle_components(rows, id_col="__row", percent=80, size=5)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    named = groups.join(rows.select("__row", "doc_id"), "__row")
    first = named.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.__row").alias("__row"))
    return rows.join(first, "__row", "left_semi").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of ``benchmark``; null texts hold none."""
    others = tuple(c for c in COLUMNS if c != "doc_id")
    found = decontamination.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=others)
    return found.where(F.size("leaks") == 0).select(*COLUMNS)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text by its kind in brackets and counts ``n_chars`` anew where the text changed.

    All documents stay; a null text stays null.
    """
    # Written once: the patterns are not matched again for the redaction.
    found = saved(personal_data.candidates(docs, keep=COLUMNS), "candidates")
    spans = found.withColumn("spans", personal_data.kept_spans(personal_data.fit(found)))
    # Under a name of its own: an expression over "text" beside a new "text" may be given the new one.
    found = spans.withColumn("__redacted", personal_data.redact(F.col("text"), F.col("spans")))
    size = F.when(F.size("spans") > 0, F.length("__redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("__redacted").alias("text"), "lang", "source", size.alias("n_chars"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``documents`` with ``ids`` and ``n_pieces``; null texts have null ids."""
    found = sentence_pieces.encode(docs, PIECES, keep=tuple(c for c in COLUMNS if c != "doc_id"))
    return found.select(*COLUMNS, "n_pieces", "ids")


STAGES = [
    ("language_id", language),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminated),
    ("personal_data", redacted),
    ("sentence_pieces", encoded),
]

#: SQL can express neither the fitted stages nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each through a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
