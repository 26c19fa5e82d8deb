from __future__ import annotations

import public_tokenizers
import pytest

TABLES = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

ENGLISH = "the quick report says that it was not ready and they will send another one by the end of this week to all of them"
FRENCH = "le rapport dit que ce n'est pas encore prêt et ils vont en envoyer un autre avant la fin de cette semaine à tous"
GERMAN = "der bericht sagt dass es noch nicht fertig ist und sie bis ende dieser woche einen anderen an alle senden werden"

# Names that operators might use themselves.
EXTRA = ["id", "k", "n", "g", "m", "word", "score", "spans", "ids", "distance", "candidates", "__text", "__row", "label", "part", "members"]


def hard_rows():
    """Null ids and texts, empty and blank texts, copies of rows, one very long text and one very long word."""
    rows = [(1, ENGLISH, "en", "a"), (1, ENGLISH, "en", "a"), (2, None, "en", "a"), (3, "", None, "a"), (4, " \n\t\n ", "en", None),
            (None, ENGLISH + " too", "en", "b"), (5, FRENCH, "fr", "b"), (6, GERMAN, "de", None), (7, "x" * 30000, "en", "b"),
            (8, (ENGLISH + "\n") * 300, "en", "b"), (9, "!!! ### 123", None, None), (10, ENGLISH, "en", "a"), (11, "日本語 \U0001F600 é", None, "c")]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def hard(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in EXTRA])


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
