"""One query for each operator, over its whole table, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontamination, language_id, licences, merkle, ngram_join, passages, personal_data, quality_classifier, quality_rules, sentence_pieces,
               spelling, token_counts, twins, urls)
from .common import documents, held_out, saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text (a ``▁`` in it being a blank)."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = sentence_pieces.encode(documents(spark, sf_dir), model, keep=("text",))
    back = sentence_pieces.decode(ids, model, keep=("text", "ids", "n_pieces"), out_col="decoded")
    plain = F.replace("text", F.lit(sentence_pieces.MARK), F.lit(" "))
    return back.select("doc_id", "n_pieces", "ids", F.col("decoded").eqNullSafe(plain).alias("round_trip"))


@query
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line, paragraph or text that is like a licence template."""
    return licences.licences(documents(spark, sf_dir))


@query
def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that an earlier document has too."""
    return passages.repeated_passages(documents(spark, sf_dir))


def _licence_sql() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(n)}, [{', '.join(map(quoted, sorted(licences.bigrams(licences.words(t)))))}])"
                      for n, t in sorted(licences.TEMPLATES.items()))
    return f"""
WITH known(licence, k) AS (VALUES {known}),
split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS p FROM documents),
parts AS (
  SELECT doc_id, 'line' AS scope, unnest(range(len(l))) AS part, unnest(l) AS t FROM split
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(range(len(p))), unnest(p) AS t FROM split) WHERE contains(t, chr(10))
  UNION ALL SELECT doc_id, 'text', 0, text FROM split WHERE len(p) > 1),
worded AS (SELECT doc_id, scope, part, string_split(trim(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM parts),
paired AS (SELECT doc_id, scope, part, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM worded),
scored AS (SELECT doc_id, scope, part, licence, len(list_intersect(b, k)) * 2.0::DOUBLE / (len(b) + len(k)) AS dice
  FROM paired, known WHERE len(b) > 0 AND 200 * least(len(b), len(k)) >= 80 * (len(b) + len(k)))
SELECT doc_id, scope, CAST(part AS INTEGER) AS part, licence, dice FROM scored WHERE dice * 100 >= 80
QUALIFY row_number() OVER (PARTITION BY doc_id, scope, part ORDER BY dice DESC, licence) = 1"""


ORACLES["op2_licences"] = _licence_sql()


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage in a document: item, place and edits."""
    found = decontamination.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs, model = documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")
    fitted = language_id.train(docs.where(~held_out("doc_id")), model)
    found = language_id.predict(docs, fitted)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and whether the rules keep it."""
    return quality_rules.quality_rules(documents(spark, sf_dir))


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of every document and the smallest document it is linked with."""
    return ngram_join.shingle_components(documents(spark, sf_dir))[0]


ORACLES["op7_ngram_join"] = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                          ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
    FROM worded)),
sizes AS (SELECT doc_id, count(s) AS n FROM documents LEFT JOIN sets USING (doc_id) GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reached.a, both_ways.b FROM reached JOIN both_ways ON reached.b = both_ways.a)
SELECT a AS doc_id, CAST(max(n) AS BIGINT) AS n_shingles, min(b) AS component_id FROM reached JOIN sizes ON sizes.doc_id = a GROUP BY a"""


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and the longest prefix of at most 1024 tokens."""
    counts = token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), budget=1024)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "within")


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base spans, their digest, and all spans of every document."""
    found = saved(personal_data.candidates(documents(spark, sf_dir), keep=("doc_id",)), "candidates")
    model = personal_data.fit(found)
    base = F.filter("candidates", lambda c: c["o"] < len(personal_data.BASE))
    count = lambda k: F.size(F.filter("candidates", lambda c: c["o"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(personal_data.BASE)],
        F.sha2(personal_data.listed(base), 256).alias("base_sha256"),
        personal_data.listed(personal_data.kept_spans(model)).alias("spans"))


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of documents that are not held out."""
    scored, _ = quality_classifier.quality_classifier(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=~held_out("id"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    found = urls.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "host", "path", "rule", "verdict")


ORACLES["op11_url_filter"] = twins.url_filter_sql()


@query
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and checked witness of every document, with the texts of a fifth of them tampered with."""
    lowered = F.translate("text", urls.UPPER, urls.LOWER)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(documents(spark, sf_dir), F.when(tampered, lowered).otherwise(F.col("text")))


ORACLES["op12_manifest"] = twins.manifest_sql()


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every frequent word of all documents."""
    return spelling.spelling_variants(spelling.vocabulary(documents(spark, sf_dir)))


ORACLES["op13_spelling_variants"] = twins.spelling_sql()
