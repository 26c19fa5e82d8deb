"""The driver tables read as reviews, labels, votes, answers and pages.

Each Spark fixture has a SQL twin of the same name in ``SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.knn import knn_retrieve, knn_votes
from ..session import cut_lineage

DOC_AS_OF = "2024-01-31 00:00:00"

# Parameters in place of the word lists, which match nothing in these texts.
DOC_SEVERE = ["license", "und "]
DOC_MEDIUM = ["tion"]
DOC_KEYS = ["good", "bad"]
DOC_RULES = {
    "delivery_delay": ["the ", "thin"],
    "wrong_item": ["und ", "sch"],
    "poor_quality": ["tion", "eau"],
    "size_issue": ["que ", "los "],
    "price_issue": ["license", "copyright"],
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


SQL: dict[str, str] = {}


def with_fixtures(names: str, body: str) -> str:
    """``body`` with the SQL twins of the named fixtures in front."""
    parts = ",\n".join(f"{name} AS ({SQL[name]})" for name in names.split())
    return f"WITH {parts}\n{body}"


# Blank characters as in functions.text, for RE2 patterns.
BLANK_SQL = (
    r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def strip_sql(expression: str) -> str:
    return f"regexp_replace({expression}, '^{BLANK_SQL}+|{BLANK_SQL}+$', '', 'g')"


# --- categorized reviews with real dates -----------------------------------

SQL["f_ord"] = """
SELECT o_orderkey AS review_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rating,
       o_orderdate AS created_at, c_mktsegment || '|' || n_name AS category,
       o_orderstatus || ' ' || o_orderpriority AS brief_issue
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
            LEFT JOIN nation ON c_nationkey = n_nationkey"""


def f_ord(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer, nation = (table(spark, folder, n) for n in ("orders", "customer", "nation"))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("o_orderkey").alias("review_id"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"),
            F.col("o_orderdate").alias("created_at"),
            F.concat("c_mktsegment", F.lit("|"), "n_name").alias("category"),
            F.concat("o_orderstatus", F.lit(" "), "o_orderpriority").alias("brief_issue"),
        )
    )


# Negative reviews of the last 90 days and the 90 days before.
SQL["neg_ord"] = "SELECT * FROM f_ord WHERE rating <= 3"
SQL["per_ord"] = """
SELECT n.*, CASE WHEN created_at >= mx - INTERVAL 90 DAY THEN 'recent' ELSE 'comparison' END AS period
FROM neg_ord n, (SELECT max(created_at) AS mx FROM neg_ord)
WHERE created_at >= mx - INTERVAL 180 DAY"""
ORD = "f_ord neg_ord per_ord"

# --- text reviews with synthetic dates -------------------------------------

SQL["f_doc"] = f"""
SELECT doc_id AS review_id, text AS review_text, CAST(doc_id % 5 + 1 AS INTEGER) AS rating,
       TIMESTAMP '{DOC_AS_OF}' - to_days(CAST(doc_id % 60 AS INTEGER)) AS created_at,
       source, lang
FROM documents"""


def f_doc(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("review_id"),
        F.col("text").alias("review_text"),
        (F.col("doc_id") % 5 + 1).cast("int").alias("rating"),
        (
            F.lit(DOC_AS_OF).cast("timestamp_ntz")
            - F.make_dt_interval(days=(F.col("doc_id") % 60).cast("int"))
        ).alias("created_at"),
        "source", "lang",
    )


def _any_sql(words: list[str]) -> str:
    return " OR ".join(f"contains(lower(review_text), '{word}')" for word in words)


SQL["factors"] = f"""
SELECT *,
  CASE rating WHEN 1 THEN 40 WHEN 2 THEN 25 WHEN 3 THEN 10 ELSE 0 END AS rating_score,
  CASE WHEN length(review_text) >= 200 THEN 20 WHEN length(review_text) >= 100 THEN 12
       WHEN length(review_text) >= 50 THEN 6 ELSE 2 END AS length_score,
  CASE WHEN {_any_sql(DOC_SEVERE)} THEN 25 WHEN {_any_sql(DOC_MEDIUM)} THEN 15 ELSE 5 END AS keyword_score,
  CASE WHEN created_at IS NULL THEN 8
       WHEN created_at >= TIMESTAMP '{DOC_AS_OF}' - INTERVAL 1 DAY THEN 15
       WHEN created_at >= TIMESTAMP '{DOC_AS_OF}' - INTERVAL 3 DAY THEN 10
       WHEN created_at >= TIMESTAMP '{DOC_AS_OF}' - INTERVAL 7 DAY THEN 5 ELSE 2 END AS recency_score
FROM f_doc"""
SQL["summed"] = "SELECT *, rating_score + length_score + keyword_score + recency_score AS score FROM factors"
SQL["scored"] = """
SELECT *, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high'
               WHEN score >= 40 THEN 'medium' ELSE 'low' END AS level FROM summed"""
SCORED = "f_doc factors summed scored"
SCORING = {"as_of": DOC_AS_OF, "severe": DOC_SEVERE, "medium": DOC_MEDIUM}

# --- hand labels with text --------------------------------------------------

SQL["f_raw"] = """
SELECT doc_id AS review_id, text AS review_text, doc_id % 5 + 1.0::DOUBLE AS rating,
       CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 THEN '  TOXIC '
            WHEN quality = 1 THEN 'Good' WHEN lang = 'de' THEN ' ' ELSE ' bad' || chr(9) END AS manual_label
FROM documents LEFT JOIN labels USING (doc_id)"""


def f_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as people type them: mixed case, blanks, unknown keys, gaps."""
    quality = F.col("quality")
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("review_id"),
        F.col("text").alias("review_text"),
        (F.col("doc_id") % 5 + 1).cast("double").alias("rating"),
        F.when(quality.isNull(), None).when(F.col("toxic") == 1, "  TOXIC ").when(quality == 1, "Good")
        .when(F.col("lang") == "de", " ").otherwise(" bad\t").alias("manual_label"),
    )


SQL["f_err_all"] = """
SELECT d.doc_id AS review_id, text AS review_text,
       CASE WHEN lang <> 'fr' THEN CAST(d.doc_id % 5 + 1 AS DOUBLE) END AS rating,
       'q' || quality || 't' || toxic AS true_label,
       'q' || (CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) || 't' || (CASE WHEN lang = 'de' THEN 1 ELSE 0 END)
         AS predicted_label
FROM documents d JOIN labels USING (doc_id)"""
SQL["f_err"] = "SELECT * FROM f_err_all WHERE true_label <> predicted_label"
ERR = "f_err_all f_err"


def f_err_all(spark: SparkSession, folder: str) -> DataFrame:
    """Labeled texts with a prediction made from length and language."""
    def flag(condition):
        return F.when(condition, "1").otherwise("0")

    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").select(
        F.col("doc_id").alias("review_id"),
        F.col("text").alias("review_text"),
        F.when(F.col("lang") != "fr", (F.col("doc_id") % 5 + 1).cast("double")).alias("rating"),
        F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))
        .alias("true_label"),
        F.concat(F.lit("q"), flag(F.col("n_chars") > 1000), F.lit("t"), flag(F.col("lang") == "de"))
        .alias("predicted_label"),
    )


def f_err(spark: SparkSession, folder: str) -> DataFrame:
    return f_err_all(spark, folder).filter(F.col("true_label") != F.col("predicted_label"))


# --- embeddings: neighbours, predictions, votes -----------------------------

SQL["f_knn"] = """
SELECT * FROM (
  SELECT q.vec_id AS review_id, c.vec_id AS neighbor_id, CAST(c.label AS VARCHAR) AS category,
         list_sum(list_transform(list_zip(q.embedding, c.embedding),
                  lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS distance
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id)
QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY distance, neighbor_id) <= 5"""
SQL["f_near"] = """
SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY distance, neighbor_id) AS neighbor_rank FROM f_knn"""
SQL["knn_agents"] = "SELECT * FROM (VALUES (0, 1), (1, 3), (2, 5)) a(agent_id, k)"
SQL["knn_counts"] = """
SELECT review_id, agent_id, category, count(*) AS n, min(neighbor_rank) AS nearest, max(k) AS k
FROM f_near JOIN knn_agents ON neighbor_rank <= k GROUP BY ALL"""
SQL["knn_counts"] = SQL["knn_counts"].replace("GROUP BY ALL", "GROUP BY review_id, agent_id, category")
SQL["f_vote"] = """
SELECT review_id, agent_id, category, n / k AS confidence FROM knn_counts
QUALIFY row_number() OVER (PARTITION BY review_id, agent_id ORDER BY n DESC, nearest) = 1"""
SQL["f_eval"] = """
SELECT vec_id AS review_id, CAST(label AS VARCHAR) AS true_label, category AS predicted_label
FROM embeddings JOIN f_near ON vec_id = review_id WHERE neighbor_rank = 1"""
SQL["f_eval5"] = """
SELECT vec_id AS review_id, CAST(label AS VARCHAR) AS true_label, category AS predicted_label
FROM embeddings JOIN f_vote ON vec_id = review_id WHERE agent_id = 2"""
NEAR = "f_knn f_near"
VOTES = f"{NEAR} knn_agents knn_counts f_vote"
EVAL = f"{NEAR} f_eval"
EVAL5 = f"{VOTES} f_eval f_eval5"


def f_near(spark: SparkSession, folder: str, k: int = 5, **options) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    queries = vectors.select(F.col("vec_id").alias("review_id"), "embedding")
    examples = vectors.select(
        F.col("vec_id").alias("neighbor_id"), "embedding", F.col("label").cast("string").alias("category")
    )
    return knn_retrieve(queries, examples, k, skip_self=True, **options)


def f_vote(spark: SparkSession, folder: str) -> DataFrame:
    return knn_votes(f_near(spark, folder), [1, 3, 5])


def _with_truth(spark: SparkSession, folder: str, predictions: DataFrame) -> DataFrame:
    truth = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("review_id"), F.col("label").cast("string").alias("true_label")
    )
    return truth.join(predictions.select("review_id", F.col("category").alias("predicted_label")), "review_id")


def f_eval(spark: SparkSession, folder: str, near: DataFrame | None = None) -> DataFrame:
    """True label against the nearest other vector's label; ``near`` may hold more neighbours."""
    nearest = f_near(spark, folder, 1) if near is None else near.filter(F.col("neighbor_rank") == 1)
    return _with_truth(spark, folder, nearest)


def f_eval5(spark: SparkSession, folder: str, near: DataFrame | None = None) -> DataFrame:
    """True label against the majority of five neighbours."""
    return _with_truth(spark, folder, knn_votes(f_near(spark, folder) if near is None else near, [5]))


def f_evals(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``f_eval`` and ``f_eval5`` by one search, whose neighbours are written once."""
    near = cut_lineage(f_near(spark, folder))
    return f_eval(spark, folder, near), f_eval5(spark, folder, near)


# --- events: a long table of categories, votes and runs ---------------------

SQL["ev_vote"] = """
SELECT event_id // 3 AS review_id, CAST(event_id % 3 AS INTEGER) AS agent_id, event_type AS category,
       CASE WHEN value > 64 THEN NULL ELSE value / 64 END AS confidence
FROM events"""


def ev_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Three events in a row as three agents' votes, some without confidence."""
    return table(spark, folder, "events").select(
        F.expr("event_id div 3").alias("review_id"),
        (F.col("event_id") % 3).cast("int").alias("agent_id"),
        F.col("event_type").alias("category"),
        F.when(F.col("value") > 64, None).otherwise(F.col("value") / 64).alias("confidence"),
    )


# --- raw answers -------------------------------------------------------------


def wrapped(body, kind):
    """An answer text around a JSON body, in one of four habits of models."""
    return (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("Sure.\n```json\n"), body, F.lit("\n```\nDone {ok}.")))
        .when(kind == 2, F.concat(F.lit("Here is the result: "), body, F.lit(" done.")))
        .otherwise(F.regexp_replace(body, r"\}$", ", }"))
    )


def f_resp(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that categorize ten orders each."""
    item = F.struct(
        (F.col("review_id") % 10 + 1).cast("int").alias("review_number"), "category", "brief_issue"
    )
    batches = (
        f_ord(spark, folder).groupBy(F.expr("review_id div 10").alias("batch"))
        .agg(F.sort_array(F.collect_list(item)).alias("categories"))
    )
    body = F.to_json(F.struct("categories"))
    return batches.select("batch", wrapped(body, F.col("batch") % 4).alias("answer"))


def f_reply(spark: SparkSession, folder: str) -> DataFrame:
    """Batch answers with a reply per document; some carry no index."""
    index = F.col("review_id") % 10 + 1
    reply = F.struct(
        F.col("review_id").alias("_order"),
        F.when(F.col("lang") != "de", index.cast("int")).alias("review_index"),
        F.concat(F.lit("re: "), "source").alias("reply"),
        F.col("lang").alias("tone"),
        F.array("source", "lang").alias("key_points_addressed"),
        F.col("rating").cast("string").alias("suggested_action"),
    )
    batches = (
        f_doc(spark, folder).groupBy(F.expr("review_id div 10").alias("batch"))
        .agg(F.sort_array(F.collect_list(reply)).alias("_replies"))
    )
    replies = F.transform("_replies", lambda r: r.dropFields("_order")).alias("replies")
    body = F.to_json(F.struct(replies))
    return batches.select(
        "batch", (F.col("batch") * 10).alias("chunk_start"),
        wrapped(body, F.col("batch") % 4).alias("answer"),
    )


def f_vote_answers(spark: SparkSession, folder: str) -> DataFrame:
    """One answer per event: a vote, a vote without category, or no JSON at all."""
    body = F.to_json(F.struct(
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("category"),
        F.when(F.col("value") <= 64, F.col("value") / 64).alias("confidence"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("reasoning"),
    ))
    answer = F.when(F.col("event_type") == "view", F.lit("I cannot answer {that")).otherwise(
        wrapped(body, F.col("event_id") % 4)
    )
    return table(spark, folder, "events").select(
        F.expr("event_id div 3").alias("review_id"),
        (F.col("event_id") % 3).cast("int").alias("agent_id"),
        answer.alias("answer"),
    )
