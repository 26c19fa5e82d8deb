"""Queries at the borders: request and response tables, sinks, the full analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, issues, labeling, periods, requests, responses, training
from ..session import cut_lineage, new_path
from ..sources import results, tables
from . import composites, fixtures as fx, jobs
from .catalog_labels import _CHAT_SQL, _SPLIT, _split, _union
from .fixtures import NEAR, ORD, SCORED, strip_sql, table, with_fixtures
from .registry import query

# --- requests ----------------------------------------------------------------------

fx.SQL["neg_doc"] = "SELECT * FROM f_doc WHERE rating <= 3"
fx.SQL["per_doc"] = """
SELECT n.*, CASE WHEN created_at >= mx - INTERVAL 30 DAY THEN 'recent' ELSE 'comparison' END AS period
FROM neg_doc n, (SELECT max(created_at) AS mx FROM neg_doc) WHERE created_at >= mx - INTERVAL 60 DAY"""
_REQUEST = """
SELECT {group}, count(*) AS review_count,
       string_agg(k || '. ' || substr(review_text, 1, 500), chr(10) || '---' || chr(10) ORDER BY k) AS request_text
FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY created_at DESC, review_id) AS k FROM per_doc)
WHERE k <= 200 GROUP BY {group}"""


def _doc_periods(spark, folder):
    return periods.split_by_period(filters.filter_negative(fx.f_doc(spark, folder)))


@query("build_category_requests", with_fixtures("f_doc neg_doc per_doc", _REQUEST.format(group="period")))
def _(spark, folder):
    return requests.build_category_requests(_doc_periods(spark, folder), ["period"])


@query("build_category_requests_per_source", with_fixtures("f_doc neg_doc per_doc", _REQUEST.format(group="source, period")))
def _(spark, folder):
    return requests.build_category_requests(_doc_periods(spark, folder), ["source", "period"])


@query("build_reply_requests", with_fixtures("f_doc", """
SELECT p // 10 AS batch, p // 10 * 10 AS chunk_start, count(*) AS review_count,
       string_agg(chr(10) || '### 리뷰 ' || (p % 10 + 1) || ' (평점: ' || rating || '점)' ||
                  CASE WHEN lang = 'de' THEN '' ELSE ' [카테고리: ' || lang || ']' END ||
                  chr(10) || review_text || chr(10), '' ORDER BY p) AS request_text
FROM (SELECT *, row_number() OVER (ORDER BY review_id) - 1 AS p FROM f_doc WHERE rating <= 3)
GROUP BY p // 10"""))
def _(spark, folder):
    negative = filters.filter_negative(fx.f_doc(spark, folder))
    return requests.build_reply_requests(
        negative.withColumn("category", F.when(F.col("lang") != "de", F.col("lang")))
    )


@query("build_knn_requests", with_fixtures(f"{NEAR}", """
SELECT d.doc_id AS review_id, coalesce(example_count, 0) AS example_count,
       CASE WHEN examples IS NULL THEN '' ELSE 'Similar examples from past reviews:' || chr(10) || chr(10) || examples END ||
       chr(10) || chr(10) || 'Now, categorize this new review:' || chr(10) || chr(10) || 'Review: "' || d.text || '"' AS request_text
FROM documents d LEFT JOIN (
  SELECT review_id, count(*) AS example_count,
         string_agg(neighbor_rank || '. Review: "' || substr(text, 1, 150) || '..."' || chr(10) ||
                    '   Category: ' || category || chr(10) || chr(10), '' ORDER BY neighbor_rank) AS examples
  FROM f_near JOIN documents ON neighbor_id = doc_id WHERE neighbor_rank <= 3 GROUP BY review_id
) ON d.doc_id = review_id"""))
def _(spark, folder):
    docs = table(spark, folder, "documents")
    reviews = docs.select(F.col("doc_id").alias("review_id"), F.col("text").alias("review_text"))
    examples = docs.select(F.col("doc_id").alias("neighbor_id"), F.col("text").alias("example_text"))
    return requests.build_knn_requests(reviews, fx.f_near(spark, folder, 3), examples)


# --- responses -----------------------------------------------------------------------


@query("ingest_model_responses", with_fixtures("f_ord", """
SELECT review_id // 10 AS batch, CAST(review_id % 10 + 1 AS INTEGER) AS review_number, category, brief_issue,
       CAST(row_number() OVER (PARTITION BY review_id // 10 ORDER BY review_id) - 1 AS INTEGER) AS item_pos
FROM f_ord"""))
def _(spark, folder):
    return responses.ingest_model_responses(fx.f_resp(spark, folder))


@query("response_quarantine", """
SELECT event_id // 3 AS review_id, CAST(event_id % 3 AS INTEGER) AS agent_id, 'I cannot answer {that' AS answer
FROM events WHERE event_type = 'view'""")
def _(spark, folder):
    return responses.quarantine(fx.f_vote_answers(spark, folder))


@query("answered_issues", with_fixtures("f_doc neg_doc per_doc", """
SELECT category, n, round_even(n / total * 100, 1) AS percentage FROM (
  SELECT lang AS category, count(*) AS n, min(review_id) AS first, sum(count(*)) OVER () AS total FROM (
    SELECT *, row_number() OVER (PARTITION BY source, period ORDER BY created_at DESC, review_id) AS place FROM per_doc)
  WHERE place <= 200 GROUP BY lang)
ORDER BY n DESC, first LIMIT 3"""))
def _(spark, folder):
    """Requests are numbered, answered, and the answers brought back to their reviews and counted."""
    group, reviews = ["source", "period"], _doc_periods(spark, folder)
    numbers = requests.request_numbers(reviews, group)
    # The answer names the language of each review as its category.
    item = F.struct("review_number", F.col("lang").alias("category"), F.col("source").alias("brief_issue"))
    answers = numbers.join(reviews.select("review_id", "lang"), "review_id").groupBy(*group).agg(
        F.concat(F.lit("Here you are: "), F.to_json(F.struct(F.collect_list(item).alias("categories")))).alias("answer"))
    found = requests.attach_answers(responses.ingest_model_responses(answers), numbers, group)
    return issues.top_issues(found, order="review_id").drop("examples")


@query("response_quarantine_shapes", with_fixtures("f_ord", """
SELECT review_id, CASE review_id % 7 WHEN 1 THEN 'no_array' WHEN 2 THEN 'no_array' WHEN 3 THEN 'empty_array' ELSE 'no_json' END AS reason
FROM f_ord WHERE review_id % 7 BETWEEN 1 AND 4"""))
def _(spark, folder):
    """Answers in many shapes; those that give rows are in ``ingest_odd_responses``."""
    return responses.quarantine_with_reason(_odd_answers(spark, folder)).select("review_id", "reason")


@query("ingest_odd_responses", with_fixtures("f_ord", """
SELECT review_id, CAST(review_id % 7 AS INTEGER) AS review_number, category FROM f_ord WHERE review_id % 7 NOT BETWEEN 1 AND 4"""))
def _(spark, folder):
    """Numbers as numbers, in quotes and with a decimal point."""
    return responses.ingest_model_responses(_odd_answers(spark, folder)).select("review_id", "review_number", "category")


def _odd_answers(spark, folder):
    kind = F.col("review_id") % 7
    number = F.when(kind == 0, F.lit('"0"')).when(kind == 5, F.lit("5.0")).otherwise(kind.cast("string"))
    item = F.concat(F.lit('{"review_number": '), number, F.lit(', "category": "'), "category", F.lit('"}'))
    answer = (
        F.when(kind == 1, F.concat(F.lit('{"categories": '), item, F.lit("}"))).when(kind == 2, F.concat(F.lit("["), item, F.lit("]")))
        .when(kind == 3, F.lit('{"categories": []}')).when(kind == 4, F.concat(F.lit("Sorry, "), "category"))
        .otherwise(F.concat(F.lit('{"categories": ['), item, F.lit("]}")))
    )
    return fx.f_ord(spark, folder).select("review_id", answer.alias("answer"))


@query("ingest_reply_responses", with_fixtures("f_doc", """
SELECT review_id // 10 AS batch, review_id // 10 * 10 AS chunk_start,
       review_id // 10 * 10 + CASE WHEN lang = 'de' THEN 1 ELSE review_id % 10 + 1 END AS review_index,
       're: ' || source AS reply, lang AS tone, source || ', ' || lang AS key_points, CAST(rating AS VARCHAR) AS suggested_action
FROM f_doc"""))
def _(spark, folder):
    replies = responses.ingest_reply_responses(fx.f_reply(spark, folder))
    return replies.withColumn("key_points", F.array_join("key_points_addressed", ", ")).drop("key_points_addressed")


@query("ingest_single_replies", """
SELECT doc_id AS review_id,
       CASE WHEN lang = 'de' THEN text ELSE source END AS reply,
       CASE WHEN lang = 'de' THEN '' ELSE lang END AS tone,
       CASE WHEN lang = 'de' THEN '' ELSE source || ', ' || lang END AS key_points,
       CASE WHEN lang = 'de' THEN '' ELSE 'call' END AS suggested_action
FROM documents""")
def _(spark, folder):
    body = F.to_json(F.struct(
        F.col("source").alias("reply"), F.col("lang").alias("tone"),
        F.array("source", "lang").alias("key_points_addressed"), F.lit("call").alias("suggested_action"),
    ))
    answers = table(spark, folder, "documents").select(
        F.col("doc_id").alias("review_id"),
        F.when(F.col("lang") == "de", F.col("text")).otherwise(fx.wrapped(body, F.col("doc_id") % 4)).alias("answer"),
    )
    replies = responses.ingest_single_replies(answers)
    return replies.withColumn("key_points", F.array_join("key_points_addressed", ", ")).drop("key_points_addressed")


fx.SQL["ev_answer"] = """
SELECT event_id // 3 AS review_id, CAST(event_id % 3 AS INTEGER) AS agent_id, event_type,
       CASE WHEN value <= 64 THEN value / 64 END AS confidence, 'user ' || user_id AS reasoning
FROM events"""


@query("ingest_knn_responses", with_fixtures("ev_answer", """
SELECT review_id, agent_id,
       CASE WHEN event_type IN ('view', 'error') THEN 'other' ELSE event_type END AS category,
       CASE WHEN event_type IN ('view', 'error') THEN 'Error during analysis' ELSE reasoning END AS brief_issue,
       CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE coalesce(confidence, 0) END AS confidence
FROM ev_answer"""))
def _(spark, folder):
    return responses.ingest_knn_responses(fx.f_vote_answers(spark, folder))


@query("ingest_vote_responses", with_fixtures("ev_answer", """
SELECT review_id, agent_id, event_type AS category, confidence, reasoning FROM ev_answer
WHERE event_type NOT IN ('view', 'error')"""))
def _(spark, folder):
    return responses.ingest_vote_responses(fx.f_vote_answers(spark, folder))


# --- sinks: written to the shared folder and read back ----------------------------------


@query("write_reviews_csv", with_fixtures("f_doc", """
SELECT CAST(rating AS VARCHAR) AS "Ratings", review_text AS "Reviews" FROM f_doc"""))
def _(spark, folder):
    path = tables.write_reviews_csv(fx.f_doc(spark, folder), new_path(spark, "reviews_out"))
    return tables.read_csv_text(spark, path)


@query("write_labeling_csv", with_fixtures("f_doc", """
SELECT CAST(review_id AS VARCHAR) AS review_id, review_text, CAST(rating AS VARCHAR) AS rating,
       CAST(NULL AS VARCHAR) AS manual_label, CAST(NULL AS VARCHAR) AS notes FROM f_doc WHERE rating <= 3
ORDER BY md5(review_id || '-42'), f_doc.review_id LIMIT 100"""))
def _(spark, folder):
    sample = training.sample_for_labeling(filters.filter_negative(fx.f_doc(spark, folder)))
    path = tables.write_labeling_csv(sample, new_path(spark, "labeling"))
    read = tables.read_csv_text(spark, path)
    return read.select(*[tables.null_if_token(F.col(name), [""]).alias(name) for name in read.columns])


@query("write_chat_jsonl", with_fixtures(f"{_SPLIT} chat_lines", "SELECT part, line FROM chat_lines")
       if fx.SQL.setdefault("chat_lines", _CHAT_SQL) else None)
def _(spark, folder):
    paths = results.write_chat_jsonl(_split(spark, folder), new_path(spark, "chat"))
    parts = [spark.read.text(path).select(F.lit(part), "value") for part, path in paths.items()]
    return _union(parts, "part", "line")


@query("write_metrics_json", """
SELECT event_type AS metric, count(*) AS n, kind, 'run_2' AS run_id
FROM events CROSS JOIN (VALUES ('baseline'), ('final')) k(kind) GROUP BY event_type, kind""")
def _(spark, folder):
    """Two runs of two kinds are written; the last run of each is read back."""
    path = new_path(spark, "metrics")
    counts = table(spark, folder, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    for kind in ("baseline", "final"):
        for run in ("run_1", "run_2"):
            shown = counts if run == "run_2" else counts.withColumn("n", F.lit(0))
            results.write_metrics_json(shown, path, kind, run)
    return results.read_latest_metrics(spark, path, "metric string, n bigint")


@query("rewritten_metrics", """
SELECT event_type AS metric, count(*) AS n, 'a/b=c' AS kind, 'run 1' AS run_id FROM events WHERE event_type <> 'view' GROUP BY event_type""")
def _(spark, folder):
    """One run is written twice, the second time with fewer rows: these are its rows."""
    path = new_path(spark, "metrics")
    counts = table(spark, folder, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    for rows in (counts, counts.where("metric <> 'view'")):
        results.write_metrics_json(rows, path, "a/b=c", "run 1")
    return results.read_latest_metrics(spark, path, "metric string, n bigint")


@query("unknown_answers", with_fixtures("f_doc neg_doc per_doc", """
SELECT source, period, place + 1000 AS review_number, 'unknown number' AS reason FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY source, period ORDER BY created_at DESC, review_id) AS INTEGER) AS place FROM per_doc)
WHERE place <= 200 AND place % 10 = 3
UNION ALL SELECT source, period, NULL, 'no number' FROM (
  SELECT *, row_number() OVER (PARTITION BY source, period ORDER BY created_at DESC, review_id) AS place FROM per_doc)
WHERE place <= 200 AND place % 10 = 7"""))
def _(spark, folder):
    """Every tenth answer stands under a number that was not asked for, every tenth under none."""
    group = ["source", "period"]
    numbers = requests.request_numbers(_doc_periods(spark, folder), group)
    kind = F.col("review_number") % 10
    items = numbers.select(*group, F.when(kind == 3, F.col("review_number") + 1000).when(kind == 7, F.lit(None).cast("int"))
                           .otherwise(F.col("review_number")).alias("review_number"), F.lit("x").alias("category"))
    return requests.unknown_answers(items, numbers, group).drop("category")


@query("unanswered_reviews", with_fixtures("f_doc neg_doc per_doc", """
SELECT review_id, 'other' AS category FROM (
  SELECT *, row_number() OVER (PARTITION BY source, period ORDER BY created_at DESC, review_id) AS place FROM per_doc)
WHERE place <= 200 AND place % 10 IN (3, 7)"""))
def _(spark, folder):
    """The reviews that no answer is about."""
    group = ["source", "period"]
    numbers = requests.request_numbers(_doc_periods(spark, folder), group)
    items = numbers.where("review_number % 10 not in (3, 7)").select(*group, "review_number")
    return requests.unanswered(items, numbers, group).select("review_id", "category")


def _even_or_odd():
    """A labeler that tells texts of an even from those of an odd number of characters."""
    def label(batch):
        return ["good" if len(t or "") % 2 == 0 else "bad" for t in batch.column("review_text").to_pylist()]

    return label


fx.SQL["job_pairs"] = f"""
SELECT review_id, lower({strip_sql('manual_label')}) AS t, CASE WHEN length(review_text) % 2 = 0 THEN 'good' ELSE 'bad' END AS p
FROM f_raw WHERE lower({strip_sql('manual_label')}) IN ('good', 'bad')"""


def _labeled_csv(spark, folder):
    rows = fx.f_raw(spark, folder).select("review_id", "review_text", "rating", "manual_label", F.lit("").alias("notes"))
    return tables.write_labeling_csv(rows, new_path(spark, "labeled_csv"))


@query("evaluate_csv", with_fixtures("f_raw job_pairs", """
SELECT 'per_class' AS part, t AS name, count(*) AS n FROM job_pairs GROUP BY t
UNION ALL SELECT 'confusion', a.t || '>' || b.t, count(j.t) FROM (SELECT DISTINCT t FROM job_pairs UNION SELECT p FROM job_pairs) a
  CROSS JOIN (SELECT DISTINCT t FROM job_pairs UNION SELECT p FROM job_pairs) b LEFT JOIN job_pairs j ON j.t = a.t AND j.p = b.t GROUP BY a.t, b.t
UNION ALL SELECT 'errors', t || '>' || p, count(*) FROM job_pairs WHERE t <> p GROUP BY t, p
UNION ALL SELECT 'report', t || '>' || p, count(*) FROM job_pairs WHERE t <> p GROUP BY t, p"""))
def _(spark, folder):
    """A labeled CSV is evaluated and its errors analyzed; the result files are read back."""
    out = jobs.evaluate_csv(spark, _labeled_csv(spark, folder), _even_or_odd, new_path(spark, "evaluation"), "run_1", keys=fx.DOC_KEYS)
    read = lambda kind, schema: results.read_latest_metrics(spark, out, schema).where(F.col("kind") == f"baseline_{kind}")
    pair = F.concat("true_label", F.lit(">"), "predicted_label")
    labels = "true_label string, predicted_label string"
    return _union([
        read("per_class", "label string, support bigint").select(F.lit("per_class"), "label", "support"),
        read("confusion", f"{labels}, n bigint").select(F.lit("confusion"), pair, "n"),
        read("errors", labels).groupBy(F.lit("errors"), pair).agg(F.count(F.lit(1))),
        read("report_confusion_pairs", f"{labels}, n bigint").select(F.lit("report"), pair, "n"),
    ], "part", "name", "n")


@query("training_files_csv", with_fixtures(f"{_SPLIT} chat_lines", "SELECT part, line FROM chat_lines"))
def _(spark, folder):
    """A labeled CSV becomes training and validation files."""
    paths = jobs.training_files_csv(spark, _labeled_csv(spark, folder), new_path(spark, "training"), fx.DOC_KEYS)
    parts = [spark.read.text(paths[part]).select(F.lit(part), "value") for part in ("train", "valid")]
    return _union(parts, "part", "line")


# --- the full analysis --------------------------------------------------------------------


def _flat(parts) -> list:
    blank = F.lit("")
    number = F.lit(None).cast("double")
    stats = parts["stats"]
    return [
        stats.select(F.lit("stats"), F.lit("total"), blank, F.col("total_reviews").cast("double")),
        stats.select(F.lit("stats"), F.lit("negative"), blank, F.col("negative_reviews").cast("double")),
        stats.select(F.lit("stats"), F.lit("ratio"), blank, "negative_ratio"),
        parts["rating_distribution"].select(F.lit("rating"), "rating_key", blank, F.col("n").cast("double")),
        parts["top_issues"].select(F.lit("top"), "category", F.array_join("examples", " / "), "percentage"),
        parts["all_categories"].select(F.lit("category"), "category", blank, F.col("n").cast("double")),
        parts["emerging_issues"].select(
            F.lit("emerging"), "category",
            F.concat_ws(">", F.col("comparison_count").cast("string"), F.col("recent_count").cast("string")),
            "increase_rate",
        ),
        parts["priority_reviews"].select(
            F.lit("priority"), F.col("review_id").cast("string"), "level", F.col("score").cast("double")
        ),
    ]


_EMERGING = ORD + " cnt top3 ranked compared surge emerging"
_FULL = """
SELECT 'stats' AS part, 'total' AS name, '' AS detail, CAST(count(*) AS DOUBLE) AS value FROM {all}
UNION ALL SELECT 'stats', 'negative', '', count(*) FROM {all} WHERE rating <= 3
UNION ALL SELECT 'stats', 'ratio', '', round_even(count(*) FILTER (rating <= 3) / count(*) * 100, 1) FROM {all}
UNION ALL SELECT 'rating', CAST(rating AS VARCHAR), '', count(*) FROM {all} GROUP BY rating
UNION ALL SELECT 'top', category, string_agg(brief_issue, ' / ' ORDER BY example_rank), percentage
  FROM top3 JOIN ranked USING (category) WHERE example_rank <= 3 GROUP BY category, percentage
UNION ALL SELECT 'category', category, '', n FROM cnt
UNION ALL SELECT 'emerging', category, comparison_count || '>' || recent_count, increase_rate FROM emerging"""

fx.SQL["ord_score"] = """
SELECT review_id, created_at, CASE rating WHEN 1 THEN 40 WHEN 2 THEN 25 ELSE 10 END + 2 + 5 +
  CASE WHEN created_at >= TIMESTAMP '2001-08-01' - INTERVAL 1 DAY THEN 15
       WHEN created_at >= TIMESTAMP '2001-08-01' - INTERVAL 3 DAY THEN 10
       WHEN created_at >= TIMESTAMP '2001-08-01' - INTERVAL 7 DAY THEN 5 ELSE 2 END AS score
FROM neg_ord"""


# The analysis looks at reviews from the newest on: so do its examples and ties.
_NEWEST = "struct_pack(a := -epoch_us(created_at), k := review_id)"
for _name in ("cnt", "ranked", "compared"):
    fx.SQL[f"n_{_name}"] = fx.SQL[_name].replace("min(review_id)", f"min({_NEWEST})").replace("ORDER BY review_id", "ORDER BY created_at DESC, review_id")
fx.SQL["n_top3"] = fx.SQL["top3"].replace("cnt", "n_cnt")
fx.SQL["n_surge"] = fx.SQL["surge"].replace("compared", "n_compared")
fx.SQL["n_emerging"] = fx.SQL["emerging"].replace("FROM surge", "FROM n_surge")
_ORD_FULL = _FULL.format(all="f_ord")
for _name in ("top3", "ranked", "cnt", "emerging"):
    _ORD_FULL = _ORD_FULL.replace(f"FROM {_name}", f"FROM n_{_name}").replace(f"JOIN {_name}", f"JOIN n_{_name}")


@query("full_analysis", with_fixtures(f"{ORD} n_cnt n_top3 n_ranked n_compared n_surge n_emerging ord_score", _ORD_FULL + """
UNION ALL SELECT 'priority', name, detail, value FROM (
  SELECT CAST(review_id AS VARCHAR) AS name,
         CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS detail,
         score AS value FROM ord_score ORDER BY score DESC, created_at DESC, review_id LIMIT 20)"""))
def _(spark, folder):
    """Over dated orders; there is no text, so length and word factors are the lowest."""
    reviews = fx.f_ord(spark, folder).withColumn("review_text", F.lit(""))
    return _union(
        _flat(composites.full_analysis(reviews, recent_days=90, comparison_days=180, as_of="2001-08-01 00:00:00")),
        "part", "name", "detail", "value",
    )


# The same over texts, with the category from word rules: no model at all.
fx.SQL["rule_label"] = """
SELECT review_id, CASE WHEN hits = 0 THEN 'other' ELSE category END AS category
FROM rule_hits QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY hits DESC, first_at, place) = 1"""
fx.SQL["t_doc"] = "SELECT f_doc.*, category, lang || ' ' || source AS brief_issue FROM f_doc JOIN rule_label USING (review_id)"
fx.SQL["t_neg"] = "SELECT * FROM t_doc WHERE rating <= 3"
fx.SQL["t_per"] = fx.SQL["per_doc"].replace("neg_doc", "t_neg")
for _name in ("cnt", "ranked", "compared"):
    fx.SQL[f"t_{_name}"] = fx.SQL[f"n_{_name}"].replace("per_ord", "t_per")
fx.SQL["t_top3"] = fx.SQL["top3"].replace("cnt", "t_cnt")
fx.SQL["t_surge"] = fx.SQL["surge"].replace("compared", "t_compared")
fx.SQL["t_emerging"] = fx.SQL["emerging"].replace("FROM surge", "FROM t_surge")
_TEXT_FULL = _FULL.format(all="t_doc")
for _name in ("top3", "ranked", "cnt", "emerging"):
    _TEXT_FULL = _TEXT_FULL.replace(f"FROM {_name}", f"FROM t_{_name}").replace(f"JOIN {_name}", f"JOIN t_{_name}")


@query("full_analysis_text", with_fixtures(
    f"{SCORED} low rule_hits rule_label t_doc t_neg t_per t_cnt t_top3 t_ranked t_compared t_surge t_emerging",
    _TEXT_FULL + """
UNION ALL SELECT 'priority', name, detail, value FROM (
  SELECT CAST(review_id AS VARCHAR) AS name, level AS detail, score AS value FROM scored WHERE rating <= 3
  ORDER BY score DESC, created_at DESC, review_id LIMIT 20)"""))
def _(spark, folder):
    reviews = fx.f_doc(spark, folder)
    labels = labeling.label_by_rules(filters.filter_negative(reviews), fx.DOC_RULES).select(
        "review_id", "rating", "created_at", "category", F.concat_ws(" ", "lang", "source").alias("brief_issue")
    )
    # The texts are searched once; what is kept of them is a few bytes per review.
    parts = composites.full_analysis(reviews, cut_lineage(labels), **fx.SCORING)
    return _union(_flat(parts), "part", "name", "detail", "value")
