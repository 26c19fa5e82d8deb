"""Queries over labels: metrics, errors, votes, neighbours, training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vocabulary import CHAT_SYSTEM_TEXT, CHAT_USER_PREFIX, STOPWORDS
from ..operators import consensus, errors, evaluation as ev, filters, knn, knn_index, labelers, labeling, training
from ..session import cut_lineage
from . import composites, fixtures as fx
from .catalog_reviews import _LABEL_SQL
from .fixtures import ERR, EVAL, EVAL5, NEAR, VOTES, strip_sql, table, with_fixtures
from .registry import query

# --- metrics -------------------------------------------------------------------

fx.SQL["pairs"] = "SELECT true_label, predicted_label, count(*) AS n FROM f_eval GROUP BY true_label, predicted_label"
fx.SQL["label_set"] = "SELECT true_label AS label FROM f_eval UNION SELECT predicted_label FROM f_eval"


def _class_sql(source: str) -> str:
    return f"""
SELECT label, CASE WHEN pred = 0 THEN 0 ELSE hits / pred END AS p,
       CASE WHEN support = 0 THEN 0 ELSE hits / support END AS r, support, hits
FROM (SELECT label, (SELECT count(*) FROM {source} WHERE true_label = label) AS support,
             (SELECT count(*) FROM {source} WHERE predicted_label = label) AS pred,
             (SELECT count(*) FROM {source} WHERE true_label = label AND predicted_label = label) AS hits
      FROM (SELECT true_label AS label FROM {source} UNION SELECT predicted_label FROM {source}))"""


_F1 = "CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END"
fx.SQL["classes"] = _class_sql("f_eval")
fx.SQL["classes5"] = _class_sql("f_eval5")


@query("label_union", with_fixtures(f"{EVAL} label_set", "SELECT label FROM label_set ORDER BY label"))
def _(spark, folder):
    return ev.label_union(fx.f_eval(spark, folder))


@query("eval_accuracy", with_fixtures(EVAL, """
SELECT round_even(avg(CASE WHEN true_label = predicted_label THEN 1.0::DOUBLE ELSE 0 END), 4) AS accuracy FROM f_eval"""))
def _(spark, folder):
    return ev.eval_accuracy(ev.label_pairs(fx.f_eval(spark, folder)))


@query("eval_per_class", with_fixtures(f"{EVAL} classes", f"""
SELECT label, round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even({_F1}, 4) AS f1, support
FROM classes WHERE support > 0"""))
def _(spark, folder):
    return ev.eval_per_class(ev.label_pairs(fx.f_eval(spark, folder)))


@query("eval_weighted", with_fixtures(f"{EVAL} classes", f"""
SELECT round_even(CAST(sum(hits) AS DOUBLE) / sum(support), 4) AS accuracy,
       round_even(sum(p * support) / sum(support), 4) AS precision_weighted,
       round_even(sum(r * support) / sum(support), 4) AS recall_weighted,
       round_even(sum({_F1} * support) / sum(support), 4) AS f1_weighted FROM classes"""))
def _(spark, folder):
    return ev.eval_weighted(ev.label_pairs(fx.f_eval(spark, folder)))


@query("confusion_matrix", with_fixtures(f"{EVAL} pairs label_set", """
SELECT t.label AS true_label, q.label AS predicted_label, coalesce(n, 0) AS n
FROM label_set t CROSS JOIN label_set q
LEFT JOIN pairs ON pairs.true_label = t.label AND pairs.predicted_label = q.label"""))
def _(spark, folder):
    return ev.confusion_matrix(ev.label_pairs(fx.f_eval(spark, folder)))


@query("mismatch_rows", with_fixtures(ERR, "SELECT review_id, review_text, true_label, predicted_label, rating FROM f_err"))
def _(spark, folder):
    return ev.mismatch_rows(fx.f_err_all(spark, folder))


@query("mismatch_previews", with_fixtures(ERR, """
SELECT review_id, CASE WHEN length(review_text) > 50 THEN substr(review_text, 1, 50) || '...' ELSE review_text END
         AS review_preview, true_label, predicted_label FROM f_err"""))
def _(spark, folder):
    return ev.mismatch_rows(fx.f_err_all(spark, folder), preview_size=50)


_NAMES = ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted"]


def _weighted_rows(source: str) -> str:
    values = [
        "CAST(sum(hits) AS DOUBLE) / sum(support)", "sum(p * support) / sum(support)",
        "sum(r * support) / sum(support)", f"sum({_F1} * support) / sum(support)",
    ]
    return " UNION ALL ".join(
        f"SELECT '{name}' AS metric, {value} AS value FROM {source}" for name, value in zip(_NAMES, values)
    )


fx.SQL["base_rows"] = _weighted_rows("classes")
fx.SQL["new_rows"] = _weighted_rows("classes5")
_DELTA_SQL = with_fixtures(f"{EVAL5} classes classes5 base_rows new_rows", """
SELECT metric, round_even(b.value * 100, 4) AS base_pct, round_even(n.value * 100, 4) AS new_pct,
       round_even((n.value - b.value) * 100, 4) AS improvement
FROM new_rows n JOIN base_rows b USING (metric)""")


@query("model_comparison", _DELTA_SQL)
def _(spark, folder):
    return composites.model_comparison(*fx.f_evals(spark, folder))


fx.SQL["rounded_new"] = "SELECT metric, round_even(value, 4) AS value FROM new_rows"
fx.SQL["rounded_base"] = "SELECT metric, round_even(value, 4) AS value FROM base_rows WHERE metric <> 'f1_weighted'"


@query("metric_delta", with_fixtures(f"{EVAL5} classes classes5 base_rows new_rows rounded_new rounded_base", """
SELECT metric, round_even(coalesce(b.value, 0) * 100, 4) AS base_pct, round_even(n.value * 100, 4) AS new_pct,
       round_even((n.value - coalesce(b.value, 0)) * 100, 4) AS improvement
FROM rounded_new n LEFT JOIN rounded_base b USING (metric)"""))
def _(spark, folder):
    base, new = (
        ev.unpivot_metrics(ev.eval_weighted(ev.label_pairs(frame)), _NAMES)
        for frame in fx.f_evals(spark, folder)
    )
    return ev.metric_delta(base.filter(F.col("metric") != "f1_weighted"), new)


# Three labelers as three strategies, judged on the same vectors.
fx.SQL["trials"] = """
SELECT CASE agent_id WHEN 0 THEN 'zero_shot' WHEN 1 THEN 'few_shot_3' ELSE 'temperature_0.5' END AS strategy,
       agent_id, CAST(label AS VARCHAR) AS true_label, category AS predicted_label
FROM embeddings JOIN f_vote ON vec_id = review_id"""
fx.SQL["accs"] = """
SELECT strategy, min(agent_id) AS strategy_order,
       round_even(avg(CASE WHEN true_label = predicted_label THEN 1.0::DOUBLE ELSE 0 END), 4) AS accuracy
FROM trials GROUP BY strategy"""
_SUMMARY = """
SELECT strategy, accuracy,
       round_even((accuracy - (SELECT accuracy FROM accs WHERE strategy = 'zero_shot')) * 100, 1) AS improvement,
       strategy = (SELECT strategy FROM accs ORDER BY accuracy DESC, strategy_order LIMIT 1) AS is_best
FROM accs"""


def _strategy(agent):
    return F.when(agent == 0, "zero_shot").when(agent == 1, "few_shot_3").otherwise("temperature_0.5")


def _accuracies(spark, folder):
    truth = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("review_id"), F.col("label").cast("string").alias("true_label")
    )
    trials = truth.join(fx.f_vote(spark, folder), "review_id").select(
        _strategy(F.col("agent_id")).alias("strategy"), F.col("agent_id").alias("strategy_order"),
        "true_label", F.col("category").alias("predicted_label"),
    )
    return ev.strategy_accuracy(trials)


@query("strategy_summary", with_fixtures(f"{VOTES} trials accs", _SUMMARY))
def _(spark, folder):
    return ev.strategy_summary(_accuracies(spark, folder))


@query("stage_report", with_fixtures(f"{VOTES} trials accs", """
SELECT CASE strategy WHEN 'zero_shot' THEN 'Zero Shot' ELSE 'Few Shot 3' END AS stage,
       round_even(accuracy * 100, 2) AS accuracy_pct,
       CASE WHEN strategy <> 'zero_shot' THEN
         round_even((accuracy - (SELECT accuracy FROM accs WHERE strategy = 'zero_shot')) * 100, 1) END AS improvement
FROM accs WHERE NOT contains(strategy, 'temperature')"""))
def _(spark, folder):
    stages = _accuracies(spark, folder).withColumnRenamed("strategy", "stage")
    return ev.stage_report(stages, baseline="zero_shot")


# Long answer tables: every event is an answer about the order of its user.
fx.SQL["ev_truth"] = """
SELECT o_orderkey AS review_number,
       CASE o_orderstatus WHEN 'F' THEN 'click' WHEN 'O' THEN 'error' ELSE 'other' END AS true_label FROM orders"""
fx.SQL["ev_answers"] = """
SELECT CASE event_id % 2 WHEN 0 THEN 'zero_shot' ELSE 'cot' END AS strategy, user_id AS review_number,
       arg_max(event_type, event_id) AS category FROM events GROUP BY 1, 2"""
fx.SQL["accs_long"] = """
SELECT strategy, strategy_order,
       round_even(avg(CASE WHEN true_label = coalesce(category, 'other') THEN 1.0::DOUBLE ELSE 0 END), 4) AS accuracy
FROM ev_truth CROSS JOIN (VALUES ('zero_shot', 0), ('cot', 1)) s(strategy, strategy_order)
LEFT JOIN ev_answers USING (strategy, review_number) GROUP BY strategy, strategy_order"""


@query("prompt_experiment_table", with_fixtures("ev_truth ev_answers accs_long", _SUMMARY.replace("accs", "accs_long")))
def _(spark, folder):
    status = F.col("o_orderstatus")
    labeled = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("review_number"),
        F.when(status == "F", "click").when(status == "O", "error").otherwise("other").alias("true_label"),
    )
    odd = F.col("event_id") % 2
    answers = table(spark, folder, "events").select(
        F.when(odd == 0, "zero_shot").otherwise("cot").alias("strategy"), odd.cast("int").alias("strategy_order"),
        F.col("user_id").alias("review_number"), F.col("event_id").alias("item_pos"),
        F.col("event_type").alias("category"),
    )
    return composites.prompt_experiment_table(labeled, answers)


@query("evaluation_report", with_fixtures(f"{EVAL} pairs label_set classes base_rows", f"""
SELECT 'overall' AS part, metric AS name, '' AS other, round_even(value, 4) AS value FROM base_rows
UNION ALL SELECT 'precision', label, '', round_even(p, 4) FROM classes WHERE support > 0
UNION ALL SELECT 'recall', label, '', round_even(r, 4) FROM classes WHERE support > 0
UNION ALL SELECT 'f1', label, '', round_even({_F1}, 4) FROM classes WHERE support > 0
UNION ALL SELECT 'support', label, '', CAST(support AS DOUBLE) FROM classes WHERE support > 0
UNION ALL SELECT 'confusion', t.label, q.label, CAST(coalesce(n, 0) AS DOUBLE)
  FROM label_set t CROSS JOIN label_set q
  LEFT JOIN pairs ON pairs.true_label = t.label AND pairs.predicted_label = q.label
UNION ALL SELECT 'errors', CAST(review_id AS VARCHAR), true_label || '>' || predicted_label, 1.0
  FROM f_eval WHERE true_label <> predicted_label"""))
def _(spark, folder):
    vectors = cut_lineage(fx.f_eval(spark, folder)).withColumns({"review_text": F.lit(""), "rating": F.lit(0.0)})
    parts = composites.evaluation_report(vectors)
    blank = F.lit("")
    rows = [
        ev.unpivot_metrics(parts["overall"], _NAMES).select(F.lit("overall"), "metric", blank, "value"),
        parts["per_class"].withColumn("support", F.col("support").cast("double"))
        .unpivot("label", [*ev.METRICS, "support"], "part", "value").select("part", "label", blank, "value"),
        parts["confusion"].select(F.lit("confusion"), "true_label", "predicted_label", F.col("n").cast("double")),
        parts["errors"].select(
            F.lit("errors"), F.col("review_id").cast("string"),
            F.concat("true_label", F.lit(">"), "predicted_label"), F.lit(1.0),
        ),
    ]
    return _union(rows, "part", "name", "other", "value")


def _union(frames, *names):
    out = frames[0].toDF(*names)
    for frame in frames[1:]:
        out = out.union(frame.toDF(*names))
    return out


# --- errors -------------------------------------------------------------------------

fx.SQL["err_pairs"] = """
SELECT true_label, predicted_label, count(*) AS n, min(review_id) AS first_id FROM f_err
GROUP BY true_label, predicted_label"""
fx.SQL["err_ranked"] = "SELECT *, row_number() OVER (ORDER BY n DESC, first_id) AS pair_rank FROM err_pairs"
fx.SQL["err_length"] = """
SELECT CASE WHEN length(review_text) < 50 THEN 'very_short' WHEN length(review_text) < 150 THEN 'short'
            WHEN length(review_text) < 300 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n
FROM f_err GROUP BY 1"""
fx.SQL["err_rating"] = """
SELECT CAST(CAST(rating AS BIGINT) AS VARCHAR) AS rating_key, count(*) AS n FROM f_err
WHERE rating IS NOT NULL GROUP BY rating"""
fx.SQL["err_label"] = "SELECT true_label, count(*) AS n, min(review_id) AS first_id FROM f_err GROUP BY true_label"
_LETTERS = fx.BLANK_SQL.replace("[", r"[^\p{L}", 1)
_STOP_SQL = ", ".join(f"'{word}'" for word in STOPWORDS)
fx.SQL["err_words"] = f"""
SELECT pair_rank, true_label, predicted_label, review_id, unnest(range(len(parts))) AS place, unnest(parts) AS keyword
FROM (SELECT *, string_split_regex(regexp_replace(lower(review_text), '{_LETTERS}', '', 'g'), '{fx.BLANK_SQL}+') AS parts
      FROM f_err JOIN err_ranked USING (true_label, predicted_label) WHERE pair_rank <= 3)"""
fx.SQL["err_counts"] = f"""
SELECT pair_rank, true_label, predicted_label, keyword, count(*) AS n,
       min(struct_pack(r := review_id, p := place)) AS seen
FROM err_words WHERE length(keyword) >= 2 AND keyword NOT IN ({_STOP_SQL})
GROUP BY pair_rank, true_label, predicted_label, keyword"""
fx.SQL["err_keys"] = """
SELECT CAST(pair_rank AS INTEGER) AS pair_rank, true_label, predicted_label,
       CAST(row_number() OVER (PARTITION BY pair_rank ORDER BY n DESC, seen) AS INTEGER) AS keyword_rank, keyword, n
FROM err_counts QUALIFY keyword_rank <= 10"""
_KEYS = f"{ERR} err_pairs err_ranked err_words err_counts err_keys"


@query("confusion_pairs", with_fixtures(f"{ERR} err_pairs", "SELECT * FROM err_pairs"))
def _(spark, folder):
    return errors.confusion_pairs(fx.f_err(spark, folder))


@query("confusion_pairs_top", with_fixtures(f"{ERR} err_pairs", "SELECT * FROM err_pairs ORDER BY n DESC, first_id LIMIT 5"))
def _(spark, folder):
    return errors.top_pairs(fx.f_err(spark, folder))


@query("errors_by_length", with_fixtures(f"{ERR} err_length", "SELECT * FROM err_length"))
def _(spark, folder):
    return errors.errors_by_length(fx.f_err(spark, folder))


@query("errors_by_rating", with_fixtures(f"{ERR} err_rating", "SELECT * FROM err_rating"))
def _(spark, folder):
    return errors.errors_by_rating(fx.f_err(spark, folder))


@query("errors_by_true_label", with_fixtures(f"{ERR} err_label", "SELECT * FROM err_label ORDER BY n DESC, first_id LIMIT 5"))
def _(spark, folder):
    return errors.errors_by_true_label(fx.f_err(spark, folder))


@query("confusion_keywords", with_fixtures(_KEYS, "SELECT * FROM err_keys"))
def _(spark, folder):
    return errors.confusion_keywords(fx.f_err(spark, folder))


@query("confusion_examples", with_fixtures(f"{ERR} err_pairs err_ranked", """
SELECT CAST(pair_rank AS INTEGER) AS pair_rank, review_id, review_text
FROM f_err JOIN err_ranked USING (true_label, predicted_label) WHERE pair_rank <= 3"""))
def _(spark, folder):
    return errors.errors_of_top_pairs(fx.f_err(spark, folder)).select("pair_rank", "review_id", "review_text")


_SUGGEST = """
SELECT 'confused_pair' AS kind, true_label || ' -> ' || predicted_label AS subject, n FROM err_ranked WHERE pair_rank = 1
UNION ALL SELECT 'short_text', bucket, n FROM err_length
  WHERE bucket = 'very_short' AND n > 0.2 * (SELECT count(*) FROM f_err)
UNION ALL SELECT 'frequent_label', true_label, n FROM (SELECT * FROM err_label ORDER BY n DESC, first_id LIMIT 1)
  WHERE n > 0.15 * (SELECT count(*) FROM f_err)"""


@query("error_suggestions", with_fixtures(f"{ERR} err_pairs err_ranked err_length err_label", _SUGGEST))
def _(spark, folder):
    return errors.error_suggestions(fx.f_err(spark, folder))


@query("error_report", with_fixtures(f"{_KEYS} err_length err_rating err_label", f"""
SELECT 'confusion_pairs' AS part, true_label || '>' || predicted_label AS name, n FROM err_pairs
UNION ALL SELECT 'review_length', bucket, n FROM err_length
UNION ALL SELECT 'rating', rating_key, n FROM err_rating
UNION ALL SELECT 'categories', true_label, n FROM err_label
UNION ALL SELECT 'keywords', pair_rank || ' ' || keyword_rank || ' ' || keyword, n FROM err_keys
UNION ALL SELECT kind, subject, n FROM ({_SUGGEST})"""))
def _(spark, folder):
    parts = composites.error_report(fx.f_err(spark, folder))
    names = {
        "confusion_pairs": F.concat("true_label", F.lit(">"), "predicted_label"),
        "review_length": F.col("bucket"), "rating": F.col("rating_key"), "categories": F.col("true_label"),
        "keywords": F.concat_ws(" ", F.col("pair_rank").cast("string"), F.col("keyword_rank").cast("string"), "keyword"),
    }
    rows = [parts[part].select(F.lit(part), name, "n") for part, name in names.items()]
    return _union([*rows, parts["suggestions"]], "part", "name", "n")


# --- votes -----------------------------------------------------------------------------

fx.SQL["vote_sums"] = """
SELECT review_id, category, count(*) AS votes, sum(coalesce(confidence, 1.0)) AS weight, min(agent_id) AS first_agent,
       sum(count(*)) OVER (PARTITION BY review_id) AS total_votes,
       sum(sum(coalesce(confidence, 1.0))) OVER (PARTITION BY review_id) AS total_weight
FROM ev_vote GROUP BY review_id, category"""


@query("vote_majority", with_fixtures("ev_vote vote_sums", """
SELECT review_id, category AS final_category, votes AS vote_count, CAST(total_votes AS BIGINT) AS total_votes,
       round_even(votes / total_votes, 6) AS agreement_rate FROM vote_sums
QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY votes DESC, first_agent) = 1"""))
def _(spark, folder):
    voted = consensus.vote_majority(fx.ev_vote(spark, folder))
    return voted.withColumn("agreement_rate", F.bround("agreement_rate", 6))


@query("vote_weighted", with_fixtures("ev_vote vote_sums", """
SELECT review_id, category AS final_category, round_even(weight, 9) AS weighted_score,
       round_even(total_weight, 9) AS total_weight FROM vote_sums
QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY weight DESC, first_agent) = 1"""))
def _(spark, folder):
    voted = consensus.vote_weighted(fx.ev_vote(spark, folder))
    return voted.withColumns({name: F.bround(name, 9) for name in ("weighted_score", "total_weight")})


@query("consensus_batch", with_fixtures(VOTES, """
SELECT vec_id AS review_id, label, category AS final_category, votes AS vote_count, CAST(3 AS BIGINT) AS total_votes,
       round_even(votes / 3, 6) AS agreement_rate
FROM embeddings JOIN (
  SELECT review_id, category, count(*) AS votes, min(agent_id) AS first_agent FROM f_vote GROUP BY review_id, category
  QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY votes DESC, first_agent) = 1
) ON vec_id = review_id"""))
def _(spark, folder):
    reviews = table(spark, folder, "embeddings").select(F.col("vec_id").alias("review_id"), "label")
    final = consensus.consensus_batch(reviews, fx.f_vote(spark, folder))
    return final.withColumn("agreement_rate", F.bround("agreement_rate", 6))


# --- neighbours -----------------------------------------------------------------------------

_NEAR_SQL = with_fixtures(NEAR, """
SELECT review_id, neighbor_id, category, round_even(distance, 6) AS distance,
       CAST(neighbor_rank AS INTEGER) AS neighbor_rank FROM f_near""")


@query("knn_retrieve", _NEAR_SQL)
def _(spark, folder):
    return fx.f_near(spark, folder).withColumn("distance", F.bround("distance", 6))


@query("knn_retrieve_cells", _NEAR_SQL)
def _(spark, folder):
    """The way for example sets too large to broadcast; same rows."""
    near = fx.f_near(spark, folder, broadcast_bytes=0)
    return near.withColumn("distance", F.bround("distance", 6))


@query("knn_retrieve_with_bad_vectors", """
WITH usable AS (SELECT * FROM embeddings WHERE vec_id % 5 > 1), near AS (
  SELECT q.vec_id AS review_id, c.vec_id AS neighbor_id, CAST(c.label AS VARCHAR) AS category,
         list_sum(list_transform(list_zip(q.embedding, c.embedding),
                  lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS distance
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY review_id ORDER BY distance, neighbor_id) AS INTEGER) AS neighbor_rank FROM near)
SELECT review_id, neighbor_id, category, round_even(distance, 6) AS distance, neighbor_rank FROM ranked WHERE neighbor_rank <= 3""")
def _(spark, folder):
    """Two in five vectors hold an undefined or an infinite number; all others find their neighbours."""
    bad = F.col("vec_id") % 5
    first = F.when(bad == 0, F.lit(float("nan"))).when(bad == 1, F.lit(float("inf"))).otherwise(F.get("embedding", F.lit(0)))
    rows = fx.table(spark, folder, "embeddings").select(
        "vec_id", F.concat(F.array(first.cast("float")), F.slice("embedding", 2, F.size("embedding"))).alias("embedding"),
        F.col("label").cast("string").alias("category"),
    )
    near = knn.knn_retrieve(
        rows.select(F.col("vec_id").alias("review_id"), "embedding"), rows.withColumnRenamed("vec_id", "neighbor_id"), 3, skip_self=True)
    return near.withColumn("distance", F.bround("distance", 6))


def _indexed(spark, folder):
    """The vectors whose id is divisible by 100 as queries, all as examples, and the index of these."""
    vectors = fx.table(spark, folder, "embeddings")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("review_id"), "embedding")
    examples = vectors.select(F.col("vec_id").alias("neighbor_id"), "embedding", F.col("label").cast("string").alias("category"))
    return queries, examples, knn_index.build(examples, knn_index.fit(examples), 3)


@query("knn_index_all_lists", with_fixtures(NEAR, """
SELECT review_id, neighbor_id, category, round_even(distance, 6) AS distance, CAST(neighbor_rank AS INTEGER) AS neighbor_rank
FROM f_near WHERE review_id % 100 = 0 AND neighbor_rank <= 3"""))
def _(spark, folder):
    """Codes rank, vectors decide: with all lists visited the rows are those of the exact search."""
    queries, _, index = _indexed(spark, folder)
    found = knn_index.search(index, queries, 3, len(index.centres), skip_self=True)
    return found.withColumn("distance", F.bround("distance", 6))


@query("knn_index_recall", """
SELECT count(*) FILTER (vec_id % 100 = 0) AS queries, 3 * count(*) FILTER (vec_id % 100 = 0) AS neighbors, TRUE AS recall_is_good FROM embeddings""")
def _(spark, folder):
    """With the number of lists that it chose itself, the index finds at least nine of ten neighbours of the exact search."""
    queries, examples, index = _indexed(spark, folder)
    probes = knn_index.choose_probes(index, queries, 3, skip_self=True)
    found = knn_index.search(index, queries, 3, probes, skip_self=True)
    measured = knn_index.recall(found, knn.knn_retrieve(queries, examples, 3, skip_self=True))
    return measured.select("queries", "neighbors", (F.col("recall") >= 0.9).alias("recall_is_good"))


@query("knn_vote_label", with_fixtures(VOTES, """
SELECT review_id, category, round_even(confidence, 6) AS confidence FROM f_vote WHERE agent_id = 1"""))
def _(spark, folder):
    labeled = knn.knn_vote_label(fx.f_near(spark, folder), 3)
    return labeled.withColumn("confidence", F.bround("confidence", 6))


# --- rules ------------------------------------------------------------------------------------


def _rules_sql() -> str:
    parts = []
    for place, (category, words) in enumerate(fx.DOC_RULES.items()):
        pattern = labeling.word_pattern(words).replace("\\ ", " ")
        parts.append(
            f"SELECT review_id, {place} AS place, '{category}' AS category, "
            f"len(regexp_extract_all(t, '{pattern}')) AS hits, strpos(t, regexp_extract(t, '{pattern}')) AS first_at FROM low"
        )
    return " UNION ALL ".join(parts)


fx.SQL["low"] = "SELECT review_id, lower(review_text) AS t FROM f_doc"
fx.SQL["rule_hits"] = _rules_sql()


_RULES_SQL = with_fixtures("f_doc low rule_hits", """
SELECT review_id, CASE WHEN hits = 0 THEN 'other' ELSE category END AS category, CAST(hits AS INTEGER) AS rule_hits
FROM rule_hits QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY hits DESC, first_at, place) = 1""")


@query("label_by_rules", _RULES_SQL)
def _(spark, folder):
    labeled = labeling.label_by_rules(fx.f_doc(spark, folder), fx.DOC_RULES)
    return labeled.select("review_id", "category", "rule_hits")


@query("label_by_many_words", _RULES_SQL)
def _(spark, folder):
    """By one automaton for all words: the same rows."""
    labeled = labelers.label_by_many_words(fx.f_doc(spark, folder), fx.DOC_RULES)
    return labeled.select("review_id", "category", "rule_hits")


@query("label_with_rules", _RULES_SQL)
def _(spark, folder):
    """The rules plugged in as a labeler: the same rows, and no failures."""
    docs = fx.f_doc(spark, folder).withColumn("lowered", F.lower("review_text"))
    labeled = labelers.label_with(
        docs, labelers.rules_labeler(fx.DOC_RULES, text="lowered"), "category string, rule_hits int", ["lowered"], allowed=[*fx.DOC_RULES, "other"])
    return labeled.where("label_error is null").select("review_id", "category", "rule_hits")


def _picky():
    """A labeler that has no label for some rows, and fails for others."""
    def label(batch):
        ids = batch.column("review_id").to_pylist()
        if any(i % 7 == 0 for i in ids):
            raise ValueError("not today")
        return ["odd" if i % 11 == 0 else None if i % 5 == 0 else f"kind_{i % 3}" for i in ids]

    return label


@query("label_failures", """
SELECT doc_id AS review_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 5 <> 0 THEN 'kind_' || doc_id % 3 END AS category,
       CASE WHEN doc_id % 7 = 0 THEN 'ValueError: not today' WHEN doc_id % 11 = 0 THEN 'ValueError: odd is not allowed' END AS label_error
FROM documents""")
def _(spark, folder):
    """Rows that a labeler raises for, or labels in a way that is not allowed, come back with the reason."""
    labeled = labelers.label_with(fx.f_doc(spark, folder), _picky, inputs=["review_id"], allowed=["kind_0", "kind_1", "kind_2"])
    return labeled.select("review_id", "category", "label_error")


@query("keyword_points", with_fixtures("f_doc factors", "SELECT review_id, keyword_score FROM factors"))
def _(spark, folder):
    """Points for severe and medium words by one automaton."""
    scored = labelers.keyword_points(fx.f_doc(spark, folder), fx.DOC_SEVERE, fx.DOC_MEDIUM)
    return scored.select("review_id", "keyword_score")


# --- training sets ------------------------------------------------------------------------------

fx.SQL["clean"] = f"""
SELECT review_id, rating, {_LABEL_SQL} AS manual_label, {strip_sql('review_text')} AS review_text FROM f_raw
WHERE {_LABEL_SQL} IN ('good', 'bad') AND {strip_sql('review_text')} <> ''"""
fx.SQL["unique_rows"] = """
SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY review_text ORDER BY review_id) = 1"""
fx.SQL["parts"] = """
SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(review_text || '-42'))
                    <= floor((SELECT count(*) FROM unique_rows) * CAST(0.8 AS DOUBLE))
               THEN 'train' ELSE 'valid' END AS part
FROM unique_rows"""
_SPLIT = "f_raw clean unique_rows parts"


def _clean(spark, folder):
    return filters.clean_labels(fx.f_raw(spark, folder), fx.DOC_KEYS)


def _split(spark, folder):
    return training.train_valid_split(training.dedup_text(_clean(spark, folder)))


@query("dedup_text", """
SELECT doc_id AS review_id, text AS review_text FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def _(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("review_id"), F.col("text").alias("review_text"))
    return training.dedup_text(docs)


@query("sample_for_labeling", with_fixtures("f_doc", """
SELECT review_id, review_text, rating, '' AS manual_label, '' AS notes FROM f_doc WHERE rating <= 3
ORDER BY md5(review_id || '-42'), review_id LIMIT 100"""))
def _(spark, folder):
    return training.sample_for_labeling(filters.filter_negative(fx.f_doc(spark, folder)))


@query("train_valid_split", with_fixtures(_SPLIT, "SELECT review_id, manual_label, part FROM parts"))
def _(spark, folder):
    return _split(spark, folder).select("review_id", "manual_label", "part")


fx.SQL["doc_unique"] = """
SELECT doc_id AS review_id, text AS review_text FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"""


@query("train_valid_split_all", with_fixtures("doc_unique", """
SELECT review_id, CASE WHEN row_number() OVER (ORDER BY md5(review_text || '-42'))
                            <= floor((SELECT count(*) FROM doc_unique) * CAST(0.8 AS DOUBLE))
                       THEN 'train' ELSE 'valid' END AS part FROM doc_unique"""))
def _(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("review_id"), F.col("text").alias("review_text"))
    return training.train_valid_split(training.dedup_text(docs)).select("review_id", "part")


def json_text(expression: str) -> str:
    """SQL for a JSON string of a text column."""
    return f"CAST(to_json({expression}) AS VARCHAR)"


_CHAT_SYSTEM = CHAT_SYSTEM_TEXT.replace("'", "''")
_CHAT_SQL = f"""
SELECT review_id, part,
       '{{"messages":[{{"role":"system","content":' || {json_text(f"'{_CHAT_SYSTEM}'")} ||
       '}},{{"role":"user","content":' || {json_text(f"'{CHAT_USER_PREFIX}' || review_text")} ||
       '}},{{"role":"assistant","content":' || {json_text('manual_label')} || '}}]}}' AS line
FROM parts"""


@query("chat_examples", with_fixtures(_SPLIT, _CHAT_SQL))
def _(spark, folder):
    examples = training.chat_examples(_split(spark, folder))
    return examples.select("review_id", "part", training.chat_json(examples).alias("line"))


@query("train_label_distribution", with_fixtures(_SPLIT, """
SELECT manual_label AS label, count(*) AS n,
       round_even(count(*) / (SELECT count(*) FROM parts WHERE part = 'train') * 100, 1) AS percentage,
       (SELECT count(*) FROM parts WHERE part = 'train') AS train_rows,
       (SELECT count(*) FROM parts WHERE part = 'valid') AS valid_rows
FROM parts WHERE part = 'train' GROUP BY manual_label"""))
def _(spark, folder):
    return training.train_label_distribution(_split(spark, folder))


_REPORT = f"""
SELECT count(*) AS rows_in,
       count(*) FILTER (coalesce({_LABEL_SQL} NOT IN ('good', 'bad'), TRUE)) AS bad_label,
       count(*) FILTER ({_LABEL_SQL} IN ('good', 'bad') AND {strip_sql('review_text')} = '') AS blank_text,
       (SELECT count(*) FROM unique_rows) AS rows_kept,
       (SELECT count(*) FROM clean) - (SELECT count(*) FROM unique_rows) AS duplicates,
       count(*) - (SELECT count(*) FROM unique_rows) AS removed_total FROM f_raw"""


@query("cleaning_report", with_fixtures("f_raw clean unique_rows", _REPORT))
def _(spark, folder):
    return training.cleaning_report(fx.f_raw(spark, folder), fx.DOC_KEYS)


@query("training_set", with_fixtures(_SPLIT, """
SELECT 'example' AS kind, part || ' ' || review_id AS name, manual_label AS label, 1.0 AS value FROM parts
UNION ALL SELECT 'share', '', manual_label,
  round_even(count(*) / (SELECT count(*) FROM parts WHERE part = 'train') * 100, 1) FROM parts
  WHERE part = 'train' GROUP BY manual_label
UNION ALL SELECT 'rows_kept', '', '', count(*) FROM unique_rows
""").replace("1.0 AS value", "CAST(1 AS DOUBLE) AS value"))
def _(spark, folder):
    made = composites.training_set(fx.f_raw(spark, folder), fx.DOC_KEYS)
    blank = F.lit("")
    rows = [
        made["examples"].select(
            F.lit("example"), F.concat_ws(" ", "part", F.col("review_id").cast("string")),
            F.col("messages")[2]["content"], F.lit(1.0),
        ),
        made["distribution"].select(F.lit("share"), blank, "label", "percentage"),
        made["report"].select(F.lit("rows_kept"), blank, blank, F.col("rows_kept").cast("double")),
    ]
    return _union(rows, "kind", "name", "label", "value")
