"""Queries over reviews: sources, filters, joins, counts, periods, priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import preview, tokens
from ..functions.urls import platform_of, product_id_of
from ..functions.vocabulary import STOPWORDS
from ..operators import filters, issues, joins, period_counts, periods, positions, priority, stats, stored_pages
from ..session import new_path
from ..sources import pages, tables
from . import fixtures as fx
from .fixtures import ORD, SCORED, strip_sql, table, with_fixtures
from .registry import query

# --- sources -----------------------------------------------------------------


@query("read_reviews_csv", with_fixtures("f_doc", """
SELECT CAST(rating AS DOUBLE) AS rating, review_text, place AS review_id,
       TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST((place - 1) % 60 AS INTEGER)) AS created_at
FROM (SELECT rating, review_text, row_number() OVER (ORDER BY review_id) AS place FROM f_doc)
WHERE review_text NOT IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND',
  '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"""))
def _(spark, folder):
    # Written in order of id, so that places in the files are ranks of ids.
    path = tables.write_reviews_csv(fx.f_doc(spark, folder).orderBy("review_id"), new_path(spark, "reviews_csv"))
    return tables.read_reviews_csv(spark, path, fx.DOC_AS_OF)


@query("normalize_review_schema", """
SELECT doc_id AS review_id, CAST(doc_id % 5 + 1 AS BIGINT) AS rating, text AS review_text FROM documents""")
def _(spark, folder):
    upload = table(spark, folder, "documents").select(
        F.col("doc_id").alias("review_id"), (F.col("doc_id") % 5 + 1).alias("Ratings"),
        F.col("text").alias("Reviews"), "source", "lang",
    )
    return tables.normalize_review_schema(upload)


@query("read_reviews_with_orders", """
SELECT l_partkey AS review_id, l_returnflag || l_linestatus AS review_text,
       CAST(l_linenumber AS DOUBLE) AS rating, o_orderdate AS created_at
FROM lineitem LEFT JOIN orders ON CASE WHEN l_linenumber % 3 = 0 THEN -l_orderkey ELSE l_orderkey END = o_orderkey
WHERE l_returnflag <> 'R'""")
def _(spark, folder):
    reviews = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("review_id"),
        F.when(F.col("l_linenumber") % 3 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("order_id"),
        F.when(F.col("l_returnflag") != "R", F.concat("l_returnflag", "l_linestatus"))
        .alias("review_comment_message"),
        F.col("l_linenumber").alias("review_score"),
    )
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("order_purchase_timestamp"),
        "o_totalprice",
    )
    return tables.reviews_with_orders(reviews, orders)


@query("read_reviews_with_orders_csv", """
SELECT doc_id AS review_id, CAST(doc_id % 5 + 1 AS DOUBLE) AS rating, text AS review_text, o_orderdate AS created_at
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents)
LEFT JOIN (SELECT o_orderdate, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders WHERE o_orderstatus <> 'P') USING (place)
WHERE lang <> 'de' AND text <> ''""")
def _(spark, folder):
    """Two CSV files, written from all documents and orders that are numbered alike: quotes and line breaks included."""
    docs = positions.with_position(table(spark, folder, "documents"), "doc_id", "order_id").select(
        F.col("doc_id").alias("review_id"), "order_id", (F.col("doc_id") % 5 + 1).alias("review_score"),
        F.when(F.col("lang") != "de", F.col("text")).alias("review_comment_message"))
    dated = table(spark, folder, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderdate")
    orders = positions.with_position(dated, "o_orderkey", "order_id").select("order_id", F.col("o_orderdate").alias("order_purchase_timestamp"))
    paths = [tables.write_csv(part, new_path(spark, "orders_csv")) for part in (docs, orders)]
    found = tables.read_reviews_with_orders(spark, *paths)
    return found.select(F.col("review_id").cast("bigint").alias("review_id"), "rating", "review_text", "created_at")


@query("synthesize_id_time", f"""
SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS review_id,
       TIMESTAMP '{fx.DOC_AS_OF}' - to_days(CAST((row_number() OVER (ORDER BY doc_id) - 1) % 60 AS INTEGER))
         AS created_at
FROM (SELECT doc_id * 7 - 3 AS doc_id FROM documents)""")
def _(spark, folder):
    """All documents, under keys with gaps."""
    docs = table(spark, folder, "documents").select((F.col("doc_id") * 7 - 3).alias("doc_id"))
    return positions.synthesize_id_time(docs, fx.DOC_AS_OF, "doc_id")


def _api_pages(spark, folder):
    item = F.struct(
        F.col("review_id").alias("_order"),
        F.when(F.col("lang") != "fr", F.col("rating").cast("double")).alias("rating"),
        F.when(F.col("lang") == "de", "").when(F.col("lang") == "en", F.col("source")).alias("title"),
        F.when(F.col("rating") != 5, F.col("review_text")).alias("content"),
    )
    grouped = (
        fx.f_doc(spark, folder).groupBy(F.expr("review_id div 10").alias("page_id"))
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
    )
    contents = F.transform("items", lambda i: i.dropFields("_order")).alias("contents")
    body = F.to_json(F.struct(F.struct(F.struct(contents).alias("paging")).alias("rData")))
    return grouped.select("page_id", body.alias("body"))


fx.SQL["api_items"] = """
SELECT review_id // 10 AS page_id, CAST(review_id % 10 AS INTEGER) AS item_pos, CAST(rating AS DOUBLE) AS rating,
       CASE WHEN lang = 'en' THEN source || chr(10) ELSE '' END
         || CASE WHEN rating <> 5 THEN review_text ELSE '' END AS joined
FROM f_doc WHERE lang <> 'fr'"""
fx.SQL["api_reviews"] = f"SELECT page_id, item_pos, rating, nullif({strip_sql('joined')}, '') AS review_text FROM api_items"


@query("ingest_review_pages", with_fixtures("f_doc api_items api_reviews", "SELECT * FROM api_reviews"))
def _(spark, folder):
    return pages.ingest_review_pages(_api_pages(spark, folder))


@query("crawl_summary", with_fixtures("f_doc api_items api_reviews", """
SELECT count(*) AS total_count, coalesce(round_even(avg(rating), 2), 0.0) AS rating_average,
       count(review_text) AS text_reviews FROM api_reviews"""))
def _(spark, folder):
    return stats.crawl_summary(pages.ingest_review_pages(_api_pages(spark, folder)))


@query("crawl_rating_distribution", """
SELECT rating, n AS "count" FROM (SELECT doc_id % 5 + 1 AS rating, count(*) AS n FROM documents GROUP BY 1)""")
def _(spark, folder):
    """The distribution that captured pages state; here it is that of all documents."""
    shares = table(spark, folder, "documents").groupBy((F.col("doc_id") % 5 + 1).alias("rating")).agg(F.count("*").alias("count"))
    stated = F.struct(F.struct(F.sort_array(F.collect_list(F.struct("rating", "count"))).alias("ratingSummaries")).alias("ratingSummaryTotal"))
    captured = shares.agg(F.to_json(F.struct(stated.alias("rData"))).alias("body")).withColumn("page_id", F.lit(1))
    found = pages.page_rating_summary(captured)
    return found.select(F.col("rating").cast("bigint").alias("rating"), F.col("count").cast("bigint").alias("count"))


fx.SQL["doc_lines"] = f"""
SELECT doc_id AS page_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS raw
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)"""
fx.SQL["rated_lines"] = f"""
SELECT page_id, line_no, {strip_sql('raw')} AS line,
       TRY_CAST(nullif(regexp_extract({strip_sql('raw')}, '([0-9])', 1), '') AS INTEGER) AS mark
FROM doc_lines"""
fx.SQL["carried"] = """
SELECT page_id, line_no, mark, line,
       last_value(mark IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line_no
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rating
FROM rated_lines"""


@query("extract_reviews_from_text", with_fixtures("doc_lines rated_lines carried", """
SELECT page_id, CAST(line_no AS INTEGER) AS line_no, rating, line AS review_text FROM carried
WHERE mark IS NULL AND rating IS NOT NULL AND length(line) >= 15 AND regexp_matches(line, '[a-z]')
  AND NOT contains(line, 'license')"""))
def _(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("page_id"), F.col("text").alias("page_text")
    )
    return pages.extract_reviews_from_text(
        docs, patterns=[r"([0-9])"], script="[a-z]", skip_words=["license"]
    )


# --- filters -------------------------------------------------------------------


@query("drop_null_text", "SELECT doc_id AS review_id, text AS review_text FROM documents WHERE lang <> 'de'")
def _(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("review_id"), F.when(F.col("lang") != "de", F.col("text")).alias("review_text")
    )
    return filters.drop_null_text(docs)


@query("filter_negative", with_fixtures("f_ord neg_ord", "SELECT * FROM neg_ord"))
def _(spark, folder):
    return filters.filter_negative(fx.f_ord(spark, folder))


@query("filter_negative_truncated", """
SELECT l_orderkey AS review_id, CAST(l_linenumber AS VARCHAR) || '.7' AS rating FROM lineitem
WHERE l_returnflag <> 'R' AND l_linenumber <= 3""")
def _(spark, folder):
    typed = F.concat(F.col("l_linenumber").cast("string"), F.lit(".7"))
    reviews = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("review_id"),
        F.when(F.col("l_returnflag") == "R", " ").otherwise(typed).alias("rating"),
    )
    return filters.filter_negative_truncated(reviews)


@query("filter_level", with_fixtures(SCORED, "SELECT review_id, score, level FROM scored WHERE level = 'high'"))
def _(spark, folder):
    scored = priority.with_priority(fx.f_doc(spark, folder), **fx.SCORING)
    return filters.filter_level(scored, "high").select("review_id", "score", "level")


_LABEL_SQL = f"lower({strip_sql('manual_label')})"


@query("clean_labels", with_fixtures("f_raw", f"""
SELECT review_id, rating, {_LABEL_SQL} AS manual_label, {strip_sql('review_text')} AS review_text FROM f_raw
WHERE {_LABEL_SQL} IN ('good', 'bad') AND {strip_sql('review_text')} <> ''"""))
def _(spark, folder):
    return filters.clean_labels(fx.f_raw(spark, folder), fx.DOC_KEYS)


@query("clean_labels_eval", with_fixtures("f_raw", f"""
SELECT review_id, review_text, rating, {_LABEL_SQL} AS manual_label FROM f_raw
WHERE {_LABEL_SQL} IN ('good', 'bad')"""))
def _(spark, folder):
    return filters.clean_labels_eval(fx.f_raw(spark, folder), fx.DOC_KEYS)


@query("labeled_only", with_fixtures("f_raw", "SELECT review_id, manual_label FROM f_raw WHERE manual_label IS NOT NULL"))
def _(spark, folder):
    return filters.labeled_only(fx.f_raw(spark, folder)).select("review_id", "manual_label")


@query("unlabeled_guard", with_fixtures("f_raw", f"""
SELECT count(*) AS total,
       count(*) FILTER (manual_label IS NULL OR {strip_sql('manual_label')} = '') AS unlabeled FROM f_raw"""))
def _(spark, folder):
    return filters.unlabeled_guard(fx.f_raw(spark, folder))


@query("fill_null_preview", with_fixtures("f_raw", """
SELECT review_id, coalesce(manual_label, '') AS manual_label, review_text, rating FROM f_raw
ORDER BY review_id LIMIT 5"""))
def _(spark, folder):
    return filters.fill_null_preview(fx.f_raw(spark, folder), "review_id")


@query("valid_category_check", with_fixtures("f_raw", f"""
SELECT review_id, CASE WHEN {_LABEL_SQL} IN ('good', 'bad') THEN {_LABEL_SQL} END AS manual_label,
       coalesce({_LABEL_SQL} NOT IN ('good', 'bad'), TRUE) AS is_failure FROM f_raw"""))
def _(spark, folder):
    checked = filters.valid_category_check(fx.f_raw(spark, folder), fx.DOC_KEYS, "manual_label")
    return checked.select("review_id", "manual_label", "is_failure")


# --- joins -----------------------------------------------------------------------


@query("join_reviews_orders", """
SELECT l_orderkey AS order_id, l_linenumber, o_orderdate AS order_purchase_timestamp
FROM (SELECT l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN -l_orderkey ELSE l_orderkey END AS l_orderkey FROM lineitem)
LEFT JOIN orders ON l_orderkey = o_orderkey""")
def _(spark, folder):
    """A third of the reviews name an order that is not there."""
    key = F.when(F.col("l_linenumber") % 3 == 0, -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    reviews = table(spark, folder, "lineitem").select(key.alias("order_id"), "l_linenumber")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("order_purchase_timestamp")
    )
    return joins.join_reviews_orders(reviews, orders)


@query("attach_predictions", """
SELECT o_orderkey AS review_number, coalesce(category, 'other') AS prediction, category IS NOT NULL AS is_matched
FROM orders LEFT JOIN (
  SELECT user_id, arg_max(event_type, event_id) AS category FROM events GROUP BY user_id
) ON o_orderkey = user_id""")
def _(spark, folder):
    reviews = table(spark, folder, "orders").select(F.col("o_orderkey").alias("review_number"))
    items = table(spark, folder, "events").select(
        F.col("user_id").alias("review_number"), F.col("event_id").alias("item_pos"),
        F.col("event_type").alias("category"),
    )
    return joins.attach_predictions(reviews, items)


@query("label_lookup", """
SELECT event_id, event_type AS category,
       CASE event_type WHEN 'click' THEN '클릭' WHEN 'error' THEN '오류' ELSE event_type END AS label
FROM events""")
def _(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.col("event_type").alias("category"))
    return issues.label_lookup(events, {"click": "클릭", "error": "오류"})


@query("latest_results", """
SELECT event_type AS kind, max(ts) AS run_at, arg_max(value, struct_pack(ts := ts, id := event_id)) AS value
FROM events GROUP BY event_type""")
def _(spark, folder):
    history = table(spark, folder, "events").select(
        F.col("event_type").alias("kind"), F.col("ts").alias("run_at"), "event_id", "value"
    )
    return joins.latest_results(history, "kind", "run_at", "event_id", ["value"])


# --- counts ------------------------------------------------------------------------


@query("rating_distribution", """
SELECT CASE WHEN r = floor(r) THEN CAST(CAST(r AS BIGINT) AS VARCHAR) ELSE CAST(r AS VARCHAR) END AS rating_key,
       count(*) AS n
FROM (SELECT CASE WHEN l_returnflag <> 'N' THEN l_quantity / 2 END AS r FROM lineitem)
WHERE r IS NOT NULL GROUP BY r""")
def _(spark, folder):
    half = F.when(F.col("l_returnflag") != "N", F.col("l_quantity") / 2).alias("rating")
    return stats.rating_distribution(table(spark, folder, "lineitem").select(half))


@query("review_stats", with_fixtures("f_ord", """
SELECT count(*) AS total_reviews, count(*) FILTER (rating <= 3) AS negative_reviews,
       round_even(count(*) FILTER (rating <= 3) / greatest(count(*), 1) * 100, 1) AS negative_ratio,
       3 AS rating_threshold FROM f_ord"""))
def _(spark, folder):
    return stats.review_stats(fx.f_ord(spark, folder))


@query("date_range", "SELECT min(ts) AS first_at, max(ts) AS last_at FROM events")
def _(spark, folder):
    return periods.date_range(table(spark, folder, "events"), "ts")


def _periods(spark, folder):
    return periods.split_by_period(filters.filter_negative(fx.f_ord(spark, folder)), 90, 180)


def _recent(spark, folder):
    return _periods(spark, folder).filter(F.col("period") == "recent")


@query("split_by_period", with_fixtures(ORD, "SELECT review_id, created_at, period FROM per_ord"))
def _(spark, folder):
    return _periods(spark, folder).select("review_id", "created_at", "period")


@query("parse_time", """
SELECT event_id, CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS created_at FROM events""")
def _(spark, folder):
    text = table(spark, folder, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text")
    )
    return periods.parse_time(text, "text").drop("text")


@query("category_counts", with_fixtures(ORD, """
SELECT category, count(*) AS n, min(review_id) AS first_position FROM per_ord WHERE period = 'recent'
GROUP BY category"""))
def _(spark, folder):
    return issues.category_counts(_recent(spark, folder), "review_id")


@query("category_number", with_fixtures(ORD, """
SELECT count(DISTINCT category) AS categories FROM per_ord WHERE period = 'recent'"""))
def _(spark, folder):
    return issues.distinct_categories(_recent(spark, folder))


fx.SQL["cnt"] = """
SELECT category, count(*) AS n, min(review_id) AS first_position FROM per_ord WHERE period = 'recent'
GROUP BY category"""
fx.SQL["top3"] = """
SELECT *, round_even(n / (SELECT sum(n) FROM cnt) * 100, 1) AS percentage FROM cnt
ORDER BY n DESC, first_position LIMIT 3"""
fx.SQL["ranked"] = """
SELECT category, brief_issue, review_id,
       row_number() OVER (PARTITION BY category ORDER BY review_id) AS example_rank
FROM per_ord WHERE period = 'recent'"""
fx.SQL["compared"] = """
SELECT category, count(*) FILTER (period = 'recent') AS recent_count,
       count(*) FILTER (period = 'comparison') AS comparison_count,
       min(review_id) FILTER (period = 'recent') AS first_position
FROM per_ord GROUP BY category HAVING count(*) FILTER (period = 'recent') > 0"""
fx.SQL["surge"] = """
SELECT *, comparison_count = 0 AS is_new,
       CASE WHEN comparison_count = 0 THEN CASE WHEN recent_count >= 5 THEN 'Infinity'::DOUBLE END
            ELSE (recent_count - comparison_count) / comparison_count END AS rate
FROM compared"""
fx.SQL["emerging"] = """
SELECT category, recent_count, comparison_count, is_new,
       CASE WHEN is_new THEN rate ELSE round_even(rate * 100, 1) END AS increase_rate
FROM surge WHERE rate > 0.2::DOUBLE
ORDER BY CASE WHEN is_new THEN rate ELSE round_even(rate * 100, 1) END DESC, first_position LIMIT 3"""


@query("first_k_examples", with_fixtures(f"{ORD} ranked", """
SELECT category, review_id, brief_issue, CAST(example_rank AS INTEGER) AS example_rank
FROM ranked WHERE example_rank <= 3"""))
def _(spark, folder):
    return issues.first_k_examples(_recent(spark, folder), 3, "review_id")


@query("top_issues", with_fixtures(f"{ORD} cnt top3 ranked", """
SELECT category, n, percentage,
       string_agg(brief_issue, ' / ' ORDER BY example_rank) AS examples
FROM top3 JOIN ranked USING (category) WHERE example_rank <= 3 GROUP BY category, n, percentage"""))
def _(spark, folder):
    top = issues.top_issues(_recent(spark, folder), order="review_id")
    return top.withColumn("examples", F.array_join("examples", " / "))


@query("period_compare", with_fixtures(f"{ORD} compared", "SELECT * FROM compared"))
def _(spark, folder):
    return issues.period_compare(_periods(spark, folder), "review_id")


@query("emerging_issues", with_fixtures(f"{ORD} compared surge emerging", "SELECT * FROM emerging"))
def _(spark, folder):
    return issues.emerging_issues(_periods(spark, folder), order="review_id")


@query("stored_period_compare", with_fixtures(f"{ORD} compared", "SELECT * FROM compared"))
def _(spark, folder):
    """Counts by day are stored, the newest day once more, and the periods added up from them."""
    items, path = filters.filter_negative(fx.f_ord(spark, folder)), new_path(spark, "days")
    period_counts.store_days(items, path, order="review_id")
    newest = items.agg(F.max("created_at")).first()[0]
    period_counts.store_days(items, path, [newest.date()], order="review_id")
    return period_counts.stored_period_compare(spark, path, recent_days=90, comparison_days=180, order="review_id")


@query("stored_period_compare_within_days", """
WITH bounds AS (SELECT max(ts) AS mx FROM events)
SELECT event_type AS category, count(*) FILTER (ts >= mx - INTERVAL 7 DAY) AS recent_count,
       count(*) FILTER (ts < mx - INTERVAL 7 DAY) AS comparison_count, min(event_id) FILTER (ts >= mx - INTERVAL 7 DAY) AS first_position
FROM events, bounds WHERE ts >= mx - INTERVAL 14 DAY GROUP BY event_type HAVING count(*) FILTER (ts >= mx - INTERVAL 7 DAY) > 0""")
def _(spark, folder):
    """Periods that begin within a day: of the two days concerned the events are read."""
    items = table(spark, folder, "events").select(F.col("event_type").alias("category"), F.col("ts").alias("created_at"), F.col("event_id").alias("review_number"))
    path = period_counts.store_days(items, new_path(spark, "days"))
    return period_counts.stored_period_compare(spark, path, recent_days=7, comparison_days=14, items=items)


@query("issue_brief", with_fixtures(f"{ORD} cnt top3 ranked compared surge emerging", """
SELECT category, n, percentage,
       string_agg(brief_issue, ' / ' ORDER BY example_rank) FILTER (example_rank <= 3) AS examples,
       string_agg(brief_issue, ' / ' ORDER BY example_rank) AS complaints,
       max(increase_rate) AS increase_rate
FROM top3 JOIN ranked USING (category) LEFT JOIN emerging USING (category)
WHERE example_rank <= 5 GROUP BY category, n, percentage"""))
def _(spark, folder):
    brief = issues.issue_brief(_periods(spark, folder), order="review_id")
    return brief.withColumns({name: F.array_join(name, " / ") for name in ("examples", "complaints")})


@query("category_share_input", """
SELECT coalesce(nullif(CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN '' ELSE event_type END, ''),
                'unknown') AS category, count(*) AS n,
       round_even(count(*) / (SELECT count(*) FROM orders) * 100, 0) AS percentage
FROM events GROUP BY 1""")
def _(spark, folder):
    kind = F.col("event_type")
    labeled = table(spark, folder, "events").select(
        F.when(kind == "view", None).when(kind == "click", "").otherwise(kind).alias("category")
    )
    return stats.category_share_input(labeled, table(spark, folder, "orders"))


@query("chart_top5_other", with_fixtures(f"{ORD} cnt", """
SELECT CASE WHEN rk <= 5 THEN category ELSE 'others' END AS category, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT *, row_number() OVER (ORDER BY n DESC, first_position) AS rk FROM cnt)
GROUP BY 1"""))
def _(spark, folder):
    return issues.chart_top(issues.category_counts(_recent(spark, folder), "review_id"))


# --- order, pages, samples -----------------------------------------------------------


@query("newest_first", with_fixtures("f_ord", "SELECT review_id, created_at FROM f_ord ORDER BY created_at DESC, review_id"))
def _(spark, folder):
    return positions.newest_first(fx.f_ord(spark, folder).select("review_id", "created_at"))


@query("newest_sample", with_fixtures("f_doc", """
SELECT review_id, created_at, review_text FROM f_doc ORDER BY created_at DESC, review_id LIMIT 200"""))
def _(spark, folder):
    return positions.newest_sample(fx.f_doc(spark, folder)).select("review_id", "created_at", "review_text")


@query("newest_sample_per_group", with_fixtures("f_ord", """
SELECT category, review_id, created_at FROM f_ord
QUALIFY row_number() OVER (PARTITION BY category ORDER BY created_at DESC, review_id) <= 200"""))
def _(spark, folder):
    reviews = fx.f_ord(spark, folder).select("category", "review_id", "created_at")
    return positions.newest_sample(reviews, 200, ["category"])


_SHOWN = ["review_id", "rating", "created_at", "rating_score", "length_score", "keyword_score", "recency_score", "score", "level"]
_ORDER = "ORDER BY score DESC, created_at DESC, review_id"


@query("priority_top", with_fixtures(SCORED, f"SELECT {', '.join(_SHOWN)} FROM scored WHERE rating <= 3 {_ORDER} LIMIT 20"))
def _(spark, folder):
    scored = priority.negative_scored(fx.f_doc(spark, folder), **fx.SCORING)
    return priority.priority_top(scored).select(*_SHOWN)


@query("paginate_reviews", with_fixtures("f_doc", """
SELECT review_id, rating, review_text FROM f_doc ORDER BY review_id LIMIT 20 OFFSET 40"""))
def _(spark, folder):
    page = positions.paginate(fx.f_doc(spark, folder), ["review_id"], 3)
    return page.select("review_id", "rating", "review_text")


@query("stored_page", with_fixtures("f_doc", """
SELECT review_id, created_at, rating, row_number() OVER (ORDER BY created_at DESC, review_id) - 1 AS rank
FROM f_doc ORDER BY created_at DESC, review_id LIMIT 20 OFFSET 80"""))
def _(spark, folder):
    """A page that begins in one stored file and ends in the next."""
    reviews = fx.f_doc(spark, folder).select("review_id", "created_at", "rating")
    path = stored_pages.store_pages(reviews, new_path(spark, "pages"), stored_pages.newest_order(), rows_per_file=90)
    return stored_pages.stored_page(spark, path, 5)


@query("stored_priority_page", with_fixtures(SCORED, f"""
SELECT review_id, score, level FROM scored WHERE rating <= 3 {_ORDER} LIMIT 20 OFFSET 40"""))
def _(spark, folder):
    scored = priority.negative_scored(fx.f_doc(spark, folder), **fx.SCORING).select("review_id", "created_at", "score", "level")
    path = stored_pages.store_pages(scored, new_path(spark, "pages"), stored_pages.priority_sorted())
    return stored_pages.stored_page(spark, path, 3).select("review_id", "score", "level")


@query("page_counts", "SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS total_pages FROM documents")
def _(spark, folder):
    return positions.page_counts(table(spark, folder, "documents"))


@query("page_after", with_fixtures("f_doc", """
SELECT review_id, rating FROM f_doc WHERE review_id > 59 ORDER BY review_id LIMIT 20"""))
def _(spark, folder):
    return positions.page_after(fx.f_doc(spark, folder).select("review_id", "rating"), "review_id", 59)


@query("paginate_priority", with_fixtures(SCORED, f"""
SELECT review_id, score, level FROM scored WHERE rating <= 3 AND level = 'high' {_ORDER} LIMIT 20 OFFSET 20"""))
def _(spark, folder):
    scored = priority.negative_scored(fx.f_doc(spark, folder), **fx.SCORING)
    return priority.paginate_priority(scored, 2, level="high").select("review_id", "score", "level")


@query("priority_page_counts", with_fixtures(SCORED, """
SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS total_pages FROM scored WHERE rating <= 3 AND level = 'high'"""))
def _(spark, folder):
    return priority.priority_page_counts(priority.negative_scored(fx.f_doc(spark, folder), **fx.SCORING), level="high")


@query("priority_page_after", with_fixtures(SCORED, f"""
SELECT review_id, score, level FROM scored WHERE rating <= 3 AND (score < 60 OR score = 60 AND
  (created_at < TIMESTAMP '2024-01-20' OR created_at = TIMESTAMP '2024-01-20' AND review_id > 100)) {_ORDER} LIMIT 20"""))
def _(spark, folder):
    scored = priority.negative_scored(fx.f_doc(spark, folder), **fx.SCORING)
    return priority.priority_page_after(scored, 60, "2024-01-20 00:00:00", 100).select("review_id", "score", "level")


@query("chunk_requests", """
SELECT doc_id, p // 10 AS batch, p - p % 10 AS chunk_start, CAST(p % 10 + 1 AS INTEGER) AS review_index
FROM (SELECT doc_id * 7 - 3 AS doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents)""")
def _(spark, folder):
    """All documents, under keys with gaps."""
    docs = table(spark, folder, "documents").select((F.col("doc_id") * 7 - 3).alias("doc_id"))
    return positions.chunk_requests(docs, "doc_id")


# A random 64-bit order that SQL can name as well: the first half of an md5, read as a number.
_HASHED = "CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 16))::UBIGINT::HUGEINT - 9223372036854775808 AS BIGINT)"


def _hashed_docs(spark, folder):
    digits = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 16)
    number = F.conv(digits, 16, 10).cast("decimal(20,0)") - F.lit("9223372036854775808").cast("decimal(20,0)")
    return table(spark, folder, "documents").select("doc_id", number.cast("bigint").alias("key"))


@query("chunk_requests_any_key", f"""
SELECT key, p // 10 AS batch, p - p % 10 AS chunk_start, CAST(p % 10 + 1 AS INTEGER) AS review_index
FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS p FROM (SELECT {_HASHED} AS key FROM documents))""")
def _(spark, folder):
    """All documents in the order of random 64-bit keys."""
    return positions.chunk_requests(_hashed_docs(spark, folder).select("key"), "key")


@query("position_in_group", """
SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS place FROM documents""")
def _(spark, folder):
    """Place of each document in its source by length and id, a source with a third of all rows included."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    return positions.with_position(docs, ["n_chars", "doc_id"], "place", group=["source"]).drop("n_chars")


# --- columns ------------------------------------------------------------------------------

for _name in ("rating", "length", "keyword", "recency"):
    _column = f"{_name}_score"

    @query(f"priority_{_name}", with_fixtures("f_doc factors", f"SELECT review_id, {_column} FROM factors"))
    def _(spark, folder, column=_column):
        return priority.with_factors(fx.f_doc(spark, folder), **fx.SCORING).select("review_id", column)


@query("priority_level", with_fixtures(SCORED, "SELECT review_id, level FROM scored"))
def _(spark, folder):
    return priority.with_priority(fx.f_doc(spark, folder), **fx.SCORING).select("review_id", "level")


@query("priority_score", with_fixtures(SCORED, f"SELECT {', '.join(_SHOWN)}, review_text FROM scored"))
def _(spark, folder):
    nested = priority.nested_priority(priority.with_priority(fx.f_doc(spark, folder), **fx.SCORING))
    return nested.select(
        "review_id", "rating", "created_at",
        *[F.col(f"priority.factors.{name}").alias(f"{name}_score") for name in ("rating", "length", "keyword", "recency")],
        "priority.score", "priority.level", "review_text",
    )


fx.SQL["hosts"] = "SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS host FROM pages"


@query("detect_platform", with_fixtures("hosts", """
SELECT page_id, CASE WHEN contains(host, 'th') THEN 'shop_a' WHEN contains(host, 'en') OR contains(host, 'es') THEN 'shop_b'
                     ELSE 'unknown' END AS platform FROM hosts"""))
def _(spark, folder):
    rules = [("th", "shop_a"), ("en", "shop_b"), ("es", "shop_b")]
    return table(spark, folder, "pages").select("page_id", platform_of(F.col("url"), rules).alias("platform"))


@query("extract_product_id", r"""
SELECT page_id, nullif(regexp_extract(url, '/[a-z]+/([0-9]+)', 1), '') AS product_id FROM pages""")
def _(spark, folder):
    product = product_id_of(F.col("url"), r"/[a-z]+/(\d+)")
    return table(spark, folder, "pages").select("page_id", product.alias("product_id"))


_STOP_SQL = ", ".join(f"'{word}'" for word in STOPWORDS)
_LETTERS = fx.BLANK_SQL.replace("[", r"[^\p{L}", 1)
fx.SQL["words"] = f"""
SELECT doc_id AS review_id,
       string_split_regex(regexp_replace(lower(text), '{_LETTERS}', '', 'g'), '{fx.BLANK_SQL}+') AS parts
FROM documents"""


@query("tokenize", with_fixtures("words", f"""
SELECT review_id,
       array_to_string(list_filter(parts, lambda w: length(w) >= 2 AND w NOT IN ({_STOP_SQL})), ' ') AS words
FROM words"""))
def _(spark, folder):
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("review_id"), F.array_join(tokens(F.col("text"), STOPWORDS), " ").alias("words")
    )


@query("text_preview", """
SELECT doc_id AS review_id,
       CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '...' ELSE text END AS p30,
       CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS p50,
       substr(text, 1, 100) || '...' AS p100, substr(text, 1, 150) || '...' AS p150,
       substr(text, 1, 200) || '...' AS p200, substr(text, 1, 500) AS p500 FROM documents""")
def _(spark, folder):
    sizes = {30: "longer", 50: "longer", 100: "always", 150: "always", 200: "always", 500: "never"}
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("review_id"),
        *[preview(F.col("text"), size, dots).alias(f"p{size}") for size, dots in sizes.items()],
    )
