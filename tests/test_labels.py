"""Metrics, errors, votes, neighbours, training sets against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaintide.functions.vocabulary import STOPWORDS
from plaintide.operators import consensus, errors, evaluation as ev, knn, training
from plaintide.plans import catalog, composites, fixtures
from tests.conftest import TABLES
from tests.test_answers import plain_tokens


@pytest.fixture(scope="module")
def labeled(spark):
    rng = random.Random(3)
    words = "late broken price cheap the and box missing wrong blue".split()
    rows = []
    for i in range(300):
        # A third of the rows has one label and one confusion.
        true = "hot" if i % 3 == 0 else rng.choice("abcd")
        pred = "a" if i % 3 == 0 and rng.random() < 0.8 else rng.choice(["a", "b", "c", "hot", "only_predicted"])
        text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 20, 60])))
        rows.append((i, text, float(i % 5 + 1) if i % 7 else None, true, pred))
    schema = "review_id bigint, review_text string, rating double, true_label string, predicted_label string"
    return rows, spark.createDataFrame(rows, schema).repartition(5)


def expected_classes(rows):
    labels = sorted({r[3] for r in rows} | {r[4] for r in rows})
    out = {}
    for label in labels:
        hits = sum(r[3] == label == r[4] for r in rows)
        support, predicted = sum(r[3] == label for r in rows), sum(r[4] == label for r in rows)
        p, r = (hits / predicted if predicted else 0.0), (hits / support if support else 0.0)
        out[label] = (p, r, 2 * p * r / (p + r) if p + r else 0.0, support)
    return out


def test_metrics(labeled):
    rows, frame = labeled
    classes, pairs = expected_classes(rows), ev.label_pairs(frame)
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in ev.class_metrics(pairs).collect()}
    assert got.keys() == classes.keys()
    assert all(got[k] == pytest.approx(classes[k]) for k in classes)
    assert [r.label for r in ev.eval_per_class(pairs).collect()] == sorted({r[3] for r in rows})
    total = ev.eval_weighted(pairs, None).first()
    for i, name in enumerate(["precision_weighted", "recall_weighted", "f1_weighted"]):
        assert total[name] == pytest.approx(sum(c[i] * c[3] for c in classes.values()) / len(rows))
    hits = sum(r[3] == r[4] for r in rows)
    assert total.accuracy == pytest.approx(hits / len(rows))
    assert ev.eval_accuracy(pairs).first().accuracy == round(hits / len(rows), 4)


def test_no_predictions(labeled):
    empty = ev.label_pairs(labeled[1].limit(0))
    assert tuple(ev.eval_weighted(empty, None).first()) == (0.0, 0.0, 0.0, 0.0)
    assert ev.confusion_matrix(empty).count() == 0


def test_confusion_matrix(labeled):
    rows, frame = labeled
    cells = {(r.true_label, r.predicted_label): r.n for r in ev.confusion_matrix(ev.label_pairs(frame)).collect()}
    labels = [r.label for r in ev.label_union(frame).collect()]
    assert labels == sorted(labels) and len(cells) == len(labels) ** 2
    assert sum(cells.values()) == len(rows)
    assert {k: v for k, v in cells.items() if v} == dict(Counter((r[3], r[4]) for r in rows))


def test_strategies(spark):
    rows = [("zero_shot", 0, "a", "a"), ("zero_shot", 0, "a", "b"), ("cot", 1, "a", "a"), ("cot", 1, "b", "b"),
            ("temperature_0.5", 2, "a", "a"), ("temperature_0.5", 2, "b", "b")]
    accuracy = ev.strategy_accuracy(spark.createDataFrame(rows, "strategy string, strategy_order int, true_label string, predicted_label string"))
    got = {r.strategy: (r.accuracy, r.improvement, r.is_best) for r in ev.strategy_summary(accuracy).collect()}
    assert got == {"zero_shot": (0.5, 0.0, False), "cot": (1.0, 50.0, True), "temperature_0.5": (1.0, 50.0, False)}
    stages = accuracy.withColumnRenamed("strategy", "stage")
    report = {r.stage: (r.accuracy_pct, r.improvement) for r in ev.stage_report(stages, "zero_shot").collect()}
    assert report == {"Zero Shot": (50.0, None), "Cot": (100.0, 50.0)}
    assert {r.improvement for r in ev.stage_report(stages, "missing").collect()} == {0.0}


def test_missing_base_metric_is_zero(spark):
    base = spark.createDataFrame([("accuracy", 0.5)], "metric string, value double")
    new = spark.createDataFrame([("accuracy", 0.75), ("f1", 0.5)], "metric string, value double")
    got = {r.metric: (r.base_pct, r.new_pct, r.improvement) for r in ev.metric_delta(base, new).collect()}
    assert got == {"accuracy": (50.0, 75.0, 25.0), "f1": (0.0, 50.0, 50.0)}


def test_errors(labeled):
    rows, frame = labeled
    wrong = [r for r in rows if r[3] != r[4]]
    bad = ev.mismatch_rows(frame)
    assert {r.review_id for r in bad.collect()} == {r[0] for r in wrong}
    pairs = Counter((r[3], r[4]) for r in wrong)
    assert [((r.true_label, r.predicted_label), r.n) for r in errors.confusion_pairs(bad).collect()] == pairs.most_common()
    top = [p for p, _ in pairs.most_common(3)]
    for pair_rank, pair in enumerate(top, 1):
        words = Counter(w for r in wrong if (r[3], r[4]) == pair for w in plain_tokens(r[1]))
        got = errors.confusion_keywords(bad).filter(F.col("pair_rank") == pair_rank).orderBy("keyword_rank").collect()
        assert [(r.keyword, r.n) for r in got] == words.most_common(10)
    by_length = Counter(
        "very_short" if len(r[1]) < 50 else "short" if len(r[1]) < 150 else "medium" if len(r[1]) < 300 else "long" for r in wrong)
    assert {r.bucket: r.n for r in errors.errors_by_length(bad).collect()} == by_length
    by_rating = Counter(str(int(r[2])) for r in wrong if r[2] is not None)
    assert {r.rating_key: r.n for r in errors.errors_by_rating(bad).collect()} == by_rating
    advice = [(r.kind, r.n) for r in errors.error_suggestions(bad).collect()]
    expected = [("confused_pair", pairs.most_common(1)[0][1])]
    if by_length["very_short"] > len(wrong) * 0.2:
        expected.append(("short_text", by_length["very_short"]))
    label, n = Counter(r[3] for r in wrong).most_common(1)[0]
    if n > len(wrong) * 0.15:
        expected.append(("frequent_label", n))
    assert advice == expected


def test_empty_error_report(labeled):
    none = ev.mismatch_rows(labeled[1]).limit(0)
    assert all(part.count() == 0 for part in composites.error_report(none).values())


def once(spark, frame):
    """``frame``, and a counter of the rows that were made for it."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    return frame.mapInPandas(count, frame.schema), made


def test_matrix_reads_predictions_once(spark, labeled):
    frame = labeled[1].select("true_label", "predicted_label")
    counted, made = once(spark, frame)
    rows = ev.confusion_matrix(ev.label_pairs(counted)).collect()
    assert made.value == frame.count() == sum(r.n for r in rows)


def test_votes(spark):
    rows = [(1, 0, "a", 0.2), (1, 1, "b", 0.9), (1, 2, "a", 0.3), (2, 0, "x", None), (2, 1, "y", 1.0), (3, 2, "p", 0.5), (3, 1, "q", 0.5)]
    votes = spark.createDataFrame(rows, "review_id int, agent_id int, category string, confidence double")
    major = {r.review_id: (r.final_category, r.vote_count, r.total_votes, r.agreement_rate) for r in consensus.vote_majority(votes).collect()}
    assert major == {1: ("a", 2, 3, 2 / 3), 2: ("x", 1, 2, 0.5), 3: ("q", 1, 2, 0.5)}
    heavy = {r.review_id: (r.final_category, r.weighted_score, r.total_weight) for r in consensus.vote_weighted(votes).collect()}
    assert heavy[1] == ("b", 0.9, pytest.approx(1.4)) and heavy[2] == ("x", 1.0, 2.0) and heavy[3][0] == "q"
    batch = consensus.consensus_batch(spark.createDataFrame([(1, "t"), (9, "u")], "review_id int, review_text string"), votes, "weighted")
    assert [(r.review_id, r.final_category) for r in batch.collect()] == [(1, "b")]
    with pytest.raises(ValueError):
        consensus.consensus_batch(batch, votes, "model")


def vectors(copies):
    """Clustered vectors; a third of them are copies of one if asked for."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 8)) * 4
    data = (centers[rng.integers(0, 6, 400)] + rng.normal(size=(400, 8))).astype("float32")
    if copies:
        data[::3] = data[0]
    return data


def brute_force(data, k, skip_self):
    out = {}
    for i, v in enumerate(data.astype(float)):
        dist = ((data.astype(float) - v) ** 2).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(len(data)), dist)) if not (skip_self and j == i)]
        out[i] = order[:k]
    return out


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "block_rows": 40}, {"broadcast_bytes": 0, "block_rows": 4096}])
@pytest.mark.parametrize("k, skip_self, shift", [(1, True, 0), (5, True, 1000), (3, False, 0)])
def test_neighbours(spark, copies, options, k, skip_self, shift):
    data = vectors(copies) + np.float32(shift)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id bigint, embedding array<float>").repartition(3)
    found = knn.knn_retrieve(
        frame.withColumnRenamed("id", "review_id"),
        frame.select(F.col("id").alias("neighbor_id"), "embedding", (F.col("id") % 4).alias("category")),
        k, skip_self, **options,
    ).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.review_id, r.neighbor_rank)):
        got.setdefault(r.review_id, []).append(r.neighbor_id)
    assert got == brute_force(data, k, skip_self)


def near(frame, k, skip_self=True, **options):
    return knn.knn_retrieve(
        frame.withColumnRenamed("id", "review_id"),
        frame.select(F.col("id").alias("neighbor_id"), "embedding", F.col("id").cast("string").alias("category")), k, skip_self, **options)


def ids_of(found):
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.review_id, r.neighbor_rank)):
        assert r.category == str(r.neighbor_id)
        got.setdefault(r.review_id, []).append(r.neighbor_id)
    return got


def test_reviews_of_one_file_are_dealt_to_tasks(spark, monkeypatch):
    """A file that comes as one task does not make one task of the comparison."""
    monkeypatch.setattr(knn, "TASK_PAIRS", 10_000)
    data = vectors(True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id bigint, embedding array<float>").coalesce(1)
    found = near(frame, 3)
    assert found.rdd.getNumPartitions() >= 16
    assert ids_of(found) == brute_force(data, 3, True)


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "block_rows": 20}])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_of_scattered_vectors(spark, options, kind):
    """In many dimensions, where no cell is ruled out; with copies, and lengths from 1e-6 to 1e9."""
    rng = np.random.default_rng(2)
    data = rng.normal(size=(500, 40))
    data /= np.sqrt((data**2).sum(axis=1))[:, None]
    data[100:130] = data[99]
    data[200:240] *= 1e-6
    data[300:304] *= 1e9
    data = data.astype("float32" if kind == "float" else "float64")
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], f"id bigint, embedding array<{kind}>").repartition(3)
    found = near(frame, 4, **options)
    assert ids_of(found) == brute_force(data, 4, True)


def test_scattered_reviews_are_sent_to_blocks(spark, monkeypatch):
    """Not to each of the cells, when all of them may hold a neighbour."""
    rng = np.random.default_rng(2)
    data = rng.normal(size=(500, 40)).astype("float32")
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id bigint, embedding array<float>")
    sent = []
    real = type(frame).mapInPandas

    def mapped(self, func, schema, *args, **kwargs):
        out = real(self, func, schema, *args, **kwargs)
        if schema.startswith("review_id"):
            sent.append(out)
        return out

    monkeypatch.setattr(type(frame), "mapInPandas", mapped)
    assert ids_of(near(frame, 3, broadcast_bytes=0, block_rows=20)) == brute_force(data, 3, True)
    assert [out.count() for out in sent] == [3 * 500]


def test_no_examples(spark):
    queries = spark.createDataFrame([(1, [0.0])], "review_id bigint, embedding array<float>")
    none = spark.createDataFrame([], "neighbor_id bigint, embedding array<float>, category string")
    assert knn.knn_retrieve(queries, none).count() == 0
    one = spark.createDataFrame([(4, [1.0], "a")], "neighbor_id bigint, embedding array<float>, category string")
    assert [(r.category, r.distance) for r in knn.knn_retrieve(queries, one, 3).collect()] == [("a", 1.0)]
    assert [(r.category, r.distance) for r in knn.knn_retrieve(queries, one, 3, broadcast_bytes=0).collect()] == [("a", 1.0)]


@pytest.mark.parametrize("n, share", [(0, 0.2), (1, 0.2), (2, 0.5), (7, 0.2), (100, 0.2), (333, 0.1), (50, 1.0), (50, 0.0)])
@pytest.mark.parametrize("parts", [1, 6])
def test_split(spark, n, share, parts):
    texts = [f"review {i}" for i in range(n)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "review_id int, review_text string").repartition(parts)
    split = training.train_valid_split(frame, share).collect()
    assert len(split) == n
    ordered = sorted(texts, key=lambda t: hashlib.md5(f"{t}-42".encode()).hexdigest())
    assert {r.review_text for r in split if r.part == "train"} == set(ordered[: int(n * (1 - share))])


def test_dedup_with_many_copies(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"t{i % 50}") for i in range(600)]
    frame = spark.createDataFrame(rows, "review_id int, review_text string").repartition(8)
    kept = {r.review_text: r.review_id for r in training.dedup_text(frame).collect()}
    expected = {}
    for i, text in rows:
        expected.setdefault(text, i)
    assert kept == expected


def test_sample(spark):
    frame = spark.range(500).select(F.col("id").alias("review_id"), F.lit("t").alias("review_text"), F.lit(1).alias("rating"))
    first, again = (training.sample_for_labeling(frame.repartition(p)).collect() for p in (1, 8))
    assert first == again and len(first) == 100 and {r.manual_label for r in first} == {""}
    assert training.sample_for_labeling(frame.limit(3)).count() == 3


def test_training_files(spark, tmp_path):
    from plaintide.sources.results import write_chat_jsonl

    rows = [(i, f"리뷰 {i}\n\"x\"", "other") for i in range(10)]
    frame = spark.createDataFrame(rows, "review_id int, review_text string, manual_label string")
    paths = write_chat_jsonl(training.train_valid_split(frame), str(tmp_path / "chat"))
    lines = {part: spark.read.json(path).collect() for part, path in paths.items()}
    assert len(lines["train"]) == 8 and len(lines["valid"]) == 2
    message = lines["train"][0].messages
    assert [m.role for m in message] == ["system", "user", "assistant"]
    assert message[1].content.startswith("Categorize this review: 리뷰 ") and message[2].content == "other"


def test_stopwords_are_many():
    assert len(STOPWORDS) == len(set(STOPWORDS)) > 100


@pytest.mark.parametrize("name", ["model_comparison", "metric_delta"])
def test_two_models_by_one_search(spark, monkeypatch, name):
    searches = []
    real = fixtures.knn_retrieve
    monkeypatch.setattr(fixtures, "knn_retrieve", lambda *args, **kwargs: searches.append(args[2]) or real(*args, **kwargs))
    assert catalog.QUERIES[name](spark, TABLES).count() == 4
    assert searches == [5]


def test_report_makes_predictions_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)
    real = fixtures.f_eval

    def counted(*args):
        frame = real(*args)

        def count(batches):
            for batch in batches:
                made.add(len(batch))
                yield batch

        return frame.mapInPandas(count, frame.schema)

    monkeypatch.setattr(fixtures, "f_eval", counted)
    assert catalog.QUERIES["evaluation_report"](spark, TABLES).count() > 100
    assert made.value == 500
