"""The index against exact neighbours: all lists give the same rows, few give most of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaintide.operators import knn, knn_index
from tests.conftest import TABLES

SCHEMA = "neighbor_id bigint, embedding array<float>, category string"


def frames(spark, vectors, every=1):
    rows = [(i, None if v is None else [float(x) for x in v], f"c{i % 4}") for i, v in enumerate(vectors)]
    examples = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return examples.where(f"neighbor_id % {every} = 0").select(F.col("neighbor_id").alias("review_id"), "embedding"), examples


def rows(df):
    return sorted((r.review_id, r.neighbor_rank, r.neighbor_id, r.category, round(r.distance, 5)) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16)) * 4
    return np.concatenate([centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 16)), np.tile(centres[:1], (500, 1))]).astype(np.float32)


@pytest.mark.parametrize("skip_self", [False, True])
def test_all_lists_are_exact(spark, clustered, skip_self):
    """Also where a quarter of all vectors are equal; blocks of a few rows change nothing."""
    queries, examples = frames(spark, clustered, 20)
    index = knn_index.build(examples, knn_index.fit(examples, lists=12), 3)
    assert index.rows.count() == 1504
    exact = rows(knn.knn_retrieve(queries, examples, 3, skip_self))
    for block_rows in (8192, 50):
        assert rows(knn_index.search(index, queries, 3, 12, skip_self, refine=30, block_rows=block_rows)) == exact


def test_few_lists_find_most(spark, clustered):
    queries, examples = frames(spark, clustered, 10)
    index = knn_index.build(examples, knn_index.fit(examples), 3)
    probes = knn_index.choose_probes(index, queries, 3, recall=0.95)
    assert len(index.centres) == 45 and probes <= 12
    found = knn_index.search(index, queries, 3, probes)
    measured = knn_index.recall(found, knn.knn_retrieve(queries, examples, 3)).first()
    assert measured.queries == 200 and measured.neighbors == 600 and measured.recall >= 0.9


def test_recall_on_the_table(spark):
    vectors = spark.read.parquet(f"{TABLES}/embeddings.parquet")
    queries, examples = vectors.select(F.col("vec_id").alias("review_id"), "embedding"), vectors.select(
        F.col("vec_id").alias("neighbor_id"), "embedding", F.col("label").cast("string").alias("category"))
    index = knn_index.build(examples, knn_index.fit(examples), 3)
    found = knn_index.search(index, queries, 3, knn_index.choose_probes(index, queries, 3, skip_self=True), skip_self=True)
    assert knn_index.recall(found, knn.knn_retrieve(queries, examples, 3, skip_self=True)).first().recall >= 0.9


def test_odd_vectors_and_nothing(spark):
    vectors = [[0, 0], [1, 0], None, [float("nan"), 0], [float("inf"), 1], [0, 1]]
    queries, examples = frames(spark, vectors)
    index = knn_index.build(examples, knn_index.fit(examples), 2)
    assert rows(knn_index.search(index, queries, 2, 2, skip_self=True)) == rows(knn.knn_retrieve(queries, examples, 2, skip_self=True))
    none = examples.limit(0)
    empty = knn_index.build(none, knn_index.fit(none), 2)
    assert knn_index.choose_probes(empty, queries, 2) == 1 and knn_index.search(empty, queries, 2).count() == 0
    with pytest.raises(ValueError):
        knn_index.search(index, queries, 3)


def test_batches_of_many_rows_are_cut(spark, clustered, monkeypatch):
    """Tasks hold the distances of some rows at a time, whatever the batches and the number of lists."""
    real, most = knn_index._square_distances, knn_index.BATCH_ROWS

    def bounded(vectors, centres):
        if max(len(vectors), len(centres)) > most:
            raise MemoryError("too many rows at a time")
        return real(vectors, centres)

    monkeypatch.setattr(knn_index, "_square_distances", bounded)
    queries, examples = frames(spark, clustered, 20)
    examples = examples.coalesce(1)
    index = knn_index.build(examples, knn_index.fit(examples, lists=12), 3)
    assert index.rows.count() == 1504
    assert knn_index.choose_probes(index, queries, 3) >= 1


@pytest.mark.parametrize("queries, examples", [(1, 1), (3, 5), (7, 64), (16, 33)])
def test_pairs_of_a_tile_in_memory_used_again(queries, examples):
    rng, tile = np.random.default_rng(queries), knn._Tile(16, 64)
    held = tile.products, tile.within
    for share in (0.0, 0.02, 0.5, 1.0):
        sides, rough = (rng.random((n, 9), np.float32) for n in (queries, examples))
        bound = np.quantile(sides @ rough.T, share, axis=1, method="lower").astype(np.float32)[:, None]
        want = np.nonzero(np.matmul(sides, rough.T) <= bound)
        for found, other in zip(tile.pairs(sides, rough, bound), want):
            assert found.tolist() == other.tolist()
    assert held[0] is tile.products and held[1] is tile.within
