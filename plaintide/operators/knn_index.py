"""Nearest labeled examples by an index: inverted lists with residual codes.

Exact search compares every review with most examples, because in many
dimensions no bound rules them out. The index gives up exactness for less work,
and measures what it gives up:

* ``fit`` finds the centres of the lists by k-means on a bounded sample.
* ``build`` puts every example in the list of its nearest centre, with what is
  left of it in one byte a dimension.
* ``choose_probes`` compares a bounded sample of queries with *all* examples
  exactly, and takes the fewest lists that hold the wanted share of neighbours.
* ``search`` sends each review to so many lists, ranks by the codes, and
  measures the best few of each review on the vectors themselves.

What is shuffled are the codes once, each review once for a probe, and the few
best. Lists and the reviews in them are cut in blocks of bounded size. Of equal
vectors a list keeps as many as a review can need, so copies that make up a
third of the table are a few rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .knn import _matrix, _slices, usable_vector

MOST_LISTS = 4096
SAMPLE_PER_LIST = 64  # examples that the centres are fitted on
QUERY_SAMPLE = 256  # queries that the number of probes is chosen by
BLOCK_ROWS = 8192
BATCH_ROWS = 1024  # examples whose distances to all centres, or queries, are held at a time
REFINE = 8  # candidates measured exactly, for each neighbour wanted

# As in ``knn``: tasks need numpy and pandas, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Index:
    """``rows``: ``list, neighbor_id, category, embedding, scale, code``; ``centres``: one row for each list."""

    rows: DataFrame
    centres: np.ndarray
    copies: int


def _square_distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    middle = centres.mean(axis=0)
    v, c = vectors - middle, centres - middle
    return (v * v).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (v @ c.T)


def _some(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of the key."""
    n = df.count()
    return df if n <= rows else df.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(n)) < rows)


def fit(examples: DataFrame, lists: int | None = None, steps: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of ``lists`` lists (the square root of the number of examples, at most 4096).

    They are fitted on about 64 examples for each list; all other work is on all
    examples. Equal vectors count once.
    """
    usable = examples.filter(usable_vector()).select("neighbor_id", "embedding")
    n = usable.count()
    if n == 0:
        return np.zeros((0, 0))
    lists = lists or int(min(MOST_LISTS, max(1, round(n ** 0.5))))
    some = _some(usable, "neighbor_id", SAMPLE_PER_LIST * lists).select("embedding").distinct()
    vectors = cut_lineage(some).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=lists, maxIter=steps, initMode="random", seed=seed).fit(vectors)
    return np.array(model.clusterCenters())


def build(examples: DataFrame, centres: np.ndarray, k: int) -> Index:
    """Every usable example in the list of its nearest centre; of equal vectors the first ``k + 1`` by id, which are all that ``k`` neighbours need."""
    usable = examples.filter(usable_vector()).select(F.col("neighbor_id").cast("bigint"), "embedding", "category")
    copy = F.row_number().over(Window.partitionBy("embedding").orderBy("neighbor_id"))
    needed = usable.withColumn("_copy", copy).where(F.col("_copy") <= k + 1).drop("_copy")
    kinds = dict(usable.dtypes)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in _slices(whole, BATCH_ROWS)):
            if len(batch):
                vectors = _matrix(batch["embedding"])
                at = _square_distances(vectors, centres).argmin(axis=1)
                rest = vectors - centres[at]
                scale = np.maximum(np.abs(rest).max(axis=1) / 127.0, 1e-30)
                codes = np.rint(rest / scale[:, None]).astype(np.int8)
                yield batch.assign(list=at.astype("int32"), scale=scale, code=[c.tobytes() for c in codes])

    schema = f"neighbor_id bigint, embedding {kinds['embedding']}, category {kinds['category']}, list int, scale double, code binary"
    return Index(cut_lineage(needed.mapInPandas(assign, schema)), centres, k)


def _exact_lists(index: Index, queries: pd.DataFrame, k: int, skip_self: bool) -> pd.DataFrame:
    """``review_id, list`` of the ``k`` true neighbours of a few queries: every task keeps the best of its examples."""
    ids, vectors = queries["review_id"].to_numpy(), _matrix(queries["embedding"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in _slices(whole, BATCH_ROWS)):
            if not len(batch):
                continue
            far, own = _square_distances(vectors, _matrix(batch["embedding"])), batch["neighbor_id"].to_numpy()
            if skip_self:
                far[ids[:, None] == own[None, :]] = np.inf
            best = np.argsort(far, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(ids)), best.shape[1])
            yield pd.DataFrame({"review_id": ids[rows], "neighbor_id": own[best.ravel()], "list": batch["list"].to_numpy()[best.ravel()],
                                "distance": far[rows, best.ravel()]})

    near = index.rows.select("neighbor_id", "embedding", "list").mapInPandas(scan, "review_id bigint, neighbor_id bigint, list int, distance double")
    rank = F.row_number().over(Window.partitionBy("review_id").orderBy("distance", "neighbor_id"))
    return near.where("distance < double('inf')").withColumn("_rank", rank).where(F.col("_rank") <= k).select("review_id", "list").toPandas()


def choose_probes(index: Index, queries: DataFrame, k: int = 3, recall: float = 0.95, skip_self: bool = False) -> int:
    """The fewest lists a review has to visit so that they hold ``recall`` of the true neighbours of a sample of the queries.

    The sample has about 256 queries; they are compared with all examples. At
    most ``QUERY_SAMPLE * k`` rows reach the driver, twice that with luck.
    """
    some = _some(queries.filter(usable_vector()).select(F.col("review_id").cast("bigint"), "embedding"), "review_id", QUERY_SAMPLE).toPandas()
    if not len(some) or not len(index.centres):
        return 1
    true = _exact_lists(index, some, k, skip_self)
    order = np.argsort(np.argsort(_square_distances(_matrix(some["embedding"]), index.centres), axis=1, kind="stable"), axis=1)
    row = {int(i): r for r, i in enumerate(some["review_id"])}
    ranks = np.sort([order[row[int(i)], at] for i, at in zip(true["review_id"], true["list"])])
    return 1 + int(ranks[max(0, int(np.ceil(recall * len(ranks))) - 1)]) if len(ranks) else 1


def search(index: Index, queries: DataFrame, k: int = 3, probes: int = 8, skip_self: bool = False,
           refine: int = REFINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows as of ``knn_retrieve``, of the ``k`` nearest examples in the ``probes`` lists nearest to each review.

    Distances are exact, and equal ones are ordered by id; neighbours in other
    lists are missed. Vectors that are not usable are near nothing. ``k`` may
    not be larger than the one the index was built for.
    """
    if k > index.copies:
        raise ValueError(f"the index was built for {index.copies} neighbours")
    spark, centres = queries.sparkSession, index.centres
    label = dict(index.rows.dtypes)["category"]
    schema = f"review_id bigint, neighbor_id bigint, category {label}, distance double, neighbor_rank int"
    if not len(centres):
        return spark.createDataFrame([], schema)
    asked = queries.filter(usable_vector()).select(F.col("review_id").cast("bigint"), F.col("embedding").alias("q"))
    probes, kept = min(probes, len(centres)), (k + 1) * refine

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 256):
                batch = whole.iloc[start:start + 256]
                far = _square_distances(_matrix(batch["q"]), centres)
                at = np.argpartition(far, probes - 1, axis=1)[:, :probes]
                yield batch.iloc[np.repeat(np.arange(len(batch)), probes)].assign(list=at.ravel().astype("int32"))

    routed = asked.mapInPandas(route, f"review_id bigint, q {dict(asked.dtypes)['q']}, list int")
    # One row for each list.
    sizes = index.rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("c_blocks"))
    visits = routed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("q_blocks"))
    plan = spark.createDataFrame(sizes.join(visits, "list").toPandas(), "list int, c_blocks int, q_blocks int")
    part = lambda key, blocks: F.pmod(F.xxhash64(key), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    left = routed.join(F.broadcast(plan), "list").withColumn("q_block", part("review_id", "q_blocks")).withColumn("c_block", each("c_blocks"))
    right = index.rows.select("list", "neighbor_id", "scale", "code").join(F.broadcast(plan), "list") \
        .withColumn("c_block", part("neighbor_id", "c_blocks")).withColumn("q_block", each("q_blocks"))

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(q) and len(c):
            codes = np.frombuffer(b"".join(c["code"]), np.int8).reshape(len(c), -1)
            vectors = codes * c["scale"].to_numpy()[:, None] + centres[int(c["list"].iloc[0])]
            ids, own = q["review_id"].to_numpy(), c["neighbor_id"].to_numpy()
            for start in range(0, len(q), 256):
                far = _square_distances(_matrix(q["q"].iloc[start:start + 256]), vectors)
                if skip_self:
                    far[ids[start:start + 256, None] == own[None, :]] = np.inf
                best = np.argpartition(far, min(kept, len(c)) - 1, axis=1)[:, :kept]
                rows = np.repeat(np.arange(len(far)), best.shape[1])
                parts.append(pd.DataFrame({"review_id": ids[start + rows], "neighbor_id": own[best.ravel()], "rough": far[rows, best.ravel()]}))
        found = pd.concat(parts) if parts else pd.DataFrame({"review_id": [], "neighbor_id": [], "rough": []})
        return found[np.isfinite(found["rough"].astype(float))].astype({"review_id": "int64", "neighbor_id": "int64"})

    keys = ["list", "c_block", "q_block"]
    drop = ["c_blocks", "q_blocks"]
    rough = left.drop(*drop).groupBy(*keys).cogroup(right.drop(*drop).groupBy(*keys)).applyInPandas(
        compare, "review_id bigint, neighbor_id bigint, rough double")
    best = F.row_number().over(Window.partitionBy("review_id").orderBy("rough", "neighbor_id"))
    few = rough.withColumn("_best", best).where(F.col("_best") <= kept).select("review_id", "neighbor_id")
    measured = few.join(index.rows.select("neighbor_id", "embedding", "category"), "neighbor_id").join(asked, "review_id")
    square = F.zip_with("q", "embedding", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    rank = F.row_number().over(Window.partitionBy("review_id").orderBy("distance", "neighbor_id"))
    return measured.select("review_id", "neighbor_id", "category", F.aggregate(square, F.lit(0.0), lambda s, x: s + x).alias("distance")) \
        .withColumn("neighbor_rank", rank).where(F.col("neighbor_rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: ``queries``, ``neighbors`` of the exact search, and the share of them that were ``found``."""
    pair = ["review_id", "neighbor_id"]
    both = exact.select(*pair).join(found.select(*pair, F.lit(1).alias("hit")), pair, "left")
    return both.agg(F.countDistinct("review_id").alias("queries"), F.count(F.lit(1)).alias("neighbors"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))
