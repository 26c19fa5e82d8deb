"""Exact nearest labeled examples by squared Euclidean distance.

Two ways, chosen by a checked size of the example set:

* Up to ``broadcast_bytes`` of vectors: the examples are sent to every task and
  the reviews are never shuffled. This is the usual case, as examples are
  labeled by hand.
* Beyond it: the examples are grouped around pivots. For each review the
  triangle inequality rules out the pivot cells that cannot hold a neighbour;
  the review is sent to the other cells only. Cells, and the reviews sent to a
  cell, are split in blocks of bounded size, so neither a crowded cell nor many
  copies of one vector make a large task. Where the inequality rules out little,
  as in many dimensions, cells are put together to blocks of bounded size, and
  every pair is compared: the work is then the square of the rows.

Both give the same rows. Equal distances are ordered by example id.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 8192
MAX_PIVOTS = 1024
TILE_QUERIES, TILE_EXAMPLES = 256, 2048  # the matrix product held at a time
TILE_HEAD = 8192  # examples that give the first limit of a review
EXACT_NUMBERS = 1 << 21  # numbers of pairs that are measured directly at a time
TASK_PAIRS = 1 << 28  # pairs of a task; below it reviews stay in the tasks that read them
PROBED = 1024  # reviews that tell what the pivots rule out
MOST_VISITED = 0.25  # share of the examples beyond which cells are put together

# The functions below go to the tasks as code, so that executors need numpy and
# pandas but not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _rows(vectors) -> np.ndarray:
    """One row for each vector, in the vectors' own type."""
    rows = list(vectors)
    if not rows:
        return np.zeros((0, 0))
    if len({len(row) for row in rows}) > 1:
        raise ValueError("vectors of different lengths")
    return np.concatenate(rows).reshape(len(rows), -1)


def _matrix(vectors) -> np.ndarray:
    return _rows(vectors).astype(np.float64, copy=False)


@dataclass(frozen=True)
class _Examples:
    """Examples in a fixed random order, ready to be compared in single precision.

    ``rough`` holds what one product with a review ``[-2 x, 1]`` turns into the
    least square distance (less the square of x) that rounding allows.
    """

    ids: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    kinds: np.ndarray
    rough: np.ndarray
    slack: np.ndarray
    middle: np.ndarray
    scale: float
    share: float
    most_own: int


def _prepare(ids: np.ndarray, vectors: np.ndarray, categories: np.ndarray, k: int) -> _Examples:
    # Of equal vectors only the first by id can be among the k nearest; one more, as a review may meet itself.
    ids = np.asarray(ids, dtype=np.int64)
    most_own = int(np.unique(ids, return_counts=True)[1].max())
    plain = np.ascontiguousarray(vectors)
    whole = plain.view(np.dtype((np.void, plain.dtype.itemsize * plain.shape[1]))).ravel() if plain.shape[1] else np.zeros(len(plain), "S1")
    alike = np.unique(whole, return_inverse=True)[1]
    order = np.lexsort((ids, alike))
    kept = order[np.arange(len(order)) - np.searchsorted(alike[order], alike[order], side="left") < k + most_own]
    kept = np.random.default_rng(0).permutation(np.sort(kept))
    ids, plain, (kinds, labels) = ids[kept], plain[kept], pd.factorize(categories[kept], use_na_sentinel=False)
    # Measured from the middle, so that vectors far from the origin lose no digits.
    middle = np.median(plain[:4096].astype(np.float64), axis=0)
    moved = plain - middle
    scale = float(np.abs(moved).max(initial=0.0)) or 1.0
    moved /= scale
    norm = (moved * moved).sum(axis=1)
    # Twice the rounding error of a product in single precision, as a share of both squares.
    share = (moved.shape[1] + 16) * 2.0**-22
    rough = np.concatenate([moved, (norm * (1.0 - share))[:, None]], axis=1).astype(np.float32)
    return _Examples(ids, plain, labels, kinds.astype(np.int32), rough, (2.0 * share * norm).astype(np.float32), middle, scale, share, most_own)


def _nearest(q_ids: np.ndarray, q: np.ndarray, examples: _Examples, k: int, skip_self: bool):
    """(query, example, distance, rank) of the k nearest examples per query.

    Products in single precision, with a bound of their rounding error, rule out
    nearly all examples; the few that are left are measured directly in double
    precision, which makes the order of near-ties independent of how the data
    was split.
    """
    need, n = k + (examples.most_own if skip_self else 0), len(examples.ids)
    at_once = max(1, EXACT_NUMBERS // max(1, examples.vectors.shape[1]))
    groups = max(64, 4 * need)
    tile = _Tile(min(len(q_ids), TILE_QUERIES), min(n, TILE_EXAMPLES))
    out = []
    for start in range(0, len(q_ids), TILE_QUERIES):
        ids, part = q_ids[start : start + TILE_QUERIES], q[start : start + TILE_QUERIES].astype(np.float64)
        moved = (part - examples.middle) / examples.scale
        norm = (moved * moved).sum(axis=1)
        # A review far outside the examples' range would leave that of single precision: it is measured against all of them.
        far = norm > 1e30
        moved[far] = 0.0
        sides = np.concatenate([-2.0 * moved, np.ones((len(moved), 1))], axis=1).astype(np.float32)
        own = 2.0 * examples.share * norm + 1e-30
        limit = np.full(len(part), np.inf)
        head = min(n, TILE_HEAD) // groups * groups
        if head:
            # The least of each group of examples, at their largest: ``need`` examples are no farther than the limit.
            rough = sides @ examples.rough[:head].T
            rough += examples.slack[:head]
            least = rough.reshape(len(part), -1, groups).min(axis=1)
            limit = np.partition(least, need - 1, axis=1)[:, need - 1] + own
        limit[far] = np.inf
        bound = np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None]
        found, held = [], 0
        best = _Best(k)
        for low in range(0, n, TILE_EXAMPLES):
            at_q, at_c = tile.pairs(sides, examples.rough[low : low + TILE_EXAMPLES], bound)
            at_c += low
            if skip_self:
                other = ids[at_q] != examples.ids[at_c]
                at_q, at_c = at_q[other], at_c[other]
            for a in range(0, len(at_q), at_once):
                found.append((at_q[a : a + at_once], at_c[a : a + at_once]))
                held += len(found[-1][0])
                if held >= at_once:
                    best.add(found, part, examples)
                    found, held = [], 0
        best.add(found, part, examples)
        at_q, at_c, dist, rank = best.rows
        out.append((at_q + start, at_c, dist, rank))
    return [np.concatenate(parts) for parts in zip(*out)]


class _Tile:
    """Room for one product of reviews and examples, used again for each: fresh memory costs as much as the product."""

    def __init__(self, queries: int, examples: int):
        self.products = np.empty(queries * examples, np.float32)
        self.within = np.zeros(-(-queries * examples // 8) * 8, bool)

    def pairs(self, sides: np.ndarray, rough: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``sides`` and of ``rough`` whose product is at most the bound of the former."""
        shape, size = (len(sides), len(rough)), len(sides) * len(rough)
        product = np.matmul(sides, rough.T, out=self.products[:size].reshape(shape))
        np.less_equal(product, bound, out=self.within[:size].reshape(shape))
        # Few pairs are left, so eight at a time are passed over.
        whole = -(-size // 8) * 8
        self.within[size:whole] = False
        some = np.flatnonzero(self.within[:whole].view(np.uint64) != 0)
        at = (some[:, None] * 8 + np.arange(8)).ravel()
        return np.divmod(at[self.within[at]], len(rough))


class _Best:
    """The k nearest of the pairs measured so far."""

    def __init__(self, k: int):
        self.k = k
        self.rows = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32))

    def add(self, pairs, part: np.ndarray, examples: _Examples) -> None:
        if not pairs:
            return
        at_q, at_c = (np.concatenate(side) for side in zip(*pairs))
        dist = ((part[at_q] - examples.vectors[at_c]) ** 2).sum(axis=1)
        at_q, at_c, dist = (np.concatenate(two) for two in zip(self.rows, (at_q, at_c, dist)))
        order = np.lexsort((examples.ids[at_c], dist, at_q))
        at_q, at_c, dist = at_q[order], at_c[order], dist[order]
        rank = np.arange(len(at_q)) - np.searchsorted(at_q, at_q, side="left") + 1
        keep = rank <= self.k
        self.rows = (at_q[keep], at_c[keep], dist[keep], rank[keep].astype(np.int32))


def _slices(batch: pd.DataFrame, rows: int = 256) -> Iterator[pd.DataFrame]:
    for start in range(0, len(batch), rows):
        yield batch.iloc[start : start + rows]


def _result(q_ids: np.ndarray, q: np.ndarray, examples: _Examples, k: int, skip_self: bool) -> pd.DataFrame:
    at_q, at_c, dist, rank = _nearest(q_ids, q, examples, k, skip_self)
    return pd.DataFrame({
        "review_id": q_ids[at_q], "neighbor_id": examples.ids[at_c],
        "category": examples.labels[examples.kinds[at_c]], "distance": dist, "neighbor_rank": rank,
    })


def _schema(label_type: str) -> str:
    return f"review_id bigint, neighbor_id bigint, category {label_type}, distance double, neighbor_rank int"


def usable_vector(name: str = "embedding") -> Column:
    """False for a missing vector and one with a missing, infinite or undefined number, which is near nothing."""
    finite = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(name).isNotNull() & F.coalesce(finite, F.lit(False))


def skipped_vectors(df: DataFrame, name: str = "embedding") -> DataFrame:
    """One row: vectors in all, and those that ``knn_retrieve`` leaves out."""
    return df.agg(F.count(F.lit(1)).alias("vectors"), F.count_if(~usable_vector(name)).alias("skipped"))


def knn_retrieve(
    queries: DataFrame,
    examples: DataFrame,
    k: int = 3,
    skip_self: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` nearest examples of each review.

    ``queries``: ``review_id, embedding``; ``examples``: ``neighbor_id,
    embedding, category``. Returns ``review_id, neighbor_id, category,
    distance, neighbor_rank``. Vectors that are not usable are left out on both
    sides; ``skipped_vectors`` counts them. Counts the examples right away; the way by cells
    also gathers its pivots and one row of figures per cell.
    """
    vector_type = dict(queries.dtypes)["embedding"]
    known = usable_vector()
    queries = queries.filter(known).select(F.col("review_id").cast("bigint"), "embedding")
    examples = examples.filter(known).select(F.col("neighbor_id").cast("bigint"), "embedding", "category")
    size = examples.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim")
    ).first()
    label_type = dict(examples.dtypes)["category"]
    if size["n"] == 0:
        return queries.sparkSession.createDataFrame([], _schema(label_type))
    if size["n"] * size["dim"] * 8 <= broadcast_bytes:
        return _against_all(queries, examples, k, skip_self, label_type)
    return _against_cells(
        queries, examples, k, skip_self, label_type, size["n"], block_rows, vector_type
    )


def _against_all(queries, examples, k, skip_self, label_type) -> DataFrame:
    # At most ``broadcast_bytes`` of vectors, as counted by the caller.
    table = examples.toPandas()
    prepared = _prepare(table["neighbor_id"].to_numpy(), _rows(table["embedding"]), table["category"].to_numpy(), k)
    # As a tuple: tasks know the class by its code, not by its name.
    sent = queries.sparkSession.sparkContext.broadcast(tuple(vars(prepared).values()))
    # A file may come as one task; costly reviews are dealt to as many as their pairs fill.
    pairs = queries.count() * len(table)
    if pairs > TASK_PAIRS:
        queries = queries.repartition(max(queries.sparkSession.sparkContext.defaultParallelism, -(-pairs // TASK_PAIRS)), "review_id")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Examples(*sent.value)
        for batch in batches:
            if len(batch):
                yield _result(batch["review_id"].to_numpy(), _rows(batch["embedding"]), known, k, skip_self)

    return queries.mapInPandas(scan, _schema(label_type))


def _against_cells(queries, examples, k, skip_self, label_type, n, block_rows, vector_type) -> DataFrame:
    spark = queries.sparkSession
    # A fixed number of vectors, chosen by hash: reproducible and of bounded size.
    pivot_rows = (
        examples.orderBy(F.xxhash64("neighbor_id"), "neighbor_id")
        .limit(int(min(MAX_PIVOTS, max(1, n // max(1, block_rows // 8)))))
        .select("embedding").toPandas()
    )
    pivots = _matrix(pivot_rows["embedding"])
    sent_pivots, middle = spark.sparkContext.broadcast(pivots), pivots.mean(axis=0)

    def to_pivots(vectors: np.ndarray) -> np.ndarray:
        """Distances to the pivots, one column each."""
        # Measured from the middle of the pivots, so that vectors far from the
        # origin lose no digits in the difference of squares.
        p, vectors = sent_pivots.value - middle, vectors - middle
        square = (vectors**2).sum(1)[:, None] + (p**2).sum(1)[None, :] - 2.0 * (vectors @ p.T)
        return np.sqrt(np.maximum(square, 0.0))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = to_pivots(_matrix(batch["embedding"]))
                cell = far.argmin(axis=1)
                yield batch.assign(cell=cell.astype("int32"), radius=far[np.arange(len(cell)), cell])

    placed = examples.mapInPandas(
        assign,
        f"neighbor_id bigint, embedding {dict(examples.dtypes)['embedding']}, category {label_type}, cell int, radius double",
    )
    # Per cell: size, the range of radii, and the radii of the examples nearest
    # to the pivot. One more of them than k, as a review may meet itself.
    by_radius = F.row_number().over(Window.partitionBy("cell").orderBy("radius", "neighbor_id"))
    inner = (
        placed.select("cell", "radius", "neighbor_id").withColumn("_rank", by_radius)
        .filter(F.col("_rank") <= k + 1)
        .groupBy("cell").agg(F.sort_array(F.collect_list("radius")).alias("inner"))
    )
    cells = (
        placed.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("radius").alias("lo"), F.max("radius").alias("hi")
        )
        .join(inner, "cell").orderBy("cell").toPandas()  # at most MAX_PIVOTS rows
    )
    sent_cells = spark.sparkContext.broadcast((
        cells["cell"].to_numpy(), cells["lo"].to_numpy(), cells["hi"].to_numpy(),
        [np.asarray(radii, dtype=float) for radii in cells["inner"]],
    ))
    need = k + 1 if skip_self else k

    def visited(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a review and the place of a cell that may hold a neighbour."""
        cell_ids, lo, hi, inner_radii = sent_cells.value
        far = to_pivots(vectors)[:, cell_ids]
        # ``need`` examples lie within this distance of the review.
        known = np.concatenate([far[:, [i]] + radii[None, :] for i, radii in enumerate(inner_radii)], axis=1)
        if known.shape[1] >= need:
            reach = np.partition(known, need - 1, axis=1)[:, need - 1]
        else:
            reach = np.full(len(far), np.inf)
        # Sphere bounds: no example of a cell is nearer than this.
        least = np.maximum(np.maximum(far - hi[None, :], lo[None, :] - far), 0.0)
        slack = 1e-6 * (1.0 + far.max(axis=1))
        return np.nonzero(least <= (reach + slack)[:, None])

    # In many dimensions the bounds rule out little. A bounded sample of reviews tells, and then
    # cells are put together: a review is sent once for all of them, and compared with larger blocks.
    held = cells["n"].to_numpy()
    some = queries.orderBy(F.xxhash64("review_id"), "review_id").limit(PROBED).select("embedding").toPandas()
    share = held[visited(_matrix(some["embedding"]))[1]].sum() / (len(some) * held.sum()) if len(some) else 0.0
    c_rows, q_rows = block_rows, block_rows
    units = np.arange(len(cells))
    if share > MOST_VISITED:
        c_rows, q_rows = 16 * block_rows, 4 * block_rows
        tiles = -(-int(held.sum()) // (12 * block_rows))
        units = (np.cumsum(held) - held) * tiles // held.sum()
    sizes = np.bincount(units, held, minlength=units.max() + 1)
    unit_of = {int(cell): int(unit) for cell, unit in zip(cells["cell"], units)}

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (part for whole in batches for part in _slices(whole)):
            row, col = visited(_matrix(batch["embedding"]))
            row, unit = np.divmod(np.unique(row * len(sizes) + units[col]), len(sizes))
            yield batch.iloc[row].assign(unit=unit.astype("int32"))

    routed = queries.mapInPandas(route, f"review_id bigint, embedding {vector_type}, unit int")
    visits = {row["unit"]: row["n"] for row in routed.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Blocks of reviews that make enough tasks, but not so many that the examples are copied without need.
    pairs = max(TASK_PAIRS, sum(n * sizes[unit] for unit, n in visits.items()) // 128)

    def blocks(unit: int) -> tuple[int, int]:
        c_blocks = -(-int(sizes[unit]) // c_rows)
        rows = max(1, min(q_rows, int(pairs * c_blocks // sizes[unit])))
        return c_blocks, max(1, -(-int(visits.get(unit, 0)) // rows))

    plan = spark.createDataFrame(
        [(cell, unit, *blocks(unit)) for cell, unit in unit_of.items()], "cell int, unit int, c_blocks int, q_blocks int"
    )  # one row per pivot
    by_unit = plan.drop("cell").distinct()

    def part_of(key: str, blocks: str):
        return F.pmod(F.xxhash64(key), F.col(blocks)).cast("int")

    def each(blocks: str):
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    left = (
        routed.join(F.broadcast(by_unit), "unit").withColumn("q_block", part_of("review_id", "q_blocks"))
        .withColumn("c_block", each("c_blocks")).drop("c_blocks", "q_blocks")
    )
    right = (
        placed.drop("radius").join(F.broadcast(plan), "cell").drop("cell")
        .withColumn("c_block", part_of("neighbor_id", "c_blocks"))
        .withColumn("q_block", each("q_blocks")).drop("c_blocks", "q_blocks")
    )

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"review_id": [], "neighbor_id": [], "category": c["category"][:0], "distance": [], "neighbor_rank": []})
        examples = _prepare(c["neighbor_id"].to_numpy(), _rows(c["embedding"]), c["category"].to_numpy(), k)
        return _result(q["review_id"].to_numpy(), _rows(q["embedding"]), examples, k, skip_self)

    keys = ["unit", "c_block", "q_block"]
    nearest = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, _schema(label_type))
    # Each block gave its own k nearest; the k nearest of all are among them.
    rank = F.row_number().over(Window.partitionBy("review_id").orderBy("distance", "neighbor_id"))
    return nearest.withColumn("neighbor_rank", rank).filter(F.col("neighbor_rank") <= k)


def knn_votes(neighbors: DataFrame, sizes: list[int]) -> DataFrame:
    """One vote per review and neighbourhood size: the most frequent category.

    Ties go to the category met nearest. ``confidence`` is the winner's share
    and ``agent_id`` numbers the sizes from 0. ``neighbors`` has to reach as
    far as the largest size.
    """
    agents = F.array(*[
        F.struct(F.lit(i).alias("agent_id"), F.lit(size).alias("k")) for i, size in enumerate(sizes)
    ])
    # A review has a handful of neighbours, so no review makes a large partition;
    # placed by review, both aggregations and later joins on it stay in place.
    counted = (
        neighbors.select("review_id", "category", "neighbor_rank").repartition("review_id")
        .withColumn("agent", F.explode(agents))
        .filter(F.col("neighbor_rank") <= F.col("agent.k"))
        .groupBy("review_id", F.col("agent.agent_id").alias("agent_id"), "category")
        .agg(F.count(F.lit(1)).alias("n"), F.min("neighbor_rank").alias("nearest"))
    )
    best = F.max(F.struct("n", (-F.col("nearest")).alias("near"), "category")).alias("best")
    return counted.groupBy("review_id", "agent_id").agg(best, F.sum("n").alias("k")).select(
        "review_id", "agent_id",
        F.col("best.category").alias("category"),
        (F.col("best.n") / F.col("k")).alias("confidence"),
    )


def knn_vote_label(neighbors: DataFrame, k: int = 3) -> DataFrame:
    """The category most of the ``k`` neighbours have."""
    return knn_votes(neighbors, [k]).select("review_id", "category", "confidence")
