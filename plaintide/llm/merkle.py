"""A Merkle manifest that grows by appends, with a witness for every leaf.

The nodes of a tree are cut in *runs* of 16 consecutive siblings; a run is what
a witness consists of: the digests beside a node on the way to the root. Runs
are kept once for all leaves below them, in one table for each append and
level, and a leaf's witness is the chain of runs above it.

``append`` hashes a batch of leaves in runs. A run that is full is closed: its
digest is appended to the level above like a leaf to the lowest one, and so on
up. A run that is not full stays open and is the partial witness of what is
below it; the siblings that a later append brings extend it. Of each tree at
most 15 nodes a level are open, and no closed run is ever read or written again
by an append. ``seal`` closes the open edge as the manifest's rule says, and
``witnesses`` goes down from the roots and gives every leaf its steps.

All of it is grouping and joins: a tree with a third of all leaves is hashed in
as many tasks as any other, because the work is cut by run, not by tree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import with_position
from ..session import new_path
from .common import saved

FAN = 16
#: Leaves that are ranked in one task.
ROWS_PER_BLOCK = 1 << 13


def hashed(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    """Digest of a row: each value as its length in bytes, a colon and itself, or ``-`` if it is null."""
    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return hashed(*map(field, values))


def _run_digest(members: Column) -> Column:
    return F.sha2(F.concat_ws("", members["digest"]), 256)


def _runs_of(nodes: DataFrame) -> DataFrame:
    """``nodes`` (``key, place, digest, info``) as ``key, run, members``; a run has at most 16."""
    return nodes.groupBy("key", F.expr(f"place div {FAN}").alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("place", "digest", "info"))).alias("members"))


def _tables(spark: SparkSession, path: str, appends: int) -> DataFrame | None:
    """``key, run, members, append, level`` of the first ``appends`` appends."""
    if not appends:
        return None
    return spark.read.option("basePath", f"{path}/runs").parquet(*[f"{path}/runs/append={i}" for i in range(appends)])


def _open(runs: DataFrame, appends: int) -> DataFrame:
    """The nodes in open runs: every append writes all of them anew, so the last one has them."""
    last = runs.where((F.col("append") == appends - 1) & (F.size("members") < FAN))
    return last.select("key", "level", F.explode("members").alias("m")).select("key", "level", "m.*")


def append(spark: SparkSession, path: str, batch: int, leaves: DataFrame, order: Sequence[str]) -> int:
    """Appends ``leaves`` to the manifest at ``path`` as batch number ``batch``; gives the number of appends in it.

    ``leaves`` has ``key`` (the tree, not null), ``digest``, ``info`` (any
    type, comes back with the witness) and the columns of ``order``, by which
    they are placed after the leaves that the tree has already. Batches count
    from 0. A batch that failed, or is sent again by a stream, is written over
    with the same content; nothing else is changed.
    """
    before = _tables(spark, path, batch)
    edge = None if before is None else _open(before, batch)
    placed = with_position(leaves, order, "_rank", group=["key"], rows_per_block=ROWS_PER_BLOCK)
    if edge is None:
        top, nodes = -1, placed.withColumn("place", F.col("_rank"))
    else:
        # A node that is open at level l stands for 16 ** l leaves, so the open edge spells the number of leaves.
        sizes = edge.groupBy("key").agg(F.sum(F.expr("shiftleft(1L, 4 * level)")).alias("_size"))
        top = edge.agg(F.max("level")).first()[0]
        top = -1 if top is None else top
        nodes = placed.join(sizes, "key", "left").withColumn("place", F.col("_rank") + F.coalesce("_size", F.lit(0)))
    nodes = nodes.select("key", "place", "digest", "info")
    level = 0
    while True:
        if edge is not None:
            nodes = nodes.unionByName(edge.where(F.col("level") == level).drop("level"))
        target = f"{path}/runs/append={batch}/level={level}"
        _runs_of(nodes).write.mode("overwrite").parquet(target)
        runs = spark.read.parquet(target)
        full = runs.where(F.size("members") == FAN)
        # The root of a block is a further append, one level up.
        nodes = full.select("key", F.col("run").alias("place"), _run_digest(F.col("members")).alias("digest"),
                            F.lit(None).cast(leaves.schema["info"].dataType).alias("info"))
        level += 1
        if level > top and full.isEmpty():
            return batch + 1


def appender(path: str, order: Sequence[str], leaves: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """What ``writeStream.foreachBatch`` needs to append every micro-batch of rows to the manifest at ``path``."""
    def run(rows: DataFrame, batch: int) -> None:
        # Written once: placing reads a batch several times.
        append(rows.sparkSession, path, batch, saved(leaves(rows), "leaves"), order)

    return run


def seal(spark: SparkSession, path: str, appends: int) -> tuple[DataFrame, DataFrame, int]:
    """All runs (``key, level, run, members``), the root of each tree (``key, level, digest, info``) and the number of levels.

    While a level of a tree has more than one node, the nodes that are left over
    at its end make a run too, even a single one. Nothing at ``path`` changes:
    later appends go on from the open edge.
    """
    tables = _tables(spark, path, appends)
    closed = tables.where(F.size("members") == FAN).select("key", "level", "run", "members")
    edge = _open(tables, appends)
    edge = saved(edge, "edge")
    sizes = edge.groupBy("key").agg(F.sum(F.expr("shiftleft(1L, 4 * level)")).alias("n"))
    most, levels = sizes.agg(F.max("n")).first()[0] or 0, 0
    while most > 1:
        most, levels = -(-most // FAN), levels + 1
    carried, runs, roots = None, [closed], []
    for level in range(levels + 1):
        nodes = edge.where(F.col("level") == level).drop("level")
        nodes = nodes if carried is None else nodes.unionByName(carried)
        # The last run of the level, and whether the level has nothing else.
        last = _runs_of(nodes).withColumn("single", F.element_at("members", -1)["place"] == 0)
        roots.append(last.where("single").select("key", F.lit(level).alias("level"), F.col("members")[0]["digest"].alias("digest"),
                                                 F.col("members")[0]["info"].alias("info")))
        rest = last.where("not single")
        runs.append(rest.select("key", F.lit(level).alias("level"), "run", "members"))
        carried = rest.select("key", F.col("run").alias("place"), _run_digest(F.col("members")).alias("digest"),
                              F.lit(None).cast(edge.schema["info"].dataType).alias("info"))
    union = lambda tables: saved(_union(tables), "sealed")
    return closed.unionByName(union(runs[1:])) if levels else closed, union(roots), levels


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other)
    return out


def witnesses(runs: DataFrame, roots: DataFrame, levels: int) -> DataFrame:
    """``key, place, digest, info, steps, root`` of every leaf.

    ``steps`` are the digests left and right of the node, from the leaf up.
    ``roots`` may have ``steps`` of its own, which lead on from the roots; they
    come last.
    """
    if "steps" not in roots.columns:
        roots = roots.withColumn("steps", F.array().cast("array<struct<left:string,right:string>>"))
    above = None
    for level in range(levels, -1, -1):
        tops = roots.where(F.col("level") == level).select(
            "key", F.lit(0).cast("bigint").alias("place"), "digest", "info", "steps", F.col("digest").alias("root"))
        if above is not None:
            digests = F.col("members")["digest"]
            side = lambda start, size: F.concat_ws("", F.slice(digests, start, size))
            step = F.struct(side(F.lit(1), F.col("i")).alias("left"), side(F.col("i") + 2, F.lit(FAN)).alias("right"))
            parents = above.select("key", F.col("place").alias("run"), F.col("steps").alias("up"), "root")
            below = runs.where(F.col("level") == level).join(parents, ["key", "run"])
            nodes = below.select("key", "members", "up", "root", F.posexplode("members").alias("i", "m")).select(
                "key", "m.place", "m.digest", "m.info", F.concat(F.array(step), "up").alias("steps"), "root")
            tops = nodes.unionByName(tops)
        above = tops
    return above


def proof(steps: Column) -> Column:
    """Digest of all siblings of a witness, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.flatten(F.transform(steps, lambda s: F.array(s["left"], s["right"])))), 256)


def folded(digest: Column, steps: Column) -> Column:
    """The root that a leaf with this digest leads to."""
    return F.aggregate(steps, digest, lambda below, s: hashed(s["left"], below, s["right"]))


def manifest(
    docs: DataFrame,
    changed: Column,
    group: str = "source",
    id_col: str = "doc_id",
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
) -> DataFrame:
    """Leaf, roots, digest of the witness and check of every row of ``docs``.

    Rows are leaves, by id, of the tree of their ``group``; the roots of these,
    ordered by group (null first, then by bytes), are the leaves of one more
    tree. ``changed`` is the text that a row is checked with: ``folded_root`` is
    what its digest and the witness of the original lead to.

    Rows with a null id come first; rows with equal ids are ordered by digest,
    and copies of a row get places, and so witnesses, of their own. Null and
    empty values have different digests. An empty table gives no rows. Only
    the columns named are read, others may have any name.
    """
    spark = docs.sparkSession
    given = {name: F.col(f"d.{name}") for name in columns}
    edited = given | {"text": changed}
    rows = docs.select(*dict.fromkeys([*columns, group, id_col])).alias("d")
    leaves = saved(rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"d.{group}").cast("string")), F.lit("")).alias("key"),
        F.col(f"d.{id_col}").alias("id"), leaf(*given.values()).alias("digest"),
        F.when(~changed.eqNullSafe(F.col("d.text")), leaf(*edited.values())).alias("edited"),
        F.monotonically_increasing_id().alias("row")), "leaves")
    path = new_path(spark, "manifest")
    count = append(spark, path, 0, leaves.withColumn("info", F.struct("id", "edited")), ["id", "digest", "row"])
    runs, roots, levels = seal(spark, path, count)
    # The trees' roots, again appended and sealed, lead on to the one root.
    top = new_path(spark, "manifest")
    ends = roots.select(F.lit("").alias("key"), F.col("key").alias("info"), "digest")
    count = append(spark, top, 0, ends, ["info"])
    upper, root, upper_levels = seal(spark, top, count)
    last = root.first()
    on = witnesses(upper, root, upper_levels).select(F.col("info").alias("key"), "steps")
    found = witnesses(runs, roots.join(on, "key"), levels)
    back = folded(F.coalesce("info.edited", "digest"), F.col("steps"))
    return found.select(
        F.col("info.id").alias(id_col), F.col("digest").alias("leaf"), F.col("root").alias("subroot"),
        F.lit(last.digest if last else None).cast("string").alias("root"), proof(F.col("steps")).alias("proof_sha256"),
        back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
