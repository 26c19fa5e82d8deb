"""Connected components of a table of links, by Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _contracted(links: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` (``v`` is smaller) with the same components: each ``a`` and its ``b`` go to the smallest ``b``.

    A node with several ``b`` keeps one link, and what its ``b`` have to do with
    each other is said once for all nodes that have the same ones.
    """
    near = links.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("near"))
    first = F.get("near", F.lit(0))
    pairs = near.select(F.explode(F.concat(F.array(F.struct(F.col("a").alias("x"), first.alias("y"))),
                                           F.transform(F.slice("near", 2, F.size("near")), lambda b: F.struct(b.alias("x"), first.alias("y"))))).alias("p"))
    return pairs.select(F.greatest("p.x", "p.y").alias("u"), F.least("p.x", "p.y").alias("v")).where("u <> v").distinct()


def _is_done(edges: DataFrame) -> bool:
    """Whether each node is either the smaller end of its links or the larger end of one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")) \
        .union(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    # Counted before the shuffle: a node with very many links is one row a task.
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b", *, few: bool = True) -> DataFrame:
    """``node`` and ``component`` (the smallest node it is linked with) of every node in ``links``.

    Each round links every node and its neighbours to the smallest of them
    ("small star" and "large star" of Kiveris et al. 2014), so the number of
    rounds grows with the logarithm of the longest chain; it ends when the links
    are stars around the smallest nodes. Rounds go through tables in the shared
    folder. Null ends are left out; loops and repeated links change nothing. With
    ``few``, the ``b`` of one ``a`` are held in one row, so a node with very many
    links should be ``b`` in most of them; without, nodes may have any number.
    """
    known = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = saved(_contracted(known) if few else known.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _is_done(edges):
        # Large star: larger neighbours of u go to the smallest node around u.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v") \
            .union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = saved(small, "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
