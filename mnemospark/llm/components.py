"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._exchange import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the least node next to it: the greater neighbours (large), or the lesser ones and itself.

    The least neighbour is a minimum, which is combined before the shuffle, and is
    joined back, so no node's neighbours are gathered in one place.
    """
    if large:
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        both = edges  # src > dst in every edge
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    joined = both.join(least, "src")
    if large:
        return joined.where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()
    moved = joined.select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(least.select("src", F.col("m").alias("dst")))
    return moved.where("src <> dst").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each node that has an edge, with the least node that it is linked to.

    Edges are undirected; loops, nulls and repeats do no harm.  Rounds are as the
    logarithm of the longest chain; each is written to the shared folder.
    """
    x, y = F.col(a), F.col(b)
    now = written(edges.where(x != y).select(F.greatest(x, y).alias("src"), F.least(x, y).alias("dst")).distinct())
    sign = None
    while True:
        now = written(_star(_star(now, True), False))
        # both steps keep the set when every node hangs on its component's least node, and only then
        row = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if tuple(row) == sign:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
        sign = tuple(row)
