"""Concept graph, neighbour graph, traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import written
from . import vectors as V
from .neighbours import neighbours


def concepts(df: DataFrame) -> DataFrame:
    """(concept_id, name): distinct words of four or more letters, numbered -1, -2, ... in order.

    Ranks are found within ranges of names and shifted by the ranges' sizes, so no one task sorts all names.
    """
    names = df.select(F.explode(T.concept_tokens(F.col("text"))).alias("name")).distinct()
    part = F.substring("name", 1, 2)
    sizes = names.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("name"))
    return names.withColumn("part", part).join(before, "part").select((-(F.col("before") + rank)).alias("concept_id"), "name")


def concept_edges(df: DataFrame) -> DataFrame:
    """(src, dst, type): from each memory to the concepts that it contains, and from concepts to their instances."""
    has = df.select("id", F.explode(T.concept_tokens(F.col("text"))).alias("name")).join(concepts(df), "name")
    out = has.select(F.col("id").alias("src"), F.col("concept_id").alias("dst"), F.lit("contains").alias("type"))
    back = has.select(F.col("concept_id").alias("src"), F.col("id").alias("dst"), F.lit("instance").alias("type"))
    return out.union(back)


def link_neighbors(df: DataFrame, dim: int, k: int = 8, time_weight: float = 0.15, source_bonus: float = 0.05, least: float = 0.4, sigma: float = 43200.0, denoised: bool = True) -> DataFrame:
    """(src, dst, weight): each row's 2k nearest candidates whose weight, cosine blended with nearness in time and a bonus for one source, is over ``least``, before it is rounded to three places.

    Candidates are those of denoised vectors among rows that are not merged; with ``denoised`` false, of all rows as they are.
    """
    near = df
    if denoised:
        active = ~F.coalesce("merged", F.lit(False)) if "merged" in df.columns else F.lit(True)
        df = df.where(active & (F.size("vector") == dim))
        out = max(1, min(256, df.count() - 1, dim - 3))
        near, dim = V.denoise(df, dim, 3, out), out
    pairs = neighbours(near, dim, 2 * k).select("src", "dst", "score")
    side = lambda p: df.select(F.col("id").alias(f"{p}"), F.col("timestamp").alias(f"{p}_ts"), F.col("source_file").alias(f"{p}_file"))
    rows = pairs.join(side("src"), "src").join(side("dst"), "dst")
    dt = F.col("src_ts") - F.col("dst_ts")
    near = F.exp(-dt * dt / (2 * sigma * sigma))
    bonus = F.when((F.col("src_file") == F.col("dst_file")) & (F.col("src_file") != ""), source_bonus).otherwise(0.0)
    weight = (1 - time_weight) * F.greatest(F.lit(0.0), "score") + time_weight * near + bonus
    return rows.select("src", "dst", weight.alias("weight")).where(F.col("weight") > least).withColumn("weight", F.round("weight", 3))


def _next(edges: DataFrame, front: DataFrame, seen: DataFrame, depth: int) -> DataFrame:
    """(id, depth): nodes that the front has edges to and that were not seen; written, so that no level computes another again."""
    met = edges.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return written(met.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth")))


def reached(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, depth): nodes within ``depth`` steps of those of ``start`` (id), which have depth 0, with the fewest steps."""
    seen = front = written(start.select("id", F.lit(0).alias("depth")))
    for d in range(1, depth + 1):
        front = _next(edges, front, seen, d)
        if not front.limit(1).count():
            break
        seen = seen.union(front)
    return seen


def reach(edges: DataFrame, start: int, depth: int) -> DataFrame:
    """(id, depth): nodes within ``depth`` steps of ``start``, itself left out, with the fewest steps."""
    own = edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("id"))
    return reached(edges, own, depth).where(F.col("id") != start)


def path(edges: DataFrame, start: int, goal: int, hops: int = 3) -> DataFrame:
    """(path): a shortest path of at most ``hops`` edges, the smallest of several, as ids joined by ``>``; no row without one.

    Levels grow from both ends, the smaller side first, each written, until they meet; then
    only nodes between the ends are kept, level by level, and the path takes the least of them at each step.
    """
    spark, edge = edges.sparkSession, edges.select("src", "dst")
    back = edge.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    one = lambda i: written(spark.range(1).select(F.lit(i).cast("long").alias("id"), F.lit(0).alias("depth")))
    sides = [(edge, [one(start)], [1]), (back, [one(goal)], [1])]
    meeting = sides[0][1][-1].join(sides[1][1][-1].select("id"), "id", "left_semi")
    while not meeting.limit(1).count():
        if sum(len(levels) - 1 for _, levels, _ in sides) >= hops:
            return spark.createDataFrame([], "path string")
        along, levels, sizes = min(sides, key=lambda s: s[2][-1])
        seen = levels[0]
        for level in levels[1:]:
            seen = seen.union(level)
        levels.append(_next(along, levels[-1], seen, len(levels)))
        sizes.append(levels[-1].count())
        if not sizes[-1]:
            return spark.createDataFrame([], "path string")
        meeting = sides[0][1][-1].join(sides[1][1][-1].select("id"), "id", "left_semi")
    # nodes on a shortest path: of the first half those that lead to where the sides meet, of the second those that are led to
    forward, between = sides[0][1], [written(meeting.select("id"))]
    for level in reversed(forward[:-1]):
        leads = edge.join(between[0].select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
        between.insert(0, written(level.select("id").join(leads, "id", "left_semi")))
    for level in reversed(sides[1][1][:-1]):
        led = edge.join(between[-1].select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
        between.append(written(level.select("id").join(led, "id", "left_semi")))
    found = [start]
    for level in between[1:]:
        step = edge.where(F.col("src") == found[-1]).join(level.select(F.col("id").alias("dst")), "dst", "left_semi")
        found.append(step.agg(F.min("dst").alias("dst")).first()["dst"])
    return spark.createDataFrame([(">".join(map(str, found)),)], "path string")


def first_edges(edges: DataFrame, *key: str) -> DataFrame:
    """Rows whose key was not seen in an earlier row (by seq): inserts that ignore what is there.  A minimum by key, combined before the shuffle."""
    rest = [c for c in edges.columns if c not in key]
    return edges.groupBy(*key).agg(F.min(F.struct("seq", *[c for c in rest if c != "seq"])).alias("r")).select(*key, "r.*")


def is_concept(node: Column) -> Column:
    return node < 0
