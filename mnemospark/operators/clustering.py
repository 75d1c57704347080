"""Density clustering, centroids, topic summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from . import vectors as V
from .neighbours import neighbours

#: Ids in a range that one task numbers.
RANGE = 1 << 20


def optimal_eps(df: DataFrame, dim: int, k: int = 5) -> DataFrame:
    """(eps): the mean Euclidean distance of all rows to their k nearest others."""
    return neighbours(df, dim, k, metric="l2").agg(F.avg(F.sqrt("score")).alias("eps"))


def dbscan(df: DataFrame, dim: int, eps: float, min_samples: int) -> DataFrame:
    """(id, label): clusters by density, numbered by their smallest core id from 0; -1 is noise.

    A core has ``min_samples`` rows (itself counted) within eps; cores within eps are one
    cluster; other rows join the cluster of their smallest core.  Labels spread to
    minima over rounds, each written, with their roots followed between rounds.
    """
    pairs = written(neighbours(df, dim, radius=eps * eps, metric="l2").select("src", "dst"))
    cores = written(pairs.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= min_samples).select(F.col("src").alias("id"))) if min_samples > 1 else df.select("id")
    inner = written(pairs.join(cores.select(F.col("id").alias("src")), "src").join(cores.select(F.col("id").alias("dst")), "dst"))
    root = written(cores.select("id", F.col("id").alias("root")))
    while True:
        near = inner.join(root.select(F.col("id").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("root").alias("near"))
        step = root.join(near, "id", "left").select("id", F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = step.alias("a").join(step.select(F.col("id").alias("r"), F.col("root").alias("up")), F.col("a.root") == F.col("r")).select("id", F.col("up").alias("root"))
        new = written(jump)
        if not new.join(root.select("id", F.col("root").alias("old")), "id").where("root <> old").limit(1).count():
            break
        root = new
    # ranks within ranges of roots, shifted by the ranges' sizes: no one task sorts all clusters
    roots = written(root.select("root").distinct().withColumn("part", F.floor(F.col("root") / RANGE)))
    sizes = roots.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("root"))
    numbers = roots.withColumn("rank", rank).join(before, "part").select("root", (F.col("before") + F.col("rank") - 1).alias("label"))
    border = pairs.join(root.select(F.col("id").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("core"))
    of = root.join(numbers, "root").select("id", "label")
    edge = border.join(of.select("id"), "id", "left_anti").join(of.select(F.col("id").alias("core"), "label"), "core").select("id", "label")
    found = of.union(edge)
    return df.select("id").join(found, "id", "left").select("id", F.coalesce("label", F.lit(-1)).cast("int").alias("label"))


def merge_tiny(df: DataFrame, dim: int, least: int = 6, block: int = 4096) -> DataFrame:
    """(id, label): clusters under ``least`` rows join the large one whose centroid is nearest by cosine (to nine places; of equals the least label); without a large one all is noise.

    Centroids meet in blocks of about ``block`` small and large ones, one task each, which keep the best of every small one.
    """
    mean = F.array(*[F.avg(F.get("vector", F.lit(i)).cast("double")) for i in range(dim)])
    cents = written(df.where(F.col("label") != -1).groupBy("label").agg(F.count("*").alias("n"), mean.alias("c")))
    big, tiny = cents.where(F.col("n") >= least), cents.where(F.col("n") < least)
    many, few = big.count(), tiny.count()
    if not many:
        return df.select("id", F.lit(-1).alias("label"))
    kind = dict(df.dtypes)["label"]

    def nearest(t: pa.Table) -> pa.Table:
        side = t.column("small").to_numpy(zero_copy_only=False)
        m, label = V._matrix(t.column("c"), dim), t.column("label").to_numpy()
        unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        order = np.argsort(label[~side], kind="stable")
        s = np.round(unit[side] @ unit[~side][order].T, 9)
        at = s.argmax(axis=1) if s.size else np.zeros(0, int)  # the first of equals: labels come in order
        return pa.table({"label": label[side][: len(at)], "to": label[~side][order][at], "score": s[np.arange(len(at)), at] if s.size else np.zeros(0)})

    place = lambda n: F.pmod(F.xxhash64("label"), F.lit(max(1, -(-n // block)))).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // block)) - 1)))
    both = tiny.select(place(few).alias("i"), each(many).alias("j"), F.lit(True).alias("small"), "label", "c").union(big.select(each(few).alias("i"), place(many).alias("j"), F.lit(False).alias("small"), "label", "c"))
    met = both.groupBy("i", "j").applyInArrow(nearest, f"label {kind}, to {kind}, score double")
    to = met.groupBy("label").agg(F.max_by("to", F.struct("score", -F.col("to"))).alias("to"))
    return df.select("id", "label").join(to, "label", "left").select("id", F.coalesce("to", "label").alias("label"))


def cluster_memories(df: DataFrame, dim: int, min_cluster: int = 6) -> DataFrame:
    """(id, label): denoised vectors by density, small clusters merged; under five rows all is noise."""
    n = df.count()
    if n < 5:
        return df.select("id", F.lit(-1).alias("label"))
    clean = written(V.denoise(df, dim, out=min(50, dim)))
    size = min(50, dim - 3) if dim > 3 else dim
    least = max(2, min(8, n // 20))
    eps = optimal_eps(clean, size, least).first().eps
    labels = written(dbscan(clean, size, eps, least))
    return merge_tiny(clean.join(labels, "id"), size, min_cluster)


def topic_summaries(df: DataFrame, prompt: str = "life summary", width: int = 200) -> DataFrame:
    """(topic, n, summary): the beginning of each topic's texts, in order of id.

    Only as many texts as the summary shows are gathered: the first rows of a topic whose texts reach the width.
    """
    parts = df.select(F.col("source_file").alias("topic"), "id", F.substring("text", 1, width + 1).alias("t"))
    few = parts.withColumn("salt", F.pmod(F.col("id"), F.lit(16)))
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("topic", "salt").orderBy("id"))).where(F.col("r") <= width)
    w = Window.partitionBy("topic").orderBy("id")
    before = F.coalesce(F.sum(F.length("t") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shown = few.withColumn("before", before).where(F.col("before") <= width)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "t"))), lambda x: x["t"]), " ")
    heads = shown.groupBy("topic").agg(F.concat(F.lit(f"Summary based on prompt '{prompt}': "), F.substring(text, 1, width), F.lit("...")).alias("summary"))
    return df.groupBy(F.col("source_file").alias("topic")).agg(F.count("*").alias("n")).join(heads, "topic")


def domain_clusters(df: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """(topic, domain): topics by TF-IDF of their summaries' words, in k groups."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StopWordsRemover

    rows = RegexTokenizer(inputCol="summary", outputCol="w", pattern=r"\W+").transform(topic_summaries(df))
    rows = HashingTF(inputCol="k", outputCol="tf", numFeatures=4096).transform(StopWordsRemover(inputCol="w", outputCol="k").transform(rows))
    rows = IDF(inputCol="tf", outputCol="x").fit(rows).transform(rows)
    return KMeans(featuresCol="x", predictionCol="domain", k=k, seed=seed).fit(rows).transform(rows).select("topic", "domain")
