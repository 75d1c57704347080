"""Retrieval measures over ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def measures(results: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """(qid, retrieved, hits, precision, recall, average_precision, ndcg) for each query of ``results`` (qid, id, rank) against ``expected`` (qid, id)."""
    top = results.where(F.col("rank") <= k)
    good = top.join(expected.select("qid", "id").distinct().withColumn("hit", F.lit(1)), ["qid", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    want = expected.groupBy("qid").agg(F.countDistinct("id").alias("wanted"))
    lists = good.groupBy("qid").agg(F.count("*").alias("retrieved"), F.sum("hit").alias("hits"), F.array_sort(F.collect_list(F.struct("rank", "hit"))).alias("l")).join(want, "qid", "left")
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("ap"), F.lit(0.0).alias("dcg"))
    fold = F.aggregate("l", start, lambda s, x: F.struct((s["n"] + x["hit"]).alias("n"), (s["ap"] + x["hit"] * (s["n"] + x["hit"]) / x["rank"]).alias("ap"), (s["dcg"] + x["hit"] / F.log2(x["rank"] + 1.0)).alias("dcg")))
    wanted = F.coalesce("wanted", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(wanted, F.lit(k)).cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    some = F.greatest(wanted, F.lit(1))
    return lists.withColumn("f", fold).select("qid", "retrieved", "hits", (F.col("hits") / F.col("retrieved")).alias("precision"), (F.col("hits") / some).alias("recall"), (F.col("f.ap") / F.least(some, F.lit(k))).alias("average_precision"), (F.col("f.dcg") / ideal).alias("ndcg"))


def telemetry(stats: DataFrame, as_of: float) -> DataFrame:
    """(timestamp, stats): a snapshot of a one-row table as JSON, to append to a log."""
    return stats.select(F.lit(float(as_of)).alias("timestamp"), F.to_json(F.struct(*stats.columns)).alias("stats"))
