"""Structured Streaming forms of the time-stateful operators; each matches its batch form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def session_counts(events: DataFrame, key: str, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """(key, start, end, n): sessions that end where nothing comes for ``gap``; rows later than ``late`` are left out by the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.session_window("ts", gap)
    return rows.groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def access_counts(events: DataFrame) -> DataFrame:
    """(mem_id, n, first, last): accesses so far, for update mode."""
    return events.groupBy("mem_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def distinct_content(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each content once within the watermark."""
    rows = events.withColumn("content_hash", F.sha2("text", 256))
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_hash"]) if rows.isStreaming else rows.dropDuplicates(["content_hash"])


def windowed_counts(events: DataFrame, key: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def upserts(stream: DataFrame, merge: Callable[[DataFrame], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run ``merge`` on each micro-batch, with its progress kept in ``checkpoint``; a repeated batch must do no harm."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: merge(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
