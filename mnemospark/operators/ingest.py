"""Incremental ingestion: manifests, crawls with counters, session logs as a stream into a table of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..sources.tables import EXCLUDED, wanted_path
from ..sources.versions import Table
from . import chunking as C

FILES = "path string, modificationTime timestamp, length long, content binary"


def manifest_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status): new, changed, unchanged or deleted, by sha256."""
    old, new = before.select("path", F.col("sha256").alias("old")), now.select("path", F.col("sha256").alias("new"))
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return old.join(new, "path", "full").select("path", status.alias("status"))


def apply_manifest(store: DataFrame, diff: DataFrame, chunks: DataFrame, prune_missing: bool = True) -> DataFrame:
    """(path, content_hash, chunk): the store without chunks of changed (and deleted) files, and with the new chunks.

    A content that another file still has stays: rows are owned by path and content.
    """
    gone = diff.where(F.col("status").isin("changed", *(["deleted"] if prune_missing else []))).select("path")
    fresh = chunks.join(diff.where(F.col("status").isin("new", "changed")).select("path"), "path", "left_semi")
    fresh = fresh.select("path", F.sha2("chunk", 256).alias("content_hash"), "chunk").dropDuplicates(["path", "content_hash"])
    return store.join(gone, "path", "left_anti").unionByName(fresh)


def chunks_by_type(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("n"))


def _reason(piece: Column, word: str = C.WORD) -> Column:
    """Why a piece is of no use, or null."""
    return F.when(F.length(piece) < 10, "short").when(piece.startswith("```"), "code").when(C.marks_only(piece, word), "marks").when(T.has_tags(piece), "tags")


def crawl(files: DataFrame, threshold: float = 0.5, most: int = 500, word: str = C.WORD) -> tuple[DataFrame, Observation]:
    """(path, chunk_index, total_chunks, modified, chunk) of files (path, text, modified), and counters that are there once the rows have been computed.

    Chunks are those of chunking.crawl_chunks that are reliable; their index and total count the unreliable ones too.  The counters come
    with the rows, in one pass: files, chunks, and pieces rejected as short, code, marks, tags or unreliable.  Files
    without text count as files.
    """
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), T.like_python(C.PARAGRAPH)), T.stripped), lambda p: p != "")
    sentences = lambda p: F.filter(F.transform(F.split(p, T.like_python(C.SENTENCE)), T.stripped), lambda x: x != "")
    long = lambda p: C.useful(p, word) & (F.length(p) > most)
    rows = files.select("path", "modified", F.flatten(F.transform(parts, lambda p: F.when(long(p), sentences(p)).otherwise(F.array(p)))).alias("pieces"))
    rows = rows.select("path", "modified", F.transform("pieces", lambda p: F.struct(p.alias("chunk"), _reason(p, word).alias("reason"))).alias("pieces"))
    kept = F.transform(F.filter("pieces", lambda p: p["reason"].isNull()), lambda p: p["chunk"])
    count = lambda why: F.size(F.filter("pieces", lambda p: p["reason"] == why)).cast("long").alias(why)
    reasons = ("short", "code", "marks", "tags")
    rows = rows.select("path", "modified", kept.alias("kept"), *[count(r) for r in reasons])
    rows = rows.select("path", "modified", F.size("kept").alias("total_chunks"), *reasons, F.posexplode_outer("kept").alias("chunk_index", "chunk"))
    bad = F.coalesce(T.verdict(F.col("chunk"))["confidence"] >= threshold, F.lit(False))
    rows = rows.withColumns({"bad": bad, "first": F.coalesce(F.col("chunk_index") == 0, F.lit(True))})
    seen = Observation()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    rows = rows.observe(seen, total(F.col("first").cast("long")).alias("files"), total((F.col("chunk").isNotNull() & ~F.col("bad")).cast("long")).alias("chunks"), *[total(F.when(F.col("first"), F.col(r))).alias(r) for r in reasons], total(F.col("bad").cast("long")).alias("unreliable"))
    return rows.where(F.col("chunk").isNotNull() & ~F.col("bad")).select("path", "chunk_index", "total_chunks", "modified", "chunk"), seen


def stored_chunks(files: DataFrame) -> DataFrame:
    """session_chunks() as rows of a store: each content once, of the first of its files."""
    rows = C.session_chunks(files)
    first = rows.groupBy("content_hash").agg(F.min(F.struct("path", "chunk_index", "chunk_type", "text", "speakers", "turn_count", "timestamp")).alias("r"), F.min_by("session", F.struct("path", "chunk_index")).alias("session"))
    return first.select("content_hash", "r.*", F.to_json("session").alias("session"))


def create_store(spark: SparkSession, folder: str, buckets: int = 64) -> Table:
    """An empty store of chunks by their content."""
    kind = "content_hash string, path string, chunk_index int, chunk_type string, text string, speakers string, turn_count long, timestamp double, session string"
    return Table.create(spark.createDataFrame([], kind), folder, "content_hash", buckets)


def file_stream(spark: SparkSession, root: str, per_batch: int | None = None, excluded=EXCLUDED) -> DataFrame:
    """(path, text, modified): .md files below a folder as they appear; bytes that are no UTF-8 are replaced."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
    rows = (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(root)
    text = F.decode(F.try_validate_utf8(F.decode("content", "UTF-8")).cast("binary"), "UTF-8")
    return rows.where(wanted_path(F.col("path"), excluded)).select("path", text.alias("text"), F.unix_timestamp("modificationTime").cast("double").alias("modified"))


def ingest_sessions(stream: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Session logs and notes of a file stream into the store in ``folder``: chunks by their content, so a batch that is run again adds nothing."""
    spark = stream.sparkSession

    def add(batch: DataFrame, _: int) -> None:
        Table.open(spark, folder).insert_ignore(stored_chunks(batch))

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
