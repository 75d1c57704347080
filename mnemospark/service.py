"""The operations of a memory service over an immutable table: each checks its request and returns a table or a new store."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .operators import kg, maintenance, retrieval, vectors
from .operators.postings import KeywordIndex
from .sources import tables, versions

MAX_BATCH, MAX_TOP_K, MAX_PAGE = 1000, 1000, 1000


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}, not {value}")


@dataclass(frozen=True)
class MemoryStore:
    """``memories`` (id, vector, text, timestamp, relevance, merged, importance_score, access_counter, label, source_file), and optionally triples and edges."""

    memories: DataFrame
    dim: int
    triples: DataFrame | None = None
    edges: DataFrame | None = None
    index: KeywordIndex | None = None

    def add(self, rows: DataFrame, limit: float = 0.05) -> tuple[MemoryStore, DataFrame]:
        """The store with the rows that pass (ids above all others), their vectors at unit length, and what adding each returned: an id, or -1."""
        _within("rows", rows.limit(MAX_BATCH + 1).count(), 0, MAX_BATCH)
        rows = rows.withColumn("vector", vectors.normalized(F.col("vector")).cast(dict(self.memories.dtypes)["vector"]))
        verdicts = maintenance.add_to(self.memories, rows, self.dim, limit)
        kept = rows.join(verdicts.where("result_id = id").select("id"), "id", "left_semi")
        index = self.index and self.index.insert(kept)
        return replace(self, memories=self.memories.unionByName(kept, allowMissingColumns=True), index=index), verdicts

    def indexed(self, folder: str) -> MemoryStore:
        """The store with a keyword index of its texts in ``folder``, which search() then reads in place of the texts, and add() and delete() keep."""
        return replace(self, index=KeywordIndex.create(self.memories, folder))

    def search(self, vector: list[float], terms: list[str], as_of: float, top_k: int = 10, alpha: float = 0.5, min_score: float = 0.0) -> DataFrame:
        _within("dimension", len(vector), self.dim, self.dim)
        _within("top_k", top_k, 1, MAX_TOP_K)
        _within("alpha", alpha, 0, 1)
        _within("min_score", min_score, 0, float("inf"))
        return retrieval.hybrid_search(self.memories, vector, terms, as_of, top_k, alpha, min_score, edges=self.edges, index=self.index)

    def search_kg(self, question: str, vector: list[float], terms: list[str], as_of: float, top_k: int = 10) -> tuple[DataFrame, DataFrame]:
        """Search results, and the question's context as lines."""
        if self.triples is None:
            raise ValueError("the store has no triples")
        asked = self.memories.sparkSession.createDataFrame([(0, question)], "qid int, text string")
        return self.search(vector, terms, as_of, top_k), kg.context_lines(kg.context(self.triples, asked))

    def delete(self, mem_id: int) -> MemoryStore:
        if not self.memories.where(F.col("id") == mem_id).limit(1).count():
            raise KeyError(mem_id)
        gone = self.memories.sparkSession.createDataFrame([(mem_id,)], "id long")
        return replace(self, memories=self.memories.where(F.col("id") != mem_id), index=self.index and self.index.delete(gone))

    def recall(self, vector: list[float], query: str, as_of: float, access: DataFrame, k: int = 10, **options) -> tuple[DataFrame, DataFrame]:
        """What is recalled, and the access log (mem_id, ts, query) with these accesses."""
        _within("dimension", len(vector), self.dim, self.dim)
        _within("k", k, 1, MAX_TOP_K)
        seen = access.groupBy("mem_id").agg(F.count("*").alias("n"))
        found = tables.written(retrieval.recall(self.memories, vector, as_of, seen, k, **options))
        return found, access.select("mem_id", "ts", "query").union(retrieval.recorded(found, query, as_of))

    def purge(self, dry_run: bool = True, threshold: float = 0.4) -> tuple[MemoryStore, DataFrame]:
        """The store without unreliable texts (with ``dry_run``, as it is), and the report of what goes."""
        _within("threshold", threshold, 0, 1)
        report = tables.written(maintenance.purge_report(self.memories, threshold))
        return self if dry_run else replace(self, memories=self.memories.join(report.select("id"), "id", "left_anti")), report

    def access_stats(self, log: DataFrame) -> DataFrame:
        return maintenance.access_stats(log)

    def kg_stats(self, most: int = 10) -> dict[str, DataFrame]:
        """Triples by subject type, by object type, and the most frequent predicates."""
        if self.triples is None:
            raise ValueError("the store has no triples")
        typed = kg.insert_ignore(self.triples) if "seq" in self.triples.columns else self.triples
        return {"subject_types": kg.counts(typed, "subject_type"), "object_types": kg.counts(typed, "object_type"), "predicates": kg.counts(typed, "predicate", most)}

    def health(self) -> dict[str, object]:
        return {"status": "ok", "memories": self.memories.count(), "dimension": self.dim, "triples": None if self.triples is None else self.triples.count()}

    def save(self, folder: str) -> str:
        """A snapshot of the store in a new folder below ``folder``; its name is committed last, so that open() never sees half of one."""
        spark, path = self.memories.sparkSession, f"{folder.rstrip('/')}/{time.time_ns()}"
        for name in ("memories", "triples", "edges"):
            if (table := getattr(self, name)) is not None:
                table.write.parquet(f"{path}/{name}")
        spark.createDataFrame([(path, self.dim)], "path string, dim int").coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/_snapshots")
        return path

    @staticmethod
    def open(spark: SparkSession, folder: str) -> MemoryStore:
        """The snapshot that was committed last."""
        last = spark.read.schema("path string, dim int").parquet(f"{folder.rstrip('/')}/_snapshots").orderBy(F.desc("path")).first()
        hadoop = spark._jvm.org.apache.hadoop.fs
        there = lambda name: hadoop.Path(f"{last.path}/{name}").getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop.Path(f"{last.path}/{name}"))
        table = lambda name: spark.read.parquet(f"{last.path}/{name}") if there(name) else None
        return MemoryStore(table("memories"), last.dim, table("triples"), table("edges"))

    def stats(self) -> DataFrame:
        return maintenance.stats(self.memories)

    def prune(self, as_of: float, max_age_days: float = 30.0, threshold: float = 0.3) -> MemoryStore:
        return replace(self, memories=maintenance.delete_ids(self.memories, maintenance.prune(self.memories, as_of, max_age_days, threshold)))

    def consolidate(self, min_size: int = 2) -> tuple[MemoryStore, DataFrame]:
        """The store with the members of large clusters marked as merged, and a summary for each such cluster."""
        groups = tables.written(maintenance.consolidate(self.memories, self.dim, min_size))
        return replace(self, memories=maintenance.mark_merged(self.memories, groups)), groups

    def update_relevance(self, mem_id: int, relevance: float) -> MemoryStore:
        if not self.memories.where(F.col("id") == mem_id).limit(1).count():
            raise KeyError(mem_id)
        return replace(self, memories=self.memories.withColumn("relevance", F.when(F.col("id") == mem_id, F.lit(float(relevance))).otherwise(F.col("relevance"))))

    def page(self, offset: int = 0, limit: int = 100) -> DataFrame:
        _within("offset", offset, 0, float("inf"))
        _within("limit", limit, 1, MAX_PAGE)
        return tables.page(self.memories, offset, limit)


@dataclass(frozen=True)
class ResultCache:
    """Results of searches in a folder, by what was asked and the version of the table that was searched, for ``ttl`` seconds.

    A commit makes a new version, under which nothing is cached yet; entries are written whole before they are named.
    """

    spark: SparkSession
    folder: str
    ttl: float = 300.0

    def get(self, asked: dict[str, object], version: int, search: Callable[[], DataFrame], now: float | None = None) -> tuple[DataFrame, bool]:
        """The rows of ``search()``, or those it gave before, and whether they were there: then nothing but they is read."""
        now = time.time() if now is None else now
        key = hashlib.sha256(json.dumps([asked, version], sort_keys=True, default=str).encode()).hexdigest()
        place = f"{self.folder.rstrip('/')}/{key}"
        for _, entry in reversed(versions.commits(self.spark, place)):
            if entry["made"] <= now < entry["made"] + self.ttl:
                return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(entry["path"]), True
            break
        path = f"{place}/{uuid.uuid4().hex}"
        rows = search()
        rows.coalesce(1).write.parquet(path)
        last = max((n for n, _ in versions.commits(self.spark, place)), default=-1)
        try:
            versions.commit(self.spark, place, {"made": now, "path": path, "schema": json.loads(rows.schema.json())}, last)
        except versions.Conflict:
            pass  # another has cached the same answer
        return self.spark.read.schema(rows.schema).parquet(path), False

    def clear(self) -> None:
        """Deletes all entries."""
        files, where = versions._folder(self.spark, self.folder)
        files.delete(where, True)
