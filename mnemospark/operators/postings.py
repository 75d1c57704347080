"""Keyword search from a postings table, which reads a query's terms and no text.

A posting block holds, for one term and one block of documents, their ids, term frequencies and
lengths, and how high the frequency and how short the text may be at best.  Blocks are of
documents of about equal length, so those bounds are close.  A search reads the bounds of its
terms' blocks, scores the most promising blocks, and then only those that may still reach the
k best; rows and scores are those of ``retrieval.bm25``.

Writes follow a log: an insert adds a segment, a delete adds ids to leave out of older
segments, and each is one commit (``sources.versions``), so a reader keeps its version and
the last of two writers fails.
"""

from __future__ import annotations

import itertools
import math
import uuid
import zlib
from collections import Counter
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import Stems
from ..sources import versions

#: Documents of a block, folders of terms, blocks that are scored first, and lines of bounds that the driver takes.
BLOCK, BUCKETS, FIRST, NAMED = 1024, 64, 32, 2000
ROW_GROUP = 1 << 20
#: Postings that one task sorts, and writes as blocks.
SHARE = 1 << 20
COUNTS = "id long, len long, terms array<struct<term: string, tf: int>>"
POSTINGS = "term string, block long, n int, top int, least long, ids array<long>, tf array<int>, lens array<long>, bucket int"


def counted(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, len, terms array<(term, tf)>): how many search terms each text has, and how often each stem.  Runs on Arrow batches."""
    words, stems = T.term_finder(), Stems()

    def run(batches):
        for b in batches:
            lens, ends, names, tfs = [], [0], [], []
            for t in b.column(1).to_pylist():
                found = words(t)
                tf = Counter([stems[w] for w in found])
                names += tf.keys()
                tfs += tf.values()
                lens.append(len(found))
                ends.append(len(names))
            pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(tfs, pa.int32())], ["term", "tf"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lens, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["id", "len", "terms"])

    return df.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, COUNTS)


def _blocks(batches):
    """Posting blocks of rows (bucket, term, block, id, tf, len) that come sorted; the last block of a batch waits for the next one."""
    held = None
    for b in itertools.chain(batches, [None]):
        parts = [x for x in (held, b) if x is not None and x.num_rows]
        if not parts:
            continue
        t = pa.Table.from_batches(parts)
        term, block = (t.column(c).combine_chunks() for c in (1, 2))
        code, place = term.dictionary_encode().indices.to_numpy(), block.to_numpy()
        starts = np.concatenate([[0], np.flatnonzero((np.diff(code) != 0) | (np.diff(place) != 0)) + 1])
        whole = len(t) if b is None else starts[-1]
        held = None if b is None else t.slice(whole).combine_chunks().to_batches()[0]
        if not whole:
            continue
        starts = starts[starts < whole]
        ends = pa.array(np.append(starts, whole), pa.int32())
        ids, tf, lens = (t.column(c).combine_chunks().slice(0, whole) for c in (3, 4, 5))
        lists = [pa.ListArray.from_arrays(ends, c) for c in (ids, tf, lens)]
        at = pa.array(starts)
        top, least = np.maximum.reduceat(tf.to_numpy(), starts), np.minimum.reduceat(lens.to_numpy(), starts)
        yield pa.RecordBatch.from_arrays([term.take(at), block.take(at), pa.array(np.diff(np.append(starts, whole)), pa.int32()), pa.array(top, pa.int32()), pa.array(least), *lists, t.column(0).combine_chunks().take(at)], ["term", "block", "n", "top", "least", "ids", "tf", "lens", "bucket"])


def _bucket(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


@dataclass(frozen=True)
class KeywordIndex:
    """A version of an index: its segments, in the order in which they were added."""

    spark: SparkSession
    folder: str
    version: int
    content: dict

    @staticmethod
    def create(df: DataFrame, folder: str, id_col: str = "id", text_col: str = "text", block: int = BLOCK, buckets: int = BUCKETS) -> KeywordIndex:
        """An index of the rows' texts; ids must be distinct and not null (others raise), null texts have no terms but count as texts."""
        empty = KeywordIndex(df.sparkSession, folder.rstrip("/"), -1, {"segments": [], "deleted": [], "n": 0, "total": 0, "block": block, "buckets": buckets})
        return empty.insert(df, id_col, text_col)

    @staticmethod
    def open(spark: SparkSession, folder: str, version: int | None = None) -> KeywordIndex:
        found = [c for c in versions.commits(spark, folder) if version is None or c[0] == version]
        if not found:
            raise KeyError(folder)
        return KeywordIndex(spark, folder.rstrip("/"), *found[-1])

    def _next(self, **changes) -> KeywordIndex:
        content = self.content | changes
        return replace(self, version=versions.commit(self.spark, self.folder, content, self.version), content=content)

    def insert(self, df: DataFrame, id_col: str = "id", text_col: str = "text") -> KeywordIndex:
        """With the rows as a new segment; ids that the index has are replaced."""
        name = uuid.uuid4().hex
        counted(df, id_col, text_col).write.parquet(f"{self.folder}/segments/{name}/counts")
        return self._added(name)

    def _added(self, name: str) -> KeywordIndex:
        """With the segment whose counts are written."""
        c, path = self.content, f"{self.folder}/segments/{name}"
        rows = self.spark.read.schema(COUNTS).parquet(f"{path}/counts")
        n, ids, total, postings = rows.agg(F.count("*"), F.count_distinct("id"), F.coalesce(F.sum("len"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
        if n != ids:
            raise ValueError(f"{n - ids} rows have a null id or one that another row has")
        if not n:
            return self._next() if self.version < 0 else self
        # documents of about equal length share a block: classes of an eighth of an octave, cut to blocks by a hash of the id
        level = F.floor(8 * F.log2(F.col("len") + 1)).cast("long")
        sizes = {r["level"]: r["n"] for r in rows.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
        # levels of few documents join the one before; each level's block number, and over how many its documents are dealt
        held, at = 0, -1
        first, parts = {}, {}
        for k in sorted(sizes):
            at, held = (k, sizes[k]) if at < 0 or held >= c["block"] else (at, held + sizes[k])
            first[k], parts[at] = at, -(-held // c["block"])
        of = F.create_map(*[F.lit(x).cast("long") for k in first for x in (k, first[k])])
        wide = F.create_map(*[F.lit(x).cast("long") for k in first for x in (k, parts[first[k]])])
        each = rows.withColumn("block", F.element_at(of, level) * (1 << 32) + F.pmod(F.xxhash64("id"), F.element_at(wide, level)))
        each.select("id", "len", "block").write.parquet(f"{path}/docs")
        posts = each.select("id", "len", "block", F.explode("terms").alias("t"))
        posts = posts.select(F.pmod(F.crc32("t.term"), F.lit(c["buckets"])).cast("int").alias("bucket"), "t.term", "block", "id", "t.tf", "len")
        # one shuffle and sort; a term's blocks lie side by side, so a scan skips the row groups of other terms.  Ranges, not
        # buckets, are the tasks: their number grows with the postings, and a frequent term's blocks are dealt to several
        posts = posts.repartitionByRange(max(1, -(-postings // SHARE)), "bucket", "term", "block").sortWithinPartitions("bucket", "term", "block", "id").mapInArrow(_blocks, POSTINGS)
        posts.write.partitionBy("bucket").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/postings")
        base = self._without(rows.select("id")) if c["segments"] else self
        c = base.content
        return base._next(segments=[*c["segments"], name], n=c["n"] + n, total=c["total"] + total)

    def _without(self, ids: DataFrame) -> KeywordIndex:
        """This index, not committed, without the documents that it has of ``ids``."""
        c, name = self.content, uuid.uuid4().hex
        path = f"{self.folder}/deleted/{name}"
        gone = self.docs().join(ids.select("id").distinct(), "id", "left_semi")
        gone.select("id", "segment", "len").write.parquet(path)
        n, total = self.spark.read.parquet(path).agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        return replace(self, content=c | {"deleted": [*c["deleted"], name], "n": c["n"] - n, "total": c["total"] - total}) if n else self

    def delete(self, ids: DataFrame) -> KeywordIndex:
        """Without the documents of the ids (a column ``id``); ids that it has not are let be."""
        left = self._without(ids)
        return self if left is self else left._next()

    def _deleted(self) -> DataFrame | None:
        names = self.content["deleted"]
        return self.spark.read.parquet(*[f"{self.folder}/deleted/{d}" for d in names]).select("id", "segment") if names else None

    def _segments(self, kind: str, schema: str) -> DataFrame:
        frames = [self.spark.read.schema(schema).parquet(f"{self.folder}/segments/{s}/{kind}").withColumn("segment", F.lit(s)) for s in self.content["segments"]]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], f"{schema}, segment string")

    def docs(self) -> DataFrame:
        """(id, len, block, segment) of the documents in the index."""
        rows, gone = self._segments("docs", "id long, len long, block long"), self._deleted()
        return rows if gone is None else rows.join(gone, ["id", "segment"], "left_anti")

    def compact(self) -> KeywordIndex:
        """The same documents as one segment, in a new commit; nothing of the texts is read."""
        counts, gone, name = self._segments("counts", COUNTS), self._deleted(), uuid.uuid4().hex
        live = counts if gone is None else counts.join(gone, ["id", "segment"], "left_anti")
        live.select("id", "len", "terms").write.parquet(f"{self.folder}/segments/{name}/counts")
        return replace(self, content=self.content | {"segments": [], "deleted": [], "n": 0, "total": 0})._added(name)

    def postings(self, terms: list[str]) -> DataFrame:
        """The posting blocks of the terms: their folders alone are listed, and their row groups read."""
        only = sorted({_bucket(t, self.content["buckets"]) for t in terms})
        return self._segments("postings", POSTINGS).where(F.col("bucket").isin(only) & F.col("term").isin(terms))

    def known(self, query: list[str]) -> list[str]:
        """The stems of the query that some document holds."""
        rows = self.postings(sorted({Stems()[t.lower()] for t in query}))
        gone = self._deleted()
        if gone is not None:
            rows = rows.select("term", "segment", F.explode("ids").alias("id")).join(gone, ["id", "segment"], "left_anti")
        return sorted(r["term"] for r in rows.select("term").distinct().collect())

    def search(self, query: list[str], top_k: int | None = None, k1: float = 1.2, b: float = 0.75, match: str = "and") -> DataFrame:
        """(id, score), best first: as ``retrieval.bm25`` over the documents in the index."""
        wanted, c = sorted({Stems()[t.lower()] for t in query}), self.content
        if not wanted or not c["n"]:
            return self.spark.createDataFrame([], "id long, score double")
        posts, gone = self.postings(wanted), self._deleted()
        # bounds alone are read: a line for each term and block, which come to the driver while they are few
        lines = posts.select("segment", "block", "term", "n", "top", "least")
        few = lines.limit(NAMED + 1).collect()
        few = None if len(few) > NAMED else few
        df = dict.fromkeys(wanted, 0)
        for r in lines.groupBy("term").agg(F.sum("n").alias("n")).collect() if few is None else few:
            df[r["term"]] += r["n"]
        if gone is not None:
            lost = posts.select("term", "segment", F.explode("ids").alias("id")).join(gone, ["id", "segment"], "left_semi")
            for r in lost.groupBy("term").agg(F.count("*").alias("n")).collect():
                df[r["term"]] -= r["n"]
        if not (all if match == "and" else any)(df.values()):
            return self.spark.createDataFrame([], "id long, score double")
        average = c["total"] / c["n"]
        idf = [max(math.log((c["n"] - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) for t in wanted]

        def part(i: int, tf, length):
            """A term's share of a score, as bm25() adds it: of columns, or of numbers."""
            return idf[i] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))

        def scored(rows: DataFrame) -> DataFrame:
            each = rows.select("segment", "term", F.explode(F.arrays_zip("ids", "tf", "lens")).alias("p")).select("segment", "term", F.col("p.ids").alias("id"), "p.tf", F.col("p.lens").alias("len"))
            each = each.groupBy("id", "segment").agg(F.max("len").alias("len"), *[F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(wanted)])
            if gone is not None:
                each = each.join(gone, ["id", "segment"], "left_anti")
            hit = reduce(lambda x, y: x & y if match == "and" else x | y, [F.col(f"tf{i}") > 0 for i in range(len(wanted))])
            return each.where(hit).select("id", reduce(lambda x, y: x + y, [part(i, F.col(f"tf{i}").cast("double"), F.col("len")) for i in range(len(wanted))], F.lit(0.0)).alias("score"))

        if not top_k:
            return scored(posts)
        order = lambda rows: rows.orderBy(F.desc("score"), "id").limit(top_k)
        if few is not None:
            met: dict[tuple[str, int], list[float]] = {}
            for r in few:
                met.setdefault((r["segment"], r["block"]), []).append(part(wanted.index(r["term"]), float(r["top"]), r["least"]))
            best = sorted(((sum(v), *k) for k, v in met.items() if match == "or" or len(v) == len(wanted)), reverse=True)
            bounds = None
        else:
            bound = reduce(lambda x, y: x + y, [F.coalesce(F.max(F.when(F.col("term") == t, part(i, F.col("top").cast("double"), F.col("least")))), F.lit(0.0)) for i, t in enumerate(wanted)])
            bounds = lines.groupBy("segment", "block").agg(F.count("*").alias("terms"), bound.alias("bound")).where(F.col("terms") >= (len(wanted) if match == "and" else 1))
            best = [(r["bound"], r["segment"], r["block"]) for r in bounds.orderBy(F.desc("bound"), "segment", "block").limit(NAMED + 1).collect()]
        if len(best) <= FIRST:
            return order(scored(self._named(posts, best)))
        # the most promising blocks give a score to beat; only blocks that may reach it are read beside
        found = order(scored(self._named(posts, best[:FIRST]))).collect()
        last = found[-1]["score"] * (1 - 1e-12) if len(found) == top_k else 0.0
        rest = [r for r in best[FIRST:] if r[0] >= last]
        if len(best) > NAMED and best[-1][0] >= last and bounds is not None:
            return order(scored(posts.join(bounds.where(F.col("bound") >= last).select("segment", "block"), ["segment", "block"], "left_semi")))
        return order(scored(self._named(posts, best[:FIRST] + rest))) if rest else self.spark.createDataFrame(found, "id long, score double")

    @staticmethod
    def _named(posts: DataFrame, blocks: list) -> DataFrame:
        """The posting blocks of some blocks of documents; their numbers reach the scan."""
        if not blocks:
            return posts.where(F.lit(False))
        both = F.concat_ws(" ", "segment", "block").isin([f"{s} {k}" for _, s, k in blocks])
        return posts.where(F.col("block").isin(sorted({k for *_, k in blocks})) & both)
