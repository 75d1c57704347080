"""Questions that every document asks of the whole corpus, asked in bulk.

Several operators need, for each token or n-gram of a document, something that
only the whole corpus knows (a count, an encoding, the first document that has
it).  One row per occurrence would move far more bytes than the corpus has, so
documents are packed into *chunks*; a chunk sends each of its distinct keys once
to the *shard* that owns the key, the shard merges what all chunks sent and
answers each chunk in the order asked, and the chunk applies the answers to its
documents.  Hot keys are thus aggregated before the shuffle: a key costs one
entry per chunk, however many documents hold it.

Chunks and shards are as many as ``spark.sql.shuffle.partitions``, so both stay
at the size that the cluster was set up for when the corpus grows.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKED = "chunk int, blob binary"
ASKED = "shard int, chunk int, blob binary"
ANSWERED = "chunk int, shard int, blob binary"


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.  Where that is unset, a folder of this machine, which only a local master has to itself."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        top = tempfile.mkdtemp(prefix="mnemospark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df has not, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, path: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows, written to the shared folder (``path``, or a new one) and read again: cuts lineage and survives lost executors.  ``by``: a folder for each value."""
    spark, path = df.sparkSession, path or scratch(df.sparkSession)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def to_blob(**columns) -> bytes:
    table = pa.table({k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(chunk, blob): documents dealt evenly to chunks by a hash of the row, compressed; ``carry``: columns that go along as carry_0, carry_1, ..."""
    n = width(docs.sparkSession)

    def packed(batches):
        for b in batches:
            chunk = b.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(chunk, kind="stable")
            ends = np.flatnonzero(np.diff(chunk[order])) + 1
            for rows in np.split(order, ends) if len(order) else ():
                part = b.take(pa.array(rows))
                blob = to_blob(**{c: part.column(k) for k, c in enumerate(names, 1)})
                yield pa.RecordBatch.from_arrays([pa.array([chunk[rows[0]]], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "blob"])

    names = ("id", "text", *(f"carry_{k}" for k in range(len(carry))))
    i, t = F.col(id_col).cast("long"), F.col(text_col)
    rows = docs.select(F.pmod(F.xxhash64(i, t), F.lit(n)).cast("int").alias("chunk"), i.alias("id"), t.alias("text"), *[F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)])
    return rows.mapInArrow(packed, PACKED).repartition(n, "chunk")


def rows_of(table: pa.Table) -> pa.Table:
    """(id, text and what is carried) of a chunk, in an order that does not depend on how its blobs arrived."""
    return pa.concat_tables([from_blob(b.as_py()) for b in table.column("blob")]).sort_by([("id", "ascending"), ("text", "ascending")])


def unpack(table: pa.Table) -> tuple[list, list]:
    """Ids and texts of a chunk, as lists."""
    rows = rows_of(table)
    return rows.column("id").to_pylist(), rows.column("text").to_pylist()


def vocabulary() -> dict:
    """A dict that numbers its keys in the order in which they are first looked up."""
    v: dict = defaultdict()
    v.default_factory = v.__len__
    return v


def by_shard(words: list, n: int) -> list[np.ndarray]:
    """For each shard, the positions of its words in the list."""
    shard = np.fromiter((zlib.crc32(w) % n for w in words), np.int32, len(words))
    order = np.argsort(shard, kind="stable")
    return np.split(order, np.searchsorted(shard[order], np.arange(1, n)))


def asked(chunk: int, blobs: dict[int, bytes]) -> pa.Table:
    return pa.table({"shard": pa.array(list(blobs), pa.int32()), "chunk": pa.array([chunk] * len(blobs), pa.int32()), "blob": pa.array(list(blobs.values()), pa.binary())})


def answered(shard: int, blobs: dict[int, bytes]) -> pa.Table:
    return pa.table({"chunk": pa.array(list(blobs), pa.int32()), "shard": pa.array([shard] * len(blobs), pa.int32()), "blob": pa.array(list(blobs.values()), pa.binary())})


def _lean(f):
    """After each group, Arrow's pool gives back what it holds: workers share an executor's memory with the JVM."""

    def one(table: pa.Table) -> pa.Table:
        out = f(table)
        pa.default_memory_pool().release_unused()
        return out

    def two(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = f(table, answers)
        pa.default_memory_pool().release_unused()
        return out

    return one if f.__code__.co_argcount == 1 else two


def per_chunk(packed: DataFrame, ask, schema: str = ASKED) -> DataFrame:
    return packed.groupBy("chunk").applyInArrow(_lean(ask), schema)


def per_shard(questions: DataFrame, answer, schema: str = ANSWERED) -> DataFrame:
    return questions.groupBy("shard").applyInArrow(_lean(answer), schema)


def applied(packed: DataFrame, answers: DataFrame, finish, schema: str) -> DataFrame:
    return packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_lean(finish), schema)
