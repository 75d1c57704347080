"""Tables of versions: bucketed files under commits, of which each is one small file.

A commit names the files of every bucket, so a reader keeps the version that it opened whatever is
written later, and a writer replaces only the buckets that its rows touch.  Commits are
numbered; a writer that began from an older version than the last loses with ``Conflict``
and leaves the table as it was.  That is as safe as the file system's creation of a file that
must not exist yet, which HDFS and local folders give.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has committed since this one read the table."""


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def commits(spark: SparkSession, folder: str) -> list[tuple[int, dict]]:
    """(number, content) of the commits in a folder, in order; those that were never finished are left out."""
    files, where = _folder(spark, f"{folder.rstrip('/')}/_commits")
    out = []
    for status in files.listStatus(where) if files.exists(where) else ():
        stream = files.open(status.getPath())
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if text.endswith("\n"):
            out.append((int(status.getPath().getName().split(".")[0]), json.loads(text)))
    return sorted(out, key=lambda c: c[0])


def commit(spark: SparkSession, folder: str, content: dict, after: int) -> int:
    """Adds a commit after the one numbered ``after`` (-1: the first), and returns its number; ``Conflict`` where that is not the last."""
    path = f"{folder.rstrip('/')}/_commits"
    files, where = _folder(spark, path)
    files.mkdirs(where)
    last = max((n for n, _ in commits(spark, folder)), default=-1)
    if last != after:
        raise Conflict(f"{folder}: version {last} is there, this writer read {after}")
    taken = [int(s.getPath().getName().split(".")[0]) for s in files.listStatus(where)]
    number = max([after, *taken]) + 1  # past what a writer that died has left
    try:
        stream = files.create(_folder(spark, f"{path}/{number:012d}.json")[1], False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            raise Conflict(f"{folder}: version {number} was written at the same time") from e
        raise
    stream.write(bytearray((json.dumps(content) + "\n").encode()))
    stream.close()
    return number


@dataclass(frozen=True)
class Table:
    """A version of a table: rows by ``key`` in buckets; every change returns the next version."""

    spark: SparkSession
    folder: str
    version: int
    key: str
    schema: StructType
    buckets: int
    files: dict[int, str]

    @staticmethod
    def create(df: DataFrame, folder: str, key: str = "id", buckets: int = BUCKETS) -> Table:
        """Writes the rows as the first version; of several rows of one key one stays, see ``upsert``."""
        empty = Table(df.sparkSession, folder.rstrip("/"), -1, key, df.schema, buckets, {})
        return empty.overwrite(df)

    @staticmethod
    def open(spark: SparkSession, folder: str, version: int | None = None) -> Table:
        """The last version, or the one asked for."""
        known = commits(spark, folder)
        found = [c for c in known if version is None or c[0] == version]
        if not found:
            raise KeyError(f"{folder}: no version {'at all' if version is None else version}")
        number, c = found[-1]
        return Table(spark, folder.rstrip("/"), number, c["key"], StructType.fromJson(c["schema"]), c["buckets"], {int(b): f for b, f in c["files"].items()})

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def rows(self, only: list[int] | None = None) -> DataFrame:
        """The rows of this version, or of some of its buckets."""
        paths = sorted({f for b, f in self.files.items() if only is None or b in only})
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def lookup(self, keys: list) -> DataFrame:
        """The rows of some keys; reads their buckets alone."""
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.key]]))
        only = [r["b"] for r in asked.select(self._bucket().alias("b")).distinct().collect()]
        return self.rows(only).where(F.col(self.key).isin(keys))

    def _single(self, df: DataFrame) -> DataFrame:
        """One row of each key: the greatest, column by column; rows without a key stay."""
        df = df.select(*self.schema.names)
        rest = [c for c in self.schema.names if c != self.key]
        one = df.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max(F.struct(*rest)).alias("__r"))
        return one.select(self.key, "__r.*").select(*self.schema.names).unionByName(df.where(F.col(self.key).isNull()))

    def _write(self, df: DataFrame, touched: list[int], kept: dict[int, str]) -> Table:
        part, name = "__bucket", f"{self.folder}/data/{uuid.uuid4().hex}"
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).withColumn(part, self._bucket())
        rows.repartition(max(1, len(touched)), part).write.partitionBy(part).parquet(name)
        files, where = _folder(self.spark, name)
        made = [s.getPath().getName() for s in files.listStatus(where) if s.isDirectory()]
        files = kept | {int(d.split("=")[1]): f"{name}/{d}" for d in made}
        content = {"key": self.key, "schema": json.loads(self.schema.json()), "buckets": self.buckets, "files": files}
        number = commit(self.spark, self.folder, content, self.version)
        return Table(self.spark, self.folder, number, self.key, self.schema, self.buckets, files)

    def overwrite(self, df: DataFrame) -> Table:
        """All rows anew, in one commit; of several rows of one key one stays."""
        return self._write(self._single(df), list(range(self.buckets)), {})

    def _touched(self, df: DataFrame) -> list[int]:
        return sorted(r["b"] for r in df.select(self._bucket().alias("b")).distinct().collect())

    def upsert(self, df: DataFrame) -> Table:
        """The rows in place of those with their keys, and beside all others; only buckets with such keys are read and written.

        Of several new rows of a key the greatest stays, column by column; rows with a null key are added.
        """
        touched = self._touched(df)
        new = self._single(df)
        old = self.rows(touched).join(new.select(self.key), self.key, "left_anti")
        return self._write(old.unionByName(new), touched, {b: f for b, f in self.files.items() if b not in touched}) if touched else self

    def insert_ignore(self, df: DataFrame) -> Table:
        """The rows whose keys are not there yet."""
        touched = self._touched(df)
        old = self.rows(touched)
        new = self._single(df).join(old.select(self.key), self.key, "left_anti")
        return self._write(old.unionByName(new), touched, {b: f for b, f in self.files.items() if b not in touched}) if touched else self

    def delete(self, keys: DataFrame) -> Table:
        """Without the rows of the keys (a column named as the key); a bucket that becomes empty has no files."""
        touched = [b for b in self._touched(keys) if b in self.files]
        old = self.rows(touched).join(keys.select(self.key).distinct(), self.key, "left_anti")
        return self._write(old, touched, {b: f for b, f in self.files.items() if b not in touched}) if touched else self

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes data that none of the last ``keep`` versions names, and the older commits; readers of those lose their files."""
        known = commits(self.spark, self.folder)
        used = {f.rsplit("/", 1)[0] for _, c in known[-keep:] for f in c["files"].values()}
        files, where = _folder(self.spark, f"{self.folder}/data")
        gone = []
        for number, _ in known[:-keep]:
            files.delete(_folder(self.spark, f"{self.folder}/_commits/{number:012d}.json")[1], False)
        for s in files.listStatus(where) if files.exists(where) else ():
            name = f"{self.folder}/data/{s.getPath().getName()}"
            if name not in used:
                files.delete(s.getPath(), True)
                gone.append(name)
        return gone
