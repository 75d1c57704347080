"""Reading and writing tables and files: thin, lazy wrappers over Spark's own readers and writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are never scanned.
EXCLUDED = (".git", "__pycache__", "node_modules", ".vscode", "projects")

#: Scratch folders of this process.
MADE: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.  Where that is unset, a folder of this machine, which only a local master has to itself."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        top = tempfile.mkdtemp(prefix="mnemospark-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/{uuid.uuid4().hex}"
    MADE.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Deletes the folders that scratch() has named in this process, and tells how many; what was read from them is lost."""
    count = len(MADE)
    while MADE:
        folder = spark._jvm.org.apache.hadoop.fs.Path(MADE.pop())
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return count


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df has not, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scan(df: DataFrame, *cols: str) -> DataFrame:
    """Columns of all rows in order of id."""
    return df.select(*cols).orderBy("id")


def active(df: DataFrame) -> DataFrame:
    return df.where(~F.col("merged"))


def page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of rows in order of id, with the table's row count on each; past the end one row of nulls, with the count."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy("id").offset(offset).limit(limit)
    return total.join(F.broadcast(rows), F.lit(True), "left").select(*df.columns, "total")


def listing(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """(id, text, source_file): rows in order of id, null texts as empty.

    The last id of the list is found over ids alone, so the task that sorts the list gets no other rows' texts.
    """
    last = df.select("id").orderBy("id").limit(limit).agg(F.max("id")).scalar()
    rows = df.where(F.col("id").isNull() | (F.col("id") <= last))
    return rows.select("id", F.coalesce("text", F.lit("")).alias("text"), "source_file").orderBy("id").limit(limit)


def wanted_path(path, excluded=EXCLUDED, suffix: str | None = ".md"):
    """Whether a path has the suffix and no excluded folder."""
    inside = F.exists(F.split(path, "/"), lambda p: p.isin(*excluded))
    return ~inside & (path.endswith(suffix) if suffix else F.lit(True))


def markdown_files(spark: SparkSession, root: str, excluded=EXCLUDED) -> DataFrame:
    """(path, text, sha256) of all .md files below a folder; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    rows = files.where(wanted_path(F.col("path"), excluded))
    return rows.select("path", F.decode(F.try_validate_utf8(F.decode("content", "UTF-8")).cast("binary"), "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"), F.unix_timestamp("modificationTime").alias("modified"))


def text_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, text) of files that a glob names, each whole."""
    return spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_triples(df: DataFrame, path: str) -> None:
    df.select("subject", "predicate", "object", "subject_type", "object_type", "source_file", "confidence").write.mode("overwrite").option("header", True).csv(path)


def valid_triples(df: DataFrame) -> DataFrame:
    """Rows of strings as triples: trimmed, types 'other' and confidence 1 where missing or wrong, rows without all three parts left out."""
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    kind = lambda c: F.when(clean(c) == "", "other").otherwise(clean(c))
    rows = df.select(clean("subject").alias("subject"), clean("predicate").alias("predicate"), clean("object").alias("object"), kind("subject_type").alias("subject_type"), kind("object_type").alias("object_type"), clean("source_file").alias("source_file"), F.coalesce(F.expr("try_cast(confidence as double)"), F.lit(1.0)).alias("confidence"))
    return rows.where((F.col("subject") != "") & (F.col("predicate") != "") & (F.col("object") != ""))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    names = ("subject", "predicate", "object", "subject_type", "object_type", "source_file", "confidence")
    return valid_triples(spark.read.option("header", True).schema(", ".join(f"{n} string" for n in names)).csv(path))


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.jdbc(url, table, properties=options)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.jdbc(url, table, mode, options)


def numbered_lines(files: DataFrame) -> DataFrame:
    """(path, line_no from 1, line)."""
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("path", (F.col("p") + 1).alias("line_no"), "line")


def read_slice(files: DataFrame, start: int, end: int, pad: int = 20) -> DataFrame:
    """(path, slice): lines start to end of each file; where the file is too short, earlier lines join in steps of ``pad``."""
    lines = F.split("text", "\n")
    last, want = F.least(F.size(lines), F.lit(end)), end - start + 1
    lacking = F.greatest(F.lit(0), F.lit(want) - (last - max(1, start) + 1))
    first = F.greatest(F.lit(1), F.lit(max(1, start)) - F.ceil(lacking / pad) * pad).cast("int")
    return files.select("path", F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n").alias("slice"))


def symbols(files: DataFrame) -> DataFrame:
    """(path, symbol, start, end): each def or class, to the line before the next one or the last line; per file, without a shuffle."""
    lines = F.split("text", "\n")
    marked = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("start"), F.regexp_extract(x, r"^\s*(?:def|class)\s+(\w+)", 1).alias("symbol"))), lambda s: s["symbol"] != "")
    rows = files.select("path", F.size(lines).alias("total"), marked.alias("s"))
    ends = F.transform("s", lambda x, i: F.struct(x["symbol"].alias("symbol"), x["start"].alias("start"), F.coalesce(F.get("s", i + 1)["start"] - 1, F.col("total")).alias("end")))
    return rows.select("path", F.inline(ends))
