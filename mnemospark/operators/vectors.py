"""Dense vectors: normalisation, exact nearest neighbours of one vector, denoising, embedding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def normalize_vectors(df: DataFrame, dim: int, vec_col: str = "vector") -> DataFrame:
    """Rows with a vector of ``dim`` values, at unit length; others are left out."""
    return df.where(F.size(vec_col) == dim).withColumn(vec_col, normalized(F.col(vec_col)))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def knn(df: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """(id, score) of the k nearest rows, exact: cosine, or squared L2 as ``l2``; ties by id.

    One scan of two columns; each batch keeps its own k best before the final top k.
    Rows whose vector is null or of another length are left out.
    """
    q = np.asarray(query, np.float64)
    best_is_high = metric == "cosine"

    def run(batches):
        for b in batches:
            m = _matrix(b.column(1), len(q))
            s = m @ q / np.maximum(np.linalg.norm(m, axis=1) * np.linalg.norm(q), 1e-300) if best_is_high else ((m - q) ** 2).sum(axis=1)
            ids = b.column(0).to_numpy()
            at = np.lexsort([ids, -s if best_is_high else s])[:k]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(s[at])], ["id", "score"])

    rows = df.where(F.size(vec_col) == len(q)).select(F.col(id_col).cast("long").alias("id"), vec_col).mapInArrow(run, "id long, score double")
    return rows.orderBy(F.col("score").desc() if best_is_high else F.col("score"), "id").limit(k)


def denoise(df: DataFrame, dim: int, drop: int = 3, out: int | None = None, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """Vectors less their mean and first ``drop`` principal directions, projected to ``out`` directions, at unit length.

    One pass sums a (dim + 1)^2 Gram matrix, which alone comes to the driver; one pass projects.
    """
    rows = df.where(F.size(vec_col) == dim)

    def gram(batches):
        g = np.zeros((dim + 1, dim + 1))
        for b in batches:
            m = _matrix(b.column(0), dim)
            m = np.column_stack([m, np.ones(len(m))])
            g += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array(g.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    parts = rows.select(vec_col).mapInArrow(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    g = np.zeros((dim + 1, dim + 1))
    for r in parts:
        g[r.i, r.j] = r.x
    n = max(g[dim, dim], 1)
    mean = g[dim, :dim] / n
    values, vectors = np.linalg.eigh(g[:dim, :dim] / n - np.outer(mean, mean))
    order = vectors[:, np.argsort(-values)]
    basis = order[:, drop : drop + out] if out else None
    noise = order[:, :drop]

    def project(batches):
        for b in batches:
            m = _matrix(b.column(1), dim) - mean
            m = m - m @ noise @ noise.T
            m = m @ basis if basis is not None else m
            m = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.tolist(), pa.list_(pa.float64()))], ["id", "vector"])

    return rows.select(F.col(id_col).cast("long").alias("id"), vec_col).mapInArrow(project, "id long, vector array<double>")


def fallback_embedding(text: str | None, dim: int) -> list[float]:
    """A vector that depends on the text alone: drawn from its MD5 as seed."""
    import hashlib

    seed = int(hashlib.md5((text or "").encode()).hexdigest()[:8], 16)
    return np.random.RandomState(seed).randn(dim).astype("float32").tolist()


def embed(df: DataFrame, dim: int, text_col: str = "text", out_col: str = "vector", model=None) -> DataFrame:
    """df with a vector for each text, from ``model`` (a function of a list of texts), or the fallback.

    Equal texts of a batch are embedded once; a blank or null text has the zero vector.
    """
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            once = list(dict.fromkeys(t for t in texts if t and t.strip()))
            of = dict(zip(once, model(once) if model and once else [fallback_embedding(t, dim) for t in once]))
            made = [of.get(t, [0.0] * dim) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float32()))], [*b.schema.names, out_col])

    return df.mapInArrow(run, df.withColumn(out_col, F.array().cast("array<float>")).schema)


def embed_distinct(df: DataFrame, dim: int, model=None, text_col: str = "text", out_col: str = "vector") -> DataFrame:
    """df with a vector for each text, each distinct text embedded once over all partitions.

    ``model``: a function without arguments that gives a function of a list of texts; it is called once a Python worker.  None: the fallback.
    Distinct texts meet by hash, their vectors are written, and rows take them by hash: texts that very many rows share
    are one row until then.  A blank or null text has the zero vector.
    """
    from ..sources.tables import fresh_name, written

    blank = F.coalesce(F.trim(F.translate(F.col(text_col), "\t\r\n\f\v", "     ")) == "", F.lit(True))
    once = df.where(~blank).groupBy(F.sha2(text_col, 256).alias("sha")).agg(F.any_value(text_col).alias("text"))
    name = f"{getattr(model, '__module__', '')}.{getattr(model, '__qualname__', '')}"

    def run(batches):
        import sys

        made = sys.modules.setdefault("_mnemospark_models", type(sys)("_mnemospark_models"))
        if model and name not in made.__dict__:
            made.__dict__[name] = model()
        for b in batches:
            texts = b.column(1).to_pylist()
            vectors = made.__dict__[name](texts) if model else [fallback_embedding(t, dim) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))], ["sha", "vector"])

    vectors = written(once.mapInArrow(run, "sha string, vector array<float>"))
    key, of, value = (fresh_name(df, c) for c in ("sha", "of", "made"))
    rows = df.withColumn(key, F.when(~blank, F.sha2(text_col, 256)))
    rows = rows.join(vectors.select(F.col("sha").alias(of), F.col("vector").alias(value)), F.col(key) == F.col(of), "left")
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return rows.withColumn(out_col, F.coalesce(value, zero)).drop(key, of, *([] if value == out_col else [value]))
