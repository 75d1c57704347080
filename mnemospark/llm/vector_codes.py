"""Vectors as short codes of their parts' nearest codebook entries, by partial-distance search.

Each part position has a codebook of integer entries.  A part's nearest entry is found dimension by
dimension, those first along which the codebook varies most: all pairs of a part and an entry begin as
candidates, and a mask drops those whose distance so far exceeds the best complete distance known
for the part, which is that of the entry nearest along the first dimension, then of the
entries already searched.  Only a distance that strictly exceeds the best is dropped, so
ties remain and go to the lower index.  Distances are whole numbers, and so exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .whitening import finite, matrix

#: Magnitudes up to which squared distances of parts, and their sums, are within 63 bits.
SAFE = 1 << 24
#: Entries that are searched before the best distances are taken anew.
STEP = 16
MAX_BROADCAST = 100_000
SALTS = 32
LONG = (1 << 63) - 1


def integers(m: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale x), within a long's range; Python's integers where squares might overflow."""
    x = np.floor(m.astype(np.float64) * scale)
    if not len(x) or np.abs(x).max() < SAFE:
        return x.astype(np.int64)
    out = np.empty(x.shape, object)
    out[:] = [[min(LONG, max(-LONG - 1, int(v))) for v in row] for row in x.tolist()]
    return out


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, the lower of equals, and the squared distance to it."""
    kind = object if object in (parts.dtype, book.dtype) else np.int64
    parts, book = parts.astype(kind), book.astype(kind)
    spread = (len(book) * (book * book).sum(axis=0) - book.sum(axis=0) ** 2).tolist()
    order = sorted(range(book.shape[1]), key=lambda d: -spread[d])
    p, c = parts[:, order], book[:, order]
    # to begin with, the entry nearest along the first dimension: its complete distance bounds all others
    rank = np.argsort(c[:, 0], kind="stable")
    at = np.searchsorted(c[rank, 0], p[:, 0])
    near = np.stack([rank[np.minimum(at, len(c) - 1)], rank[np.maximum(at - 1, 0)]])
    first = np.abs(c[near[0], 0] - p[:, 0]) <= np.abs(c[near[1], 0] - p[:, 0])
    index = np.where(first, near[0], near[1])
    best = ((c[index] - p) ** 2).sum(axis=1)
    for k in range(0, len(c), STEP):
        block = c[k : k + STEP]
        total = (p[:, :1] - block[None, :, 0]) ** 2
        row, entry = np.nonzero(total <= best[:, None])
        total = total[row, entry]
        for d in range(1, c.shape[1]):
            total = total + (p[row, d] - block[entry, d]) ** 2
            alive = total <= best[row]
            row, entry, total = row[alive], entry[alive], total[alive]
        if not len(row):
            continue
        # what is left of a part is at its best distance or nearer: the least, and of equals the first
        by = np.lexsort([entry, total, row]) if kind is np.int64 else np.array(sorted(range(len(row)), key=lambda q: (row[q], total[q], entry[q])), int)
        row, entry, total = row[by], entry[by] + k, total[by]
        lead = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        row, entry, total = row[lead], entry[lead], total[lead]
        wins = (total < best[row]) | (entry < index[row])
        index[row[wins]], best[row[wins]] = entry[wins], total[wins]
    return index, best


def assigned(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's entries, a column a part, and its squared distances summed over parts."""
    step, codes, error = x.shape[1] // len(books), [], 0
    for k, book in enumerate(books):
        index, far = nearest(x[:, k * step : (k + 1) * step], book)
        codes.append(index)
        error = error + far.astype(object) if x.dtype == object or far.dtype == object else error + far
    return np.stack(codes, axis=1), error


def _counts(rows: DataFrame, dim: int, books: list[np.ndarray], scale: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """For each part and entry, how many parts are nearest to it, and their sums by position; as many numbers as the codebooks have come to the driver."""
    parts, size, step = len(books), len(books[0]), dim // len(books)

    def run(batches):
        count = np.zeros((parts, size), np.int64)
        hi, lo = (np.zeros((parts, size, step), np.int64) for _ in range(2))
        for b in batches:
            x = integers(matrix(b.column(0), dim), scale)
            codes, _ = assigned(x, books)
            # an entry's sums as whole numbers of 32 bits and the rest, which no number of rows lets overflow
            high, low = ((x // (1 << 32)).astype(np.int64), (x % (1 << 32)).astype(np.int64)) if x.dtype == object else (x >> 32, x & 0xFFFFFFFF)
            for k in range(parts):
                np.add.at(count[k], codes[:, k], 1)
                np.add.at(hi[k], codes[:, k], high[:, k * step : (k + 1) * step])
                np.add.at(lo[k], codes[:, k], low[:, k * step : (k + 1) * step])
        k, e = np.nonzero(count)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(e, pa.int32()), pa.array(count[k, e]), pa.array(hi[k, e].tolist(), kind), pa.array(lo[k, e].tolist(), kind)], ["part", "entry", "n", "hi", "lo"])

    exact = lambda c: [F.sum(F.get(c, F.lit(i)).cast("decimal(28,0)")).alias(f"{c}{i}") for i in range(step)]
    found = rows.mapInArrow(run, "part int, entry int, n long, hi array<long>, lo array<long>").groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact("hi"), *exact("lo")).collect()
    return {(r["part"], r["entry"]): (r["n"], [int(r[f"hi{i}"]) * (1 << 32) + int(r[f"lo{i}"]) for i in range(step)]) for r in found}


def _book(entries: list[list[int]]) -> np.ndarray:
    small = all(abs(v) < SAFE for e in entries for v in e)
    return np.array(entries, np.int64 if small else object)


def codebooks(rows: DataFrame, dim: int, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> list[np.ndarray]:
    """A codebook for each part position of rows (id, v), begun with the vectors of the smallest ids and moved to their parts' means in each round.

    Null ids come last; of equal ids the smaller vector is first.  Codebooks have fewer entries where there are fewer rows.
    """
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    x, step = integers(np.array([r["v"] for r in first], np.float64).reshape(-1, dim), scale), dim // parts
    books = [_book(x[:, k * step : (k + 1) * step].tolist()) for k in range(parts)]
    for _ in range(rounds):
        moved = [b.tolist() for b in books]
        for (k, e), (n, sums) in _counts(rows.select("v"), dim, books, scale).items():
            moved[k][e] = [s // n for s in sums]
        books = [_book(m) for m in moved]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for e in b.tolist() for v in e).encode()).hexdigest()


def encode(rows: DataFrame, dim: int, books: list[np.ndarray], scale: int = 256) -> DataFrame:
    """rows (v, others) with ``code`` and ``error`` in place of v; an error past a long's range is null."""
    names = [c for c in rows.columns if c != "v"]
    schema = rows.select(*names).withColumns({"code": F.lit(""), "error": F.lit(0).cast("long")}).schema
    for field in schema.fields:
        field.nullable = True

    def run(batches):
        for b in batches:
            codes, error = assigned(integers(matrix(b.column(0), dim), scale), books)
            text = codes.astype(np.uint8).tobytes().hex()
            wide = 2 * len(books)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([text[k : k + wide] for k in range(0, len(text), wide)], pa.string()), pa.array([v if v <= LONG else None for v in map(int, error)], pa.int64())], [*names, "code", "error"])

    return rows.select("v", *names).mapInArrow(run, schema)


def decode(codes: DataFrame, books: list[np.ndarray], code_col: str = "code", out_col: str = "decoded") -> DataFrame:
    """codes with the vector that each code stands for, as integers; null for a null code."""
    table = F.array(*[F.array(*[F.lit(v).cast("long") for v in e]) for b in books for e in b.tolist()])
    entry = lambda k: F.conv(F.substring(code_col, 2 * k + 1, 2), 16, 10).cast("int") + k * len(books[0])
    out = F.flatten(F.array(*[F.get(table, entry(k)) for k in range(len(books))]))
    return codes.withColumn(out_col, F.when(F.length(code_col) == 2 * len(books), out))


def compress(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row.

    Rows are left out whose vector is null, empty, holds null or non-finite entries, or is not of that length, a multiple of ``parts``, which most have (of several the least).
    Entries past a long's range are its ends.  ``error`` is exact, null where it is no long; ``label_error`` is the sum of the
    errors of a label's rows (null where one is null or the sum no long), null labels together.  Null ids and repeated rows are coded like any other; an empty table gives no rows; other columns are
    not read.  Rows do not move but for the sums of labels, which are broadcast while they are few and dealt to salts beyond.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.col(label_col).alias("label")).where(finite("v"))
    rows = rows.where(F.size("v") % parts == 0)
    top = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if not top:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows, dim = rows.where(F.size("v") == top["size"]), top["size"]
    books = codebooks(rows, dim, parts, entries, rounds, scale)
    coded = encode(rows, dim, books, scale)
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    whole = F.when((F.count("error") == F.count("*")) & (total <= LONG), total).cast("long")
    sums = coded.groupBy("label").agg(whole.alias("label_error")).select(F.col("label").alias("of"), "label_error")
    out = F.lit(digest(books)).alias("codebooks_sha256")
    if rows.select("label").distinct().limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        joined = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")))
    else:
        salt = F.pmod(F.xxhash64("id", "code", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
        sums = sums.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = coded.withColumn("salt", salt).join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", out)


SQL = """
with k as (select vec_id, label, list_transform(embedding, lambda c: floor(256 * c::double)::bigint) x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0),
p as materialized (select vec_id, label, part, x[part * len(x) // 16 + 1 : (part + 1) * len(x) // 16] v from k, range(16) t(part)),
c0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 entry, v from p where vec_id in (select vec_id from k order by vec_id limit 64)),
"""


def _round(a: str, b: str, last: bool = False) -> str:
    near = f"""{b}a as materialized (select vec_id, part, min(struct_pack(d := d, entry := entry)) m from
  (select p.vec_id, p.part, entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint d from p join {a} c on p.part = c.part) group by 1, 2)"""
    if last:
        return near
    return near + f""",
{b} as materialized (select c.part, c.entry, coalesce(n.v, c.v) v from {a} c left join
  (select part, entry, list(f order by i) v from (select part, entry, i, floor(sum(x) / count(*))::bigint f from
    (select p.part, g.m.entry entry, unnest(range(1, len(v) + 1)) i, unnest(v) x from p join {b}a g using (vec_id, part)) group by 1, 2, 3) group by 1, 2) n on n.part = c.part and n.entry = c.entry),
"""


SQL += _round("c0", "c1") + _round("c1", "c2") + _round("c2", "c3", True) + """,
e as (select vec_id, string_agg(printf('%02x', m.entry), '' order by part) code, sum(m.d)::bigint error from c3a group by 1),
h as (select sha256(string_agg(t, ',' order by part, entry)) codebooks_sha256 from (select part, entry, array_to_string(v, ',') t from c2))
select e.vec_id, code, error, (sum(error) over (partition by k.label))::bigint label_error, codebooks_sha256 from e join k using (vec_id), h
"""
