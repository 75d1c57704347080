"""Folds over the sorted rows of each key, in Arrow batches: what a batch hands to the next is one open key."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows after which a fold hands over what it has made.
EMIT = 4096


def folded(rows: DataFrame, key: str, columns: list[str], new: Callable, step: Callable[..., Iterable[tuple]], end: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Each key's rows, in order of ``columns``, through a fold of its own: ``new()`` begins it, ``step(own, row)`` and ``end(own)`` give rows, as tuples without the key.

    Time is that of a sort; memory is a batch, what ``own`` keeps, and EMIT rows, however many rows a key has.  Null keys are one key.
    """
    spark = rows.sparkSession
    kind = spark.createDataFrame([], schema).schema
    names = kind.names
    rows = rows.select(key, *columns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key, *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = [f.type for f in to_arrow_schema(kind)]
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
        held, own, out = None, None, []
        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns)):
                if held != (k,):
                    if held:
                        out += [(*held, *r) for r in end(own)]
                    held, own = (k,), new()
                out += [(k, *r) for r in step(own, row)]
                if len(out) >= EMIT:
                    yield batch(out)
                    out = []
        if held:
            out += [(*held, *r) for r in end(own)]
        yield batch(out)

    return rows.mapInArrow(run, schema)
