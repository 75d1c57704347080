"""Fast and slow tiers: admission, expiry, promotion; Bloom prefilter of ids."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import fresh_name
from . import vectors as V


def fast_add(df: DataFrame, as_of: float, ttl_hours: float = 24.0) -> DataFrame:
    """Memories as rows of the fast tier, at unit length, until they expire."""
    return df.select(F.col("id").alias("memory_id"), V.normalized(F.col("vector")).alias("vector"), "text", F.lit(float(as_of)).alias("timestamp"), F.lit(as_of + ttl_hours * 3600).alias("expires_at"), F.coalesce("importance_score", F.lit(1.0)).alias("importance"))


def evict_expired(fast: DataFrame, as_of: float) -> DataFrame:
    """The fast tier without what has expired."""
    return fast.where(F.col("expires_at") >= as_of)


def promote_hot(slow: DataFrame, fast: DataFrame, as_of: float, least: int = 100, ttl_hours: float = 48.0) -> DataFrame:
    """Rows of the fast tier for memories read more than ``least`` times that are not in it."""
    hot = slow.where(F.col("access_counter") > least).join(fast.select(F.col("memory_id").alias("id")), "id", "left_anti")
    return hot.select(F.col("id").alias("memory_id"), F.least(F.lit(5.0), 1 + F.col("access_counter") / 100).alias("importance"), F.lit(as_of + ttl_hours * 3600).alias("expires_at"))


def flush(fast: DataFrame, slow: DataFrame, most: int) -> DataFrame:
    """The slow tier with the fast one's memories, if that has more than ``most``."""
    moved = fast.select(F.col("memory_id").alias("id"), "text")
    if fast.limit(most + 1).count() <= most:
        return slow.select("id", "text")
    return slow.select("id", "text").union(moved.join(slow.select("id"), "id", "left_anti"))


def bloom_size(n: int, p: float = 0.01) -> tuple[int, int]:
    """Bits and hashes of a Bloom filter of n entries at false-positive rate p."""
    bits = max(1, int(-n * math.log(p) / math.log(2) ** 2))
    return bits, max(1, int(bits / max(n, 1) * math.log(2)))


def _places(bits: int, hashes: int) -> Column:
    """Where an id's bits are."""
    return F.array(*[F.pmod(F.xxhash64(F.col("id").cast("long"), F.lit(k)), F.lit(bits)) for k in range(hashes)])


def bloom_bits(members: DataFrame, bits: int, hashes: int) -> np.ndarray:
    """The filter of the members' ids, eight bits a byte; tasks' bits are merged into blocks of 4 KB, which alone come to the driver."""
    place = members.select(F.explode(_places(bits, hashes)).alias("p")).select((F.col("p") + 1).alias("p"))
    found = place.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("part")).collect()
    packed = np.zeros((bits // 32768 + 1, 4096), np.uint8)
    for r in found:
        packed[r["bucket"] - 1] = np.frombuffer(r["part"], np.uint8)
    return packed.reshape(-1)


def bloom_prefilter(df: DataFrame, members: DataFrame, n: int, p: float = 0.01) -> DataFrame:
    """Rows whose id may be among ``members``: all that are, and a share p of others.

    The filter's size is fixed by n (120 MB for 10^8 ids at 0.01); ids are hashed in the JVM, and tasks look
    their places up in the broadcast bits.  Null ids pass where a member's is null.
    """
    bits, hashes = bloom_size(n, p)
    held = df.sparkSession.sparkContext.broadcast(bloom_bits(members, bits, hashes))

    def keep(batches):
        packed = held.value
        for b in batches:
            at = b.column(b.num_columns - 1).flatten().to_numpy().reshape(-1, hashes)
            own = b.select(list(range(b.num_columns - 1)))
            yield own.filter(pa.array(((packed[at >> 3] >> (at & 7)) & 1).all(axis=1)))

    return df.withColumn(fresh_name(df, "places"), _places(bits, hashes)).mapInArrow(keep, df.schema)
