"""SimHash fingerprints and their links by the generalised pigeonhole principle.

Bits that go together are put in one part, so that parts differ in how much they
tell; thresholds that add up to ``distance - parts + 1`` are given to the parts by
dynamic programming on estimated candidates and signatures (-1 leaves a part out).
Two fingerprints within ``distance`` agree within the threshold of at least one part, so
they share one of its signatures: the part's value with up to that many bits
masked.  Fingerprints of a signature are compared in blocks of bounded size, and
only a spanning forest of each block's links goes on.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _exchange as X
from .components import connected_components

BITS = 64
#: Fingerprints compared at once; a signature with more is split into blocks that meet in pairs.
BLOCK = 512
#: Rows of one fingerprint that a task names.
HOT = 1 << 20


def fingerprint(text: str | None, shingle: int = 3) -> int:
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(min(shingle, len(words))))))
    h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, more: tuple[str, Column] | None = None) -> DataFrame:
    """(id, fp) for each row; fp is the fingerprint's 64 bits as a long, 0 for texts without words.  ``more``: a name and a long that go along."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], ["id", "fp", *names])

    names = [more[0]] if more else []
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *([more[1].alias(more[0])] if more else []))
    return rows.mapInArrow(run, "id long, fp long" + "".join(f", {c} long" for c in names))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each two bits in how many both are set: 65 rows, whatever the input."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS + 1), pa.int32()), pa.array([*both.tolist(), [n] + [0] * (BITS - 1)], pa.list_(pa.int64()))], ["i", "row"])

    rows = fps.select("fp").mapInArrow(run, "i int, row array<long>").select("i", F.posexplode("row").alias("j", "n")).groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS + 1, BITS), np.int64)
    for r in rows:
        both[r.i, r.j] = r.n
    return int(both[BITS, 0]), both[:BITS]


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of like width: each takes the bit left with least entropy, then again and again the bit that goes most with what it has."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        part = [min(left, key=lambda b: (-abs(p[b] - 0.5), b))]
        left.remove(part[0])
        while len(part) < size:
            best = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        out.append(sorted(part))
    return out


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, one per part, that add up to ``total`` at least cost; costs[i][t + 1] is part i's at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(row, -1):
                if s + t not in new or c + x < new[s + t][0]:
                    new[s + t] = (c + x, [*ts, t])
        best = new
    return best[total]


def _values(part: list[int]):
    """The bits of a part of column fp, each at its own place."""
    return F.col("fp").bitwiseAND(F.lit(int(np.array(sum(1 << b for b in part), np.uint64).view(np.int64))))


def plan(fps: DataFrame, distance: int, choices: tuple[int, ...] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """The parts and thresholds of least estimated cost: pairs that share a signature, and signatures made.

    Pairs with equal values are counted for each part over all fingerprints; pairs within
    t bits are those times what independent bits would add.
    """
    n, both = bit_statistics(fps)
    p = np.diag(both) / max(n, 1)
    odds = 2 * p * (1 - p) / np.maximum(1 - 2 * p * (1 - p), 1e-9)
    found = []
    layouts = [group_bits(n, both, m) for m in choices if m <= distance + 1]
    parts = [part for layout in layouts for part in layout]
    keys = F.array(*[F.struct(F.lit(i).alias("i"), _values(part).alias("v")) for i, part in enumerate(parts)])
    pairs = dict(fps.select(F.explode(keys).alias("k")).groupBy("k.i", "k.v").count().groupBy("i").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2)).collect())
    at = 0
    for layout in layouts:
        costs = []
        for part in layout:
            e = np.zeros(distance + 1)
            e[0] = 1
            for b in part:
                e[1:] += e[:-1] * odds[b]
            costs.append([0.0] + [pairs.get(at, 0.0) * e[: t + 1].sum() + 4.0 * max(n, 1) * comb(len(part), t) for t in range(distance + 1)])
            at += 1
        cost, ts = allot(costs, distance - len(layout) + 1)
        found.append((cost, [(part, t) for part, t in zip(layout, ts) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def signatures(fps: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """(key, fp): each part's value with each choice of as many bits as its threshold masked, hashed with its place."""
    made = []
    for i, (part, t) in enumerate(chosen):
        for j, masked in enumerate(combinations(part, t)):
            made.append(F.xxhash64(F.lit(i), F.lit(j), _values(sorted(set(part) - set(masked)))))
    return fps.select("fp", F.explode(F.array(*made)).alias("key"))


def links(fps: DataFrame, distance: int) -> DataFrame:
    """(a, b): links between distinct fingerprints within ``distance`` bits, enough of them to join all that are linked."""
    keys = signatures(fps, plan(fps, distance))
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rows = keys.join(sizes, "key")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    # block i meets block j once for each i <= j: a fingerprint goes to (min, max) of its own block and every block
    meets = F.when(blocks == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j"))))
    dealt = rows.select("key", "fp", F.explode(meets).alias("m")).select(F.xxhash64("key", "m.i", "m.j").alias("cell"), "fp")
    n = X.width(fps.sparkSession)

    def differing(a, b):
        return np.bitwise_count((a ^ b).view(np.uint64))  # of a negative number it would count the bits of its magnitude

    def forest(fp: np.ndarray):
        top = np.arange(len(fp))

        def root(i):
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        for i in range(1, len(fp)):
            for j in np.flatnonzero(differing(fp[:i], fp[i]) <= distance):
                x, y = root(i), root(j)
                if x != y:
                    top[max(x, y)] = min(x, y)
                    yield fp[j], fp[i]

    def compare(batches):
        held_cell, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def flush(cell, fp):
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(cell))
            size = ends - starts
            a, b = [], []
            two = starts[size == 2]  # most cells
            near = two[differing(fp[two], fp[two + 1]) <= distance]
            a.extend(fp[near].tolist())
            b.extend(fp[near + 1].tolist())
            for i, j in zip(starts[size > 2], ends[size > 2]):
                for x, y in forest(np.unique(fp[i:j])):
                    a.append(int(x))
                    b.append(int(y))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            cell, fp = (np.concatenate([h, c.to_numpy()]) for h, c in zip((held_cell, held_fp), batch.columns))
            last = np.searchsorted(cell, cell[-1]) if len(cell) else 0
            held_cell, held_fp = cell[last:], fp[last:]
            yield flush(cell[:last], fp[:last])
        yield flush(held_cell, held_fp)

    return dealt.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long").distinct()


def _grouped(fps: DataFrame, distance: int) -> DataFrame:
    """``fps`` with component_id: the smallest id that links of each fingerprint reach."""
    nodes = X.written(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    groups = connected_components(links(nodes.select("fp"), distance), "a", "b")
    named = nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    members = X.written(named.select("fp", "n", "component").join(names, "component").select("fp", "n", "component_id"))
    # rows of a fingerprint that very many texts share go to many tasks, by their places, which null and repeated ids have too: at most one such fingerprint for HOT rows
    hot = members.where(F.col("n") > HOT).select("fp", F.ceil(F.col("n") / HOT).cast("int").alias("blocks"))
    dealt = fps.join(F.broadcast(hot), "fp", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("blocks")), F.lit(0)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / HOT) - 1).cast("int")))
    return dealt.drop("blocks").join(members.select("fp", "component_id", copies.alias("salt")), ["fp", "salt"]).drop("salt")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """Fingerprint and group of every row: ``(doc_id, fingerprint, component_id)``.

    Words are runs of characters other than ASCII white space, A-Z lower-cased, in
    shingles of ``shingle``; a shorter text is one shingle, a text without words (null, empty)
    has fingerprint zero and is linked like any other.  Rows whose fingerprints differ in at
    most ``distance`` bits are linked; ``component_id`` is the smallest doc_id that links reach.
    Equal fingerprints are one node whatever their number.  Rows with a null id are in
    groups too, but never name one: component_id is null if no id is reached.  Repeated rows
    are returned each; an empty table gives no rows; other columns are not read.
    """
    found = _grouped(X.written(fingerprints(docs, id_col, text_col, shingle)), distance)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs``, of each near-duplicate group only those with its smallest id.

    Rows whose id is null all stay.  Of an id that several rows have, those rows go whose own
    text has a smaller id in its group; equal rows share one fate.  Null and empty texts are one
    group.  All columns stay as they are; an empty table gives no rows.
    """
    digest, i = X.fresh(docs, "text_digest"), X.fresh(docs, "gone_id")
    fps = X.written(fingerprints(docs, id_col, text_col, shingle, ("digest", F.xxhash64(F.col(text_col)))))
    gone = _grouped(fps, distance).where(F.col("id") != F.col("component_id")).select(F.col("id").alias(i), F.col("digest").alias(digest)).distinct()
    return docs.join(gone, (docs[id_col] == gone[i]) & (F.xxhash64(docs[text_col]) == gone[digest]), "left_anti")
