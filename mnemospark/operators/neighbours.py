"""Exact neighbour joins over blocks that pivots form, with block pairs and rows left out by triangle bounds.

Rows are dealt to the cells of pivots (spread rows of a sample), and large cells to blocks.  Of each block the
driver keeps how far its rows lie from their pivot at most, and between which distances from a few
landmarks: lower bounds of the distance from any row to any row of the block.  Cosine is a distance of
vectors at unit length, so one bound serves both measures.  For the k nearest, a row first looks
in its own block, which says how near others must be, and then visits only blocks that may hold
such; within a radius, pairs of blocks are visited once, by the rows that may be near enough.

Blocks that lie near one another form groups, and two groups meet in one task: a row goes once to a
group, with the places in it of the blocks that it visits, not once to each of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .vectors import _matrix

#: Rows of a block, and blocks at most: beyond, blocks grow with the table.
BLOCK, MAX_BLOCKS = 4096, 1 << 15
#: Cells at most, landmarks, blocks' worth of rows in a group at most, blocks in it at most (bits of a long).
PIVOTS, LANDMARKS, GROUP, SLOTS = 1024, 16, 8, 62
#: Rows whose distances are found at once.
TILE = 1024
PAIR = "src long, dst long, score double"


@dataclass(frozen=True)
class Blocks:
    """Bounds of distances: of each block its pivot, its rows' greatest distance from it, and their least and greatest from the landmarks, which are the first pivots."""

    pivots: np.ndarray
    cell: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    slack: float
    group: np.ndarray
    slot: np.ndarray

    def distances(self, m: np.ndarray) -> np.ndarray:
        return distances(m, self.pivots)

    def bound(self, d: np.ndarray, of: np.ndarray) -> np.ndarray:
        """How far rows, whose distances from the pivots are d, are at least from every row of the blocks."""
        out = d[:, self.cell[of]] - self.radius[of]
        for k in range(self.low.shape[1]):
            out = np.maximum(out, np.maximum(self.low[of, k] - d[:, k : k + 1], d[:, k : k + 1] - self.high[of, k]))
        return out - self.slack

    def between(self, i: int) -> np.ndarray:
        """How far the rows of block i are at least from those of each block."""
        out = distances(self.pivots[self.cell[i]][None], self.pivots)[0][self.cell] - self.radius[i] - self.radius
        apart = np.maximum(self.low - self.high[i], self.low[i] - self.high)
        return np.maximum(out, apart.max(axis=1, initial=-np.inf)) - self.slack


    def calls(self, fits: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of what rows visit, a line for each of the blocks ``of``: (row, group, bits of the blocks' places in the group)."""
        if not len(of):
            return (np.zeros(0, np.int64),) * 3
        order = np.argsort(self.group[of], kind="stable")
        groups, first = np.unique(self.group[of][order], return_index=True)
        bits = np.add.reduceat(fits[:, order] * (1 << self.slot[of][order]), first, axis=1)
        x, y = np.nonzero(bits)
        return x, groups[y], bits[x, y]


def grouped(pivots: np.ndarray, cell: np.ndarray, rows: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(group, place in it) of each block: blocks around one of the first pivots, which are far apart, side by side, cut where a group would have over ``most`` rows."""
    order = np.lexsort([cell, distances(pivots, pivots[: 4 * LANDMARKS]).argmin(axis=1)[cell]])
    group, slot = np.zeros(len(cell), np.int64), np.zeros(len(cell), np.int64)
    at, places, held = 0, 0, 0.0
    for b in order.tolist():
        if places and (held + rows[b] > most or places == SLOTS):
            at, places, held = at + 1, 0, 0.0
        group[b], slot[b] = at, places
        places, held = places + 1, held + rows[b]
    return group, slot


def _slices(batches):
    for b in batches:
        for at in range(0, b.num_rows, TILE):
            yield b.slice(at, TILE)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def spread(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows of a sample, each as far as can be from those before it; equal rows once."""
    chosen, near = [0], distances(sample, sample[:1])[:, 0]
    while len(chosen) < most and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _scores(a: np.ndarray, b: np.ndarray, cosine: bool) -> np.ndarray:
    """What is to be least: squared L2, or cosine with its sign changed."""
    return -(a @ b.T) if cosine else np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _reach(score: np.ndarray, cosine: bool) -> np.ndarray:
    """The distance at which a score is met."""
    return np.sqrt(np.maximum(2 + 2 * score if cosine else score, 0))


def best(a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray, k: int, cosine: bool, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a its k best of b other than itself, within its reach: (place in a, place in b, score), in order of score and id.

    Each row's k-th score is found by selection; only what is as good is sorted.
    """
    out = []
    for t in range(0, len(a), TILE):
        s = _scores(a[t : t + TILE], b, cosine)
        s[ia[t : t + TILE, None] == ib[None]] = np.inf
        limit = np.full(len(s), np.inf)
        if reach is not None:
            # a score as far as the reach is let through with what rounding may have added to it
            r = reach[t : t + TILE]
            limit = ((r * r - 2) / 2 if cosine else r * r) + 1e-9 * (1 + r * r)
        crowded = np.flatnonzero((s <= limit[:, None]).sum(axis=1) > k) if s.shape[1] > k else np.zeros(0, int)
        if len(crowded):
            limit[crowded] = np.minimum(limit[crowded], np.partition(s[crowded], k - 1, axis=1)[:, k - 1])
        x, y = np.nonzero((s <= limit[:, None]) & (s < np.inf))
        order = np.lexsort([ib[y], s[x, y], x])
        x, y = x[order], y[order]
        first = np.searchsorted(x, x)
        keep = np.arange(len(x)) - first < k
        x, y = x[keep], y[keep]
        out.append((x + t, y, s[x, y]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _lists(x: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Values, in order of x, as a list for each of n rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(x, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _own(k: int, dim: int, cosine: bool):
    def run(t: pa.Table) -> pa.Table:
        ids, m = t.column("id").to_numpy(), _matrix(t.column("v"), dim)
        x, y, s = best(m, ids, m, ids, k, cosine)
        full = np.bincount(x, minlength=len(ids)) >= k
        last = np.full(len(ids), -np.inf)
        np.maximum.at(last, x, s)
        reach = np.where(full, _reach(np.where(full, last, 0), cosine), np.inf)
        return pa.table({"place": t.column("place"), "id": t.column("id"), "v": t.column("v"), "reach": reach, "dst": _lists(x, ids[y], len(ids), pa.int64()), "score": _lists(x, -s if cosine else s, len(ids), pa.float64())})

    return run


def _within(t: pa.Table, dim: int, cosine: bool, radius: float) -> pa.Table:
    """Both directions of the pairs within the radius, of the blocks of a group or of two groups, by the rows that visit each other's block."""
    side = t.column("is_left").to_numpy(zero_copy_only=False)
    ids, m, slot, bits = t.column("id").to_numpy(), _matrix(t.column("v"), dim), t.column("slot").to_numpy(), t.column("bits").to_numpy()
    alone = t.column("i")[0].as_py() == t.column("j")[0].as_py()
    left = {p: np.flatnonzero(side & (slot == p)) for p in np.unique(slot[side]).tolist()}
    right = left if alone else {p: np.flatnonzero(~side & (slot == p)) for p in np.unique(slot[~side]).tolist()}
    found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
    for p, mine in left.items():
        for q, others in right.items():
            same = alone and p == q
            if alone and q < p:
                continue
            one, two = mine[bits[mine] >> q & 1 > 0], others[bits[others] >> p & 1 > 0]
            b, ib = m[two], ids[two]
            for k in range(0, len(one) if len(two) else 0, TILE):
                ia = ids[one[k : k + TILE]]
                s = _scores(m[one[k : k + TILE]], b, cosine)
                x, y = np.nonzero(s <= radius)
                keep = (y > x + k) if same else np.ones(len(x), bool)
                keep &= ia[x] != ib[y]
                found.append((ia[x[keep]], ib[y[keep]], s[x[keep], y[keep]]))
    src, dst, s = (np.concatenate(c) for c in zip(*found))
    score = np.concatenate([s, s]) * (-1 if cosine else 1)
    return pa.table({"src": np.concatenate([src, dst]), "dst": np.concatenate([dst, src]), "score": score})


def placed(rows: DataFrame, dim: int, n: int, block: int) -> tuple[DataFrame, Blocks]:
    """(place, id, v): n rows dealt to blocks, written, and what bounds the blocks' distances.

    A sample of at most 4 PIVOTS rows and a line per block come to the driver.
    """
    size = max(block, math.ceil(n / MAX_BLOCKS))
    most = min(PIVOTS, math.ceil(n / size))
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(4 * most).select("v").collect()], np.float64).reshape(-1, dim)
    pivots = spread(sample, most)
    marks = min(LANDMARKS, len(pivots))

    def to_cells(batches):
        for b in _slices(batches):
            m = _matrix(b.column(1), dim)
            cell = distances(m, pivots).argmin(axis=1) if len(m) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column(0), b.column(1)], ["cell", "id", "v"])

    dealt = written(rows.select("id", "v").mapInArrow(to_cells, "cell int, id long, v array<double>"))
    count = {r["cell"]: r["n"] for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = [math.ceil(count.get(c, 0) / size) for c in range(len(pivots))]
    first = np.concatenate([[0], np.cumsum(parts)])
    at = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("cell"))
    out = dealt.select((at(first[:-1]) + F.pmod(F.xxhash64("id"), at(parts))).cast("int").alias("place"), "id", "v")
    cell = np.repeat(np.arange(len(pivots)), parts)

    def ends(batches):
        low: dict[int, np.ndarray] = {}
        for b in _slices(batches):
            place, d = b.column(0).to_numpy(), distances(_matrix(b.column(1), dim), pivots)
            for p in np.unique(place).tolist():
                mine = d[place == p]
                own = mine[:, cell[p]].max()
                new = np.concatenate([mine[:, :marks].min(axis=0), -mine[:, :marks].max(axis=0), [-own]])
                low[p] = np.minimum(low[p], new) if p in low else new
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), pa.array([v.tolist() for v in low.values()], pa.list_(pa.float64()))], ["place", "low"])

    rows = out.select("place", "v").mapInArrow(ends, "place int, low array<double>").groupBy("place").agg(F.array(*[F.min(F.get("low", F.lit(k))) for k in range(2 * marks + 1)]).alias("low")).collect()
    low = np.full((len(cell), 2 * marks + 1), np.inf)
    for r in rows:
        low[r["place"]] = r["low"]
    scale = float(np.abs(low[:, : 2 * marks]).max(initial=0)) + float(np.sqrt((pivots * pivots).sum(axis=1)).max(initial=0))
    held = np.array([count.get(c, 0) / parts[c] for c in cell.tolist()])
    group, slot = grouped(pivots, cell, held, size * min(GROUP, math.ceil(len(cell) / 8)))
    return out, Blocks(pivots, cell, -low[:, -1], low[:, :marks], -low[:, marks:-1], 1e-6 * scale, group, slot)


def _nearest(rows: DataFrame, blocks: Blocks, dim: int, k: int, cosine: bool) -> DataFrame:
    own = written(rows.groupBy("place").applyInArrow(_own(k, dim, cosine), "place int, id long, v array<double>, reach double, dst array<long>, score array<double>"))
    reach = np.full(len(blocks.cell), -np.inf)
    for r in own.groupBy("place").agg(F.max("reach").alias("reach")).collect():
        reach[r["place"]] = r["reach"]

    names = ["target", "source", "id", "v", "reach", "bits"]

    def visits(batches):
        """Rows as questions to the groups in which blocks may hold nearer ones."""
        for b in _slices(batches):
            place, need, m = b.column(0).to_numpy(), b.column(3).to_numpy(), _matrix(b.column(2), dim)
            d = blocks.distances(m)
            for p in np.unique(place).tolist():
                mine = np.flatnonzero(place == p)
                of = np.flatnonzero(blocks.between(p) <= reach[p])
                of = of[of != p]
                x, target, bits = blocks.calls(blocks.bound(d[mine], of) <= need[mine, None], of)
                part = b.take(pa.array(mine[x]))
                yield pa.RecordBatch.from_arrays([pa.array(target, pa.int32()), pa.array(np.full(len(x), blocks.group[p]), pa.int32()), part.column(1), part.column(2), part.column(3), pa.array(bits, pa.int64())], names)

    def hosts(batches):
        """A block's rows, for each group of blocks of which some may visit it; their bits are the block's place in its group."""
        for b in _slices(batches):
            place = b.column(0).to_numpy()
            for p in np.unique(place).tolist():
                of = np.flatnonzero(blocks.between(p) <= reach)
                sources = np.unique(blocks.group[of[of != p]])
                mine = np.flatnonzero(place == p)
                part = b.take(pa.array(np.tile(mine, len(sources))))
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, blocks.group[p]), pa.int32()), pa.array(np.repeat(sources, len(mine)), pa.int32()), part.column(1), part.column(2), pa.nulls(n, pa.float64()), pa.array(np.full(n, blocks.slot[p]), pa.int64())], names)

    def meet(t: pa.Table) -> pa.Table:
        """The k best of a group's rows for each row that visits it, block after block: what is found says how near others must be."""
        reach = t.column("reach").to_numpy()
        ids, m, bits = t.column("id").to_numpy(), _matrix(t.column("v"), dim), t.column("bits").to_numpy()
        asks, held = np.flatnonzero(~np.isnan(reach)), np.flatnonzero(np.isnan(reach))
        slots = [(p, held[bits[held] == p]) for p in np.unique(bits[held]).tolist()]
        slots = [(p, at, m[at]) for p, at in slots]
        out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
        for k0 in range(0, len(asks), 4 * TILE):
            rows = asks[k0 : k0 + 4 * TILE]
            need = reach[rows]
            x, y, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for p, at, b in slots:
                mine = np.flatnonzero(bits[rows] >> p & 1)
                fx, fy, fs = best(m[rows[mine]], ids[rows[mine]], b, ids[at], k, cosine, need[mine])
                x, y, s = np.concatenate([x, mine[fx]]), np.concatenate([y, at[fy]]), np.concatenate([s, fs])
                order = np.lexsort([ids[y], s, x])
                x, y, s = x[order], y[order], s[order]
                nth = np.arange(len(x)) - np.searchsorted(x, x)
                last = nth == k - 1
                need[x[last]] = np.minimum(need[x[last]], _reach(s[last], cosine))
                x, y, s = x[nth < k], y[nth < k], s[nth < k]
            out.append((ids[rows[x]], ids[y], s))
        src, dst, s = (np.concatenate(c) for c in zip(*out))
        return pa.table({"src": src, "dst": dst, "score": -s if cosine else s})

    kind = "target int, source int, id long, v array<double>, reach double, bits long"
    met = own.select("place", "id", "v", "reach").mapInArrow(visits, kind).union(own.select("place", "id", "v").mapInArrow(hosts, kind)).groupBy("target", "source").applyInArrow(meet, PAIR)
    return _ranked(_first(own).union(met), k, cosine)


def _first(own: DataFrame) -> DataFrame:
    return own.select(F.col("id").alias("src"), F.explode(F.arrays_zip("dst", "score")).alias("x")).select("src", "x.dst", "x.score")


def _ranked(pairs: DataFrame, k: int, cosine: bool) -> DataFrame:
    order = Window.partitionBy("src").orderBy(F.desc("score") if cosine else F.col("score"), "dst")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _near(rows: DataFrame, blocks: Blocks, dim: int, radius: float, cosine: bool) -> DataFrame:
    reach = float(_reach(np.float64(radius), cosine))

    def pairs(batches):
        """Each row, once for every pair of groups in which it may have a partner."""
        for b in _slices(batches):
            place, m = b.column(0).to_numpy(), _matrix(b.column(2), dim)
            d = blocks.distances(m)
            for p in np.unique(place).tolist():
                mine, own = np.flatnonzero(place == p), blocks.group[p]
                of = np.flatnonzero(blocks.between(p) <= reach)
                x, other, bits = blocks.calls((blocks.bound(d[mine], of) <= reach) | (of == p), of)
                part = b.take(pa.array(mine[x]))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own, other), pa.int32()), pa.array(np.maximum(own, other), pa.int32()), pa.array(own <= other), pa.array(np.full(len(x), blocks.slot[p]), pa.int64()), pa.array(bits, pa.int64()), part.column(1), part.column(2)], ["i", "j", "is_left", "slot", "bits", "id", "v"])

    kind = "i int, j int, is_left boolean, slot long, bits long, id long, v array<double>"
    return rows.mapInArrow(pairs, kind).groupBy("i", "j").applyInArrow(lambda t: _within(t, dim, cosine, radius), PAIR)


def neighbours(df: DataFrame, dim: int, k: int | None = None, radius: float | None = None, metric: str = "cosine", id_col: str = "id", vec_col: str = "vector", block: int = BLOCK) -> DataFrame:
    """(src, dst, score) for each row's k nearest other rows (with their rank), or all within ``radius``; exact.

    score is cosine (k best highest, radius a least value) or squared L2 (lowest, a greatest
    value); ties by id.  Rows of another length, and rows with a null id, are left out; rows of one id are no partners.  A
    table of up to ``block`` rows is one task; beyond, blocks are formed and visited as the module's text says.
    """
    cosine = metric == "cosine"
    x = F.col(vec_col).cast("array<double>")
    rows = df.where((F.size(vec_col) == dim) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("v"))

    def unit(batches):
        for b in batches:
            m = _matrix(b.column(1), dim)
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, dim), pa.int32()), pa.array(m.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], ["id", "v"])

    # written once: what makes the vectors may be dear, and they are read again
    rows = written(rows.mapInArrow(unit, "id long, v array<double>") if cosine else rows)
    n = rows.count()
    limit = None if radius is None else -radius if cosine else radius
    if n <= block:
        if k is None:
            one = rows.select(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("is_left"), F.lit(0).cast("long").alias("slot"), F.lit(1).cast("long").alias("bits"), "id", "v")
            return one.groupBy("i", "j").applyInArrow(lambda t: _within(t, dim, cosine, limit), PAIR)
        own = rows.withColumn("place", F.lit(0)).groupBy("place").applyInArrow(_own(k, dim, cosine), "place int, id long, v array<double>, reach double, dst array<long>, score array<double>")
        found = own.select(F.col("id").alias("src"), F.posexplode(F.arrays_zip("dst", "score")).alias("p", "x"))
        return found.select("src", "x.dst", "x.score", (F.col("p") + 1).alias("rank"))
    rows, blocks = placed(rows, dim, n, block)
    return _near(rows, blocks, dim, limit, cosine) if k is None else _nearest(rows, blocks, dim, k, cosine)
