"""Document fingerprints from modular prefix arrays of polynomial hashes.

The prefix array of a text holds, at place i, the sum of c_j B^j modulo P over its first i code
points.  The difference of two places, times a power of B, is the hash of the span between
them whatever lies around it, so one pass over a text answers any question "are these spans
equal", and halving finds how far two texts agree from two places on.

A fingerprint is made of entries of these arrays: the length, the whole text's hash (four
bases, 124 bits), *marks* (hashes of the first and of the last g code points, for g on a
grid that grows by a fourth of an octave), and a *sample*: the least hashes of all spans of
SPAN code points.  Marks of equal spans are equal, and longer ones differ once shorter ones do, so
halving over the marks of two fingerprints finds how much of the two texts' beginnings and
ends agree at least; the samples estimate the share of spans that they have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._exchange import from_blob, to_blob, width

P = (1 << 31) - 1
#: Parameters: a base for each lane, the code points of a sampled span, and how many spans are sampled.
BASES = (1_226_959_873, 389_140_021, 1_846_001_057, 712_033_267)
SPAN, SAMPLE = 24, 64
#: Hexadecimal digits of a length and of each entry.
WIDE, MARK = 10, 6
#: Code points that are hashed at once: the bound of what a very long text takes beside its prefix array.
BLOCK = 1 << 16
POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
GRID = np.unique(np.rint(2 ** (np.arange(4 * 40) / 4)).astype(np.int64))


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo P, for x below 2^62: P is a Mersenne number."""
    x = (x & P) + (x >> 31)
    return np.minimum(x, x - P)  # the difference wraps around where x is smaller


def _tables(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base from 0 to BLOCK - 1, and those of its BLOCK-th power: together they reach BLOCK^2.  A process makes them once."""

    def powers(x: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < BLOCK:
            out = np.concatenate([out, _mod(out * pow(x, len(out), P))])
        return out

    if base not in POWERS:
        POWERS[base] = powers(base), powers(pow(base, BLOCK, P))
    return POWERS[base]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _blocks(points: np.ndarray, base: int) -> Iterator[tuple[int, np.ndarray]]:
    """The prefix array without its first entry, block by block; each code point is raised by one, so that none counts nothing."""
    low, high = _tables(base)
    carry = 0
    for k in range(0, len(points), BLOCK):
        part = points[k : k + BLOCK].astype(np.uint64) + 1
        x = _mod(np.cumsum(_mod(part * low[: len(part)])))
        x = _mod(x * high[k // BLOCK] + carry)
        carry = int(x[-1])
        yield k, x


def prefixes(points: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """The prefix array of a text: one entry more than it has code points, four bytes each."""
    out = np.zeros(len(points) + 1, np.uint32)
    for k, x in _blocks(points, base):
        out[k + 1 : k + 1 + len(x)] = x
    return out


def whole(points: np.ndarray, base: int) -> int:
    """The last entry of the prefix array alone; products of 52 bits are summed by 2048 before they are reduced."""
    low, high = _tables(base)
    total = 0
    for k in range(0, len(points), BLOCK):
        part = points[k : k + BLOCK].astype(np.uint64) + 1
        sums = np.add.reduceat(part * low[: len(part)], np.arange(0, len(part), 2048))
        total += int(_mod(sums & P).sum() + _mod(sums >> 31).sum()) % P * int(high[k // BLOCK]) % P
    return total % P


def appended(array: np.ndarray, n: int, other: np.ndarray, m: int, base: int = BASES[0]) -> np.ndarray:
    """The prefix array of the first n code points of one text and the first m of another, from their prefix arrays."""
    low, high = _tables(base)
    shift = int(low[n & (BLOCK - 1)]) * int(high[n // BLOCK]) % P
    return np.concatenate([array[: n + 1], _mod(other[1 : m + 1].astype(np.uint64) * shift + int(array[n])).astype(np.uint32)])


def spans(array: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hashes of the spans from start to end, as if each began a text: equal spans have equal hashes, wherever they are."""
    low, high = _tables(pow(base, P - 2, P))
    part = _mod(array[end].astype(np.uint64) + P - array[start])
    return _mod(_mod(part * low[start & (BLOCK - 1)]) * high[start >> 16])


def common_extension(a: list[np.ndarray], i: int, b: list[np.ndarray], j: int) -> int:
    """How many code points from places i and j on two texts share, by halving over their prefix arrays (one for each base)."""
    low, high = 0, max(0, min(len(a[0]) - 1 - i, len(b[0]) - 1 - j))
    while low < high:
        mid = (low + high + 1) // 2
        same = all(spans(x, np.array([i]), np.array([i + mid]), base)[0] == spans(y, np.array([j]), np.array([j + mid]), base)[0] for x, y, base in zip(a, b, BASES))
        low, high = (mid, high) if same else (low, mid - 1)
    return low


def _hex(values, digits: int) -> str:
    return "".join(f"{v:016x}"[-digits:] for v in np.asarray(values).tolist())


def _sample(array: np.ndarray) -> np.ndarray:
    """The least SAMPLE distinct hashes of a text's spans; a multiplication spreads them, so that the least are a fair draw of all."""
    low, high = _tables(pow(BASES[0], P - 2, P))
    least, n = np.zeros(0, np.uint64), len(array) - SPAN
    for k in range(0, n, BLOCK):
        m = min(n - k, BLOCK)
        inner = (array[k + SPAN : k + SPAN + m].astype(np.uint64) + P - array[k : k + m]) * low[:m]
        inner = _mod(_mod((inner & P) + (inner >> 31)) * (int(high[k // BLOCK]) * BASES[1] % P))
        bound = 4 * SAMPLE * P // m
        while True:
            found = np.unique(np.concatenate([least, inner[inner <= bound]]))[:SAMPLE]
            if len(found) == SAMPLE and found[-1] <= bound or bound >= P:
                break
            bound *= 8
        least = found
    return least


class Printed:
    """A text's prefix array and fingerprint: ``length, whole - marks of beginnings - marks of ends - sample``, in hexadecimal digits of fixed widths."""

    def __init__(self, points: np.ndarray, array: np.ndarray | None = None):
        self.points, self.array = points, prefixes(points) if array is None else array
        n, first = len(points), self.array
        every = [first[n], *(whole(points, base) for base in BASES[1:])]
        grid = GRID[: np.searchsorted(GRID, n, side="right")]
        ends = spans(first, n - grid, np.full(len(grid), n))
        self.text = "-".join((_hex([n], WIDE) + _hex(every, 8), _hex(first[grid], MARK), _hex(ends, MARK), _hex(_sample(first), 8)))

    def spliced(self, following: Printed) -> Printed:
        """That of this text with its last third (rounded down) replaced by as much, or all, of the beginning of another; both prefix arrays are used as they are."""
        cut = len(self.points) // 3
        keep, new = len(self.points) - cut, min(cut, len(following.points))
        return Printed(np.concatenate([self.points[:keep], following.points[:new]]), appended(self.array, keep, following.array, new))


def fingerprint(text: str) -> str:
    return Printed(code_points(text)).text


def _agree(a: str, b: str) -> int:
    """The greatest g of the grid whose marks agree, by halving."""
    low, high = 0, min(len(a), len(b)) // MARK
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[(mid - 1) * MARK : mid * MARK] == b[(mid - 1) * MARK : mid * MARK] else (low, mid - 1)
    return int(GRID[low - 1]) if low else 0


def likeness(a: str, b: str) -> float:
    """How alike the texts of two fingerprints are, from 0 to 1; 1 for equal fingerprints only.

    The greater of two shares: what their beginnings and ends have in common at least, of the longer text,
    and 2 J / (1 + J) for J the estimated share of common spans, which is at most the shorter's share of the longer.
    """
    if a == b:
        return 1.0
    (head_a, *marks_a, sample_a), (head_b, *marks_b, sample_b) = a.split("-"), b.split("-")
    n, m = sorted((int(head_a[:WIDE], 16), int(head_b[:WIDE], 16)))
    if not n:
        return 0.0
    ends = min(n, sum(_agree(x, y) for x, y in zip(marks_a, marks_b)))
    x, y = ({s[k : k + 8] for k in range(0, len(s), 8)} for s in (sample_a, sample_b))
    least = sorted(x | y)[:SAMPLE]
    j = sum(k in x and k in y for k in least) / len(least) if x and y else 0.0
    return max(min(ends, m - 1) / m, min(2 * j / (1 + j), n / m, (m - 1) / m))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each row, without a shuffle.

    Null texts are empty; null ids and repeated rows stay, each with its fingerprint; an empty table gives no rows; other columns are not read.
    """

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(fingerprint, texts), pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def equal_spans(a: Column, i: Column, b: Column, j: Column, n: Column) -> Column:
    """Whether n code points from place i of a are those from place j of b, both counted from 0; false past an end or for nulls."""

    def run(a_, i_, b_, j_, n_):
        out = []
        for x, p, y, q, k in zip(*(c.to_pylist() for c in (a_, i_, b_, j_, n_))):
            good = None not in (x, p, y, q, k) and min(p, q, k) >= 0 and p + k <= len(x) and q + k <= len(y)
            out.append(bool(good and all(spans(prefixes(code_points(x), h), np.array([p]), np.array([p + k]), h)[0] == spans(prefixes(code_points(y), h), np.array([q]), np.array([q + k]), h)[0] for h in BASES)))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")(a, i, b, j, n)


def extensions(pairs: DataFrame, a_col: str, b_col: str, i_col: str | None = None, j_col: str | None = None) -> DataFrame:
    """pairs with ``extension``: how many code points the texts share from places i and j (from 0; the beginnings where no columns are named) on.

    0 for null texts and places, and for places outside a text; in place of a column named ``extension``.
    """

    def run(a_, b_, i_, j_):
        out = []
        for x, y, p, q in zip(*(c.to_pylist() for c in (a_, b_, i_, j_))):
            good = x is not None and y is not None and p is not None and q is not None and 0 <= p <= len(x) and 0 <= q <= len(y)
            arrays = [[prefixes(code_points(t), h) for h in BASES] for t in (x, y)] if good else None
            out.append(common_extension(arrays[0], p, arrays[1], q) if arrays else 0)
        return pa.array(out, pa.int64())

    place = lambda c: (F.col(c) if c else F.lit(0)).cast("long")
    return pairs.withColumn("extension", F.arrow_udf(run, "bigint")(F.col(a_col), F.col(b_col), place(i_col), place(j_col)))


def spliced(text: str, following: str) -> str:
    """The text, its last third (rounded down) replaced by as much, or all, of the beginning of what follows."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _cuts(rows: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Ids that cut the rows into ``n`` ranges of about equal numbers, and how many ranges more the null ids fill."""
    shares = F.array(*[F.lit(k / n) for k in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    found = rows.agg(F.percentile_approx("id", shares, F.lit(max(10_000, 20 * n))).alias("cuts"), F.count("*").alias("n"), F.count("id").alias("known")).first()
    cuts = np.array((found["cuts"] or [])[: n - 1], np.int64)
    return cuts, -(-n * (found["n"] - found["known"]) // max(1, found["n"])) if found["n"] else 0


def _range_of(ids: pa.Array, digests: np.ndarray, cuts: np.ndarray, loose: int) -> np.ndarray:
    """The range of each row, in rising order of id, then digest: null ids, an id's rows over all ranges that it fills by itself."""
    null = np.asarray(ids.is_null())
    known = ids.fill_null(0).to_numpy()
    low, high = np.searchsorted(cuts, known, "left"), np.searchsorted(cuts, known, "right")
    wide = np.maximum(1, high - low)
    share = (digests.astype(np.float64) / 2**64 + 0.5).clip(0, 1 - 2**-52)
    return np.where(null, (share * max(1, loose)).astype(np.int64), loose + low + (share * wide).astype(np.int64))


def _packed(rows: DataFrame, cuts: np.ndarray, loose: int, heads: dict[int, tuple]) -> DataFrame:
    """(range, blob): rows by range, compressed; the first row of a range goes to the range before it in the walk, too.  Equal rows of a batch travel once."""
    to: dict[tuple, list[int]] = {}
    order = sorted(heads, reverse=True)
    for k, r in enumerate(order):
        to.setdefault(heads[r], []).append(order[k - 1])

    def run(batches):
        for b in batches:
            ids, digests = b.column(0), b.column(1).to_numpy()
            parts = _range_of(ids, digests, cuts, loose)
            keys = list(zip(ids.to_pylist(), digests.tolist()))
            once: dict[tuple, list[int]] = {}
            for k, key in enumerate(keys):
                once.setdefault(key, []).append(k)
            groups: dict[int, list[tuple[int, int, bool]]] = {}
            for key, at in once.items():
                kinds: dict[str | None, list[int]] = {}
                for k in at if len(at) > 1 else ():
                    kinds.setdefault(b.column(2)[k].as_py(), []).append(k)
                for same in kinds.values() if kinds else (at,):
                    groups.setdefault(int(parts[same[0]]), []).append((same[0], len(same), False))
                    for r in to.get(key, ()):
                        groups.setdefault(r, []).append((same[0], 1, True))
            for r, made in groups.items():
                part = b.take(pa.array([k for k, _, _ in made]))
                blob = to_blob(id=part.column(0), digest=part.column(1), text=part.column(2), copies=pa.array([c for _, c, _ in made], pa.int64()), ahead=pa.array([a for _, _, a in made], pa.bool_()))
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([blob], pa.binary())], ["range", "blob"])

    return rows.mapInArrow(run, "range int, blob binary")


def _walk(table: pa.Table) -> Iterator[tuple[int | None, str, int, str]]:
    """(id, text, copies, following text) of a range's distinct rows in falling order."""
    rows = pa.concat_tables([from_blob(b.as_py()) for b in table.column("blob")])
    ids, digests, ahead, copies = (rows.column(c).to_pylist() for c in ("id", "digest", "ahead", "copies"))
    text = lambda k: rows.column("text")[k].as_py() or ""
    rank = lambda k: (ids[k] is not None, ids[k] or 0, digests[k])
    tied = {}
    for k in range(len(ids)):
        tied.setdefault((ahead[k], rank(k)), []).append(k)
    own, following = [], None
    for (is_ahead, _), at in sorted(tied.items(), key=lambda x: x[0], reverse=True):
        kinds: dict[str, list[int]] = {}
        for k in at:
            kinds.setdefault(text(k), []).append(k)
        for t in sorted(kinds, reverse=True):
            if not is_ahead:
                own.append((kinds[t][0], sum(copies[k] for k in kinds[t])))
            elif following is None:
                following = kinds[t][0]
    for (k, c), after in zip(own, [*(k for k, _ in own[1:]), following]):
        yield ids[k], text(k), c, text(after)


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    Rows stand in a ring, in falling order of id; the edited text is the row's own, its last third replaced by the beginning of the next row's.
    Rows are dealt to ranges of ids, whose cuts are quantiles; only each range's first row goes to two places, and texts
    go through one shuffle, compressed.  Null texts are empty; null ids come last; rows of one id stand by
    a hash of their texts, then by text, and fill as many ranges as they need; repeated rows are next to each other, and
    a single row is its own next.  An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("digest"), F.coalesce(text_col, F.lit("")).alias("text"))
    n = width(docs.sparkSession)
    cuts, loose = _cuts(rows, n)

    def first(batches):
        for b in batches:
            parts = _range_of(b.column(0), b.column(1).to_numpy(), cuts, loose)
            best: dict[int, tuple] = {}
            for r, i, d in zip(parts.tolist(), b.column(0).to_pylist(), b.column(1).to_pylist()):
                if r not in best or (i is not None, i or 0, d) > (best[r][0] is not None, best[r][0] or 0, best[r][1]):
                    best[r] = (i, d)
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([v[0] for v in best.values()], pa.int64()), pa.array([v[1] for v in best.values()], pa.int64())], ["range", "id", "digest"])

    # a row per range comes to the driver
    tops = rows.select("id", "digest").mapInArrow(first, "range int, id long, digest long").groupBy("range").agg(F.max(F.struct("id", "digest")).alias("top")).collect()
    heads = {r["range"]: (r["top"]["id"], r["top"]["digest"]) for r in tops}

    def judged(table: pa.Table) -> pa.Table:
        out, mine = {c: [] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "copies")}, (None, "")
        for i, text, copies, after in _walk(table):
            own = mine[1] if mine[0] == text else Printed(code_points(text))
            mine = (after, own if after == text else Printed(code_points(after)))
            for following, theirs, c in ((text, own, copies - 1), (after, mine[1], 1)):
                if c:
                    new, made = spliced(text, following), own.spliced(theirs)
                    for name, value in zip(out, (i, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own.text, made.text, likeness(own.text, made.text), likeness(own.text, theirs.text), c)):
                        out[name].append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies long"
    found = _packed(rows, cuts, loose, heads).groupBy("range").applyInArrow(judged, schema)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")
