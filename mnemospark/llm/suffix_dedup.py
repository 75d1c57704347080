"""Removal of byte strings that an earlier document already has, by a family of sparse suffix arrays.

A string of ``min_len`` bytes is found by its *anchors*: the starts of the
``gram``-byte strings whose hash is least in some window of ``min_len`` bytes.  Equal
strings have equal anchors at equal places, so suffixes that start at anchors
(about one byte in thirteen) suffice, together with the ``min_len - gram`` bytes
before and after.

1. Chunks send their distinct anchors; a shard tells which ones other chunks have.
2. For those, chunks send each distinct surrounding once, with its first document.
   The shard takes them in batches by document: a batch gets its suffix array (of
   what follows anchors) and prefix array (of what precedes them, backwards), is
   merge-scanned against the existing levels for matches of ``min_len`` bytes, and
   joins the family, where levels of like size merge.  Anchors that very many
   documents share are dealt anew by the bytes next to them.
3. Chunks mark the strings so found and cut the bytes they cover.

Every answer rests on compared bytes but for the anchor itself, which is known by
its 64-bit hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _exchange as X

DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
FULL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept string"
BLOCK = 1 << 20
NO_ID = np.iinfo(np.int64).max
PRIME = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))


def _rolling(a: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` bytes, by doubling."""
    power = a.astype(np.uint64) + np.uint64(1)
    power = _mixed(power)
    size, factor, out, done = 1, PRIME, None, 0
    while True:
        if gram & size:
            if out is None:
                out, done = power, size
            else:
                m = len(a) - done - size + 1
                out, done = out[:m] * np.uint64(factor) + power[done : done + m], done + size
        if size * 2 > gram:
            return _mixed(out)
        m = len(power) - size
        power = power[:m] * np.uint64(factor) + power[size:]
        size, factor = size * 2, factor * factor % 2**64


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x, size = f(x[:-size], x[size:]), size * 2
    return f(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(a: np.ndarray, ends: np.ndarray, min_len: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of documents that lie end to end in ``a``."""
    window, pad = min_len - gram + 1, 2 * min_len
    starts = np.concatenate([[0], ends[:-1]])
    bad = np.zeros(len(a) + 1, np.int8)  # where no gram of a document long enough starts
    short = np.where(ends - starts < min_len, starts, np.maximum(starts, ends - gram + 1))
    np.add.at(bad, short, 1)
    np.add.at(bad, ends, -1)
    bad = np.cumsum(bad, out=bad)[:-1] > 0
    found, hashes = [], []
    for at in range(0, len(a), BLOCK):
        lo, hi = max(0, at - pad), min(len(a), at + BLOCK + pad)
        if hi - lo < min_len:
            break
        h = _rolling(a[lo:hi], gram)
        order = (h >> np.uint64(32)).astype(np.uint32)
        order[bad[lo : lo + len(h)]] = 0xFFFFFFFF
        edge = np.zeros(window - 1, np.uint32)
        least = _slide(np.concatenate([edge + np.uint32(0xFFFFFFFF), order, edge + np.uint32(0xFFFFFFFF)]), window, np.minimum)
        pick = np.flatnonzero((_slide(least, window, np.maximum) == order) & ~bad[lo : lo + len(h)])
        pick = pick[(pick + lo >= at) & (pick + lo < at + BLOCK)]
        found.append(pick + lo)
        hashes.append(h[pick])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(found), np.concatenate(hashes)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """For sorted rows: whether a row differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


class Entries:
    """Surroundings of anchors: hash, bytes before (backwards) and after as words of 8, how many are there, document."""

    def __init__(self, h, left, right, n_left, n_right, ids):
        self.h, self.left, self.right, self.n_left, self.n_right, self.ids = h, left, right, n_left, n_right, ids

    def take(self, at) -> Entries:
        return Entries(self.h[at], self.left[at], self.right[at], self.n_left[at], self.n_right[at], self.ids[at])

    def __add__(self, other: Entries) -> Entries:
        return Entries(*(np.concatenate([a, b]) for a, b in zip(vars(self).values(), vars(other).values())))

    def __len__(self) -> int:
        return len(self.h)


def _ranks(h: np.ndarray, words: np.ndarray, depth: int) -> list[np.ndarray]:
    """The suffix order of (h, words) and its common prefixes, as ranks: [k] tells apart rows by h and their first k bytes."""
    order = np.lexsort([*words.T[::-1], h])
    hs, ws = h[order], words[order]
    common = np.full(len(h), -1, np.int32)
    if len(h) > 1:
        diff = ws[1:] ^ ws[:-1]
        n = np.zeros(len(h) - 1, np.int32)
        open_ = np.ones(len(h) - 1, bool)
        for k in range(words.shape[1]):
            d = np.ascontiguousarray(diff[:, k]).astype(">u8").view(np.uint8).reshape(-1, 8)
            same = np.where(d.any(axis=1), (d != 0).argmax(axis=1), 8)
            n += np.where(open_, same, 0).astype(np.int32)
            open_ &= same == 8
        common[1:] = np.where(hs[1:] == hs[:-1], n, -1)
    out = []
    for k in range(depth + 1):
        rank = np.empty(len(h), np.int64)
        rank[order] = np.cumsum(common < k)
        out.append(rank)
    return out


class LogarithmicIndex:
    """Levels of entries in suffix order, by hash, then what follows, then what precedes; each is at least twice as large as the next.

    ``examined`` counts the entries of levels that batches were held against, and ``moved`` those that merges moved.
    """

    def __init__(self, reach: int):
        self.reach, self.levels, self.examined, self.moved = reach, [], 0, 0

    def scan(self, batch: Entries, level: Entries | None) -> np.ndarray:
        """For each entry of the batch a bit k if the string that starts k bytes before its anchor is in an earlier document of the level (none: of the batch)."""
        mask = np.zeros(len(batch), np.uint32)
        if level is None:
            shared = np.sort(batch.h)
            shared = np.unique(shared[1:][shared[1:] == shared[:-1]])
            met = batch.take(slice(0, 0))
        else:
            shared = np.unique(batch.h)
            lo, hi = np.searchsorted(level.h, shared), np.searchsorted(level.h, shared, side="right")
            shared, lo, size = shared[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            met = level.take(np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum()))
            self.examined += len(met)
        if not len(shared):
            return mask
        at = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, batch.h), len(shared) - 1)] == batch.h)
        own, both = len(at), batch.take(at) + met
        left, right = _ranks(both.h, both.left, self.reach), _ranks(both.h, both.right, self.reach)
        for k in range(self.reach + 1):
            rows = np.flatnonzero((both.n_left >= k) & (both.n_right >= self.reach - k))
            if len(rows) < 2:
                continue
            a, b = left[k], right[self.reach - k]
            rows = rows[(np.bincount(a[rows])[a[rows]] > 1) & (np.bincount(b[rows])[b[rows]] > 1)]
            if len(rows) < 2:
                continue
            key = a[rows] << 32 | b[rows]
            order = np.argsort(key)
            new = _firsts(key[order])
            ids = both.ids[rows[order]]
            earliest = np.minimum.reduceat(ids, np.flatnonzero(new))[np.cumsum(new) - 1]
            hit = rows[order[earliest < ids]]
            hit = hit[hit < own]
            mask[at[hit]] |= np.uint32(1 << k)
        return mask

    def add(self, batch: Entries) -> np.ndarray:
        """What scan() finds of the batch in every level and in itself; the batch becomes a level."""
        mask = self.scan(batch, None)
        for level in self.levels:
            mask |= self.scan(batch, level)
        self.levels.append(self.sorted(batch))
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            self.levels[-2:] = [self.merged(*self.levels[-2:])]
        return mask

    def merged(self, a: Entries, b: Entries) -> Entries:
        """Two levels as one: their runs are merged by hash, and only the entries of hashes that both have are put in order anew."""
        both = a + b
        self.moved += len(both)
        order = np.argsort(both.h, kind="stable")  # of two sorted runs, this merges them
        e, second = both.take(order), order >= len(a)
        group = np.cumsum(_firsts(e.h)) - 1
        n = np.bincount(group)
        of_b = np.bincount(group, second)
        rows = np.flatnonzero(((of_b > 0) & (of_b < n))[group])
        if not len(rows):
            return e
        tied = e.take(rows)
        at = self.suffix_order(tied)
        place = np.arange(len(e))
        place[rows] = rows[at]
        keep = np.ones(len(e), bool)
        keep[rows] = self.distinct(tied.take(at))
        return e.take(place[keep])

    @staticmethod
    def suffix_order(e: Entries) -> np.ndarray:
        return np.lexsort([e.ids, e.n_right, e.n_left, *e.left.T[::-1], *e.right.T[::-1], e.h])

    @staticmethod
    def distinct(e: Entries) -> np.ndarray:
        """Of equal surroundings in suffix order, the first document's."""
        return _firsts(e.h, *e.right.T, *e.left.T, e.n_left, e.n_right)

    def sorted(self, e: Entries) -> Entries:
        e = e.take(self.suffix_order(e))
        return e.take(self.distinct(e))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 50, gram: int = 26, digest: bool = False, batch: int = 1 << 16, hot: int = 4096, clean: bool = False) -> DataFrame:
    """Cut each byte that a ``min_len``-byte string covers which also starts in a document with a smaller id.

    One row per input row: ``(doc_id, n_bytes, n_removed, n_spans, kept)``, where
    ``kept`` is the text left (bytes of a character cut in part are left out), or with
    ``digest`` its SHA-256 over the very bytes as ``kept_sha256``, or with ``clean`` the row as it
    was but for its text, which is what was kept (a null text becomes empty).  Texts are UTF-8
    bytes; a null text is empty.  Strings are judged on the input.  Rows of equal
    id do not cut each other; rows with a null id count as last and do not cut each
    other.  Texts under ``min_len`` bytes stay whole.  Other columns are not read, but by ``clean``.
    An anchor held by more than ``hot`` documents is dealt to several shards; that
    changes no result.
    """
    assert gram < min_len <= gram + 24, "what lies around an anchor is kept in three words of 8 bytes"
    n = X.width(docs.sparkSession)
    reach = min_len - gram
    half = reach // 2
    whole = np.uint32(2 ** (reach + 1) - 1)
    carry, docs_schema = tuple(c for c in docs.columns if clean and c != text_col), docs.schema

    def opened(t: pa.Table):
        rows = X.rows_of(t)
        ids = rows.column("id").to_pylist()
        text = rows.column("text").cast(pa.large_binary()).fill_null(b"").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        cut = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        a, ends = np.frombuffer(text.buffers()[2] or b"", np.uint8)[cut[0] : cut[-1]], cut[1:] - cut[0]
        key = np.array([NO_ID if i is None else i for i in ids], np.int64)
        at, h = anchors(a, ends, min_len, gram)
        return rows, ids, a, ends, key, at, h, np.searchsorted(ends, at, side="right")

    def distinct(h, doc, key):
        """Sorted (shard, 32 bits of hash), each once; the number of its documents here; which is each anchor's."""
        code = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(n)) << np.uint64(32) | h >> np.uint64(32)
        order = np.argsort(code, kind="stable")
        new = _firsts(code[order])
        group = np.cumsum(new) - 1
        docs_of = np.bincount(group[_firsts(code[order], key[doc[order]])], minlength=int(new.sum()))
        which = np.empty(len(h), np.int64)
        which[order] = group
        return code[order][new], docs_of, which

    def shards(code):
        return np.searchsorted(code >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))

    def ask_anchor(t: pa.Table) -> pa.Table:
        _, _, _, _, key, _, h, doc = opened(t)
        code, docs_of, _ = distinct(h, doc, key)
        cut, low, many = shards(code), (code & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.minimum(docs_of, 65535).astype(np.uint16)
        return X.asked(t.column("chunk")[0].as_py(), {s: X.to_blob(step=np.diff(low[i:j], prepend=np.uint32(0)), docs=many[i:j]) for s, (i, j) in enumerate(zip(cut, cut[1:])) if j > i})

    def answer_anchor(t: pa.Table) -> pa.Table:
        chunks = t.column("chunk").to_pylist()
        parts = [X.from_blob(b.as_py()) for b in t.column("blob")]
        keys = [np.cumsum(p.column("step").to_numpy(), dtype=np.uint32) for p in parts]
        _, of, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        holders = np.bincount(of, np.concatenate([p.column("docs").to_numpy() for p in parts]))
        flag = np.where(holders > hot, 2, (times > 1) * 1).astype(np.uint8)[of]
        return X.answered(t.column("shard")[0].as_py(), dict(zip(chunks, (X.to_blob(flag=f) for f in np.split(flag, np.cumsum([len(k) for k in keys])[:-1])))))

    def surroundings(a, ends, key, at, h, doc, flag) -> tuple[Entries, np.ndarray, np.ndarray]:
        """The chunk's distinct surroundings; which is each anchor's; whether their anchors are hot."""
        starts = np.concatenate([[0], ends[:-1]])[doc]
        n_left, n_right = np.minimum(at - starts, reach).astype(np.uint8), np.minimum(ends[doc] - at - gram, reach).astype(np.uint8)
        around = np.concatenate([np.zeros(24, np.uint8), a, np.zeros(gram + 24, np.uint8)])
        left, right = np.zeros((len(at), 24), np.uint8), np.zeros((len(at), 24), np.uint8)
        for j in range(reach):
            left[:, j] = np.where(n_left > j, around[at + (23 - j)], 0)
            right[:, j] = np.where(n_right > j, around[at + (24 + gram + j)], 0)
        e = Entries(h, left.view(">u8").astype(np.uint64), right.view(">u8").astype(np.uint64), n_left, n_right, key[doc])
        order = np.lexsort([e.ids, e.n_right, e.n_left, *e.right.T, *e.left.T, e.h])
        e, flag = e.take(order), flag[order]
        new = _firsts(e.h, *e.left.T, *e.right.T, e.n_left, e.n_right)
        which = np.empty(len(at), np.int64)
        which[order] = np.cumsum(new) - 1
        return e.take(new), which, flag[new] == 2

    def dealt(e: Entries, hot_: np.ndarray) -> dict[int, np.ndarray]:
        """For each shard its entries: by anchor, and for hot anchors by either neighbourhood; negative ones are those by the right side."""
        row = np.arange(len(e))
        near = np.uint64(2**64 - 1) ^ np.uint64(2 ** (8 * (8 - min(half, 8))) - 1)
        by = lambda w: (_mixed(e.h + _mixed(w[:, 0] & near)) % np.uint64(n)).astype(np.int64)
        plain = np.where(hot_, by(e.left), (e.h % np.uint64(n)).astype(np.int64))
        rows, shard, side = [row, row[hot_]], [plain, by(e.right)[hot_]], [np.zeros(len(e), np.int64), np.ones(int(hot_.sum()), np.int64)]
        rows, code = np.concatenate(rows), np.concatenate(shard) * 2 + np.concatenate(side)
        order = np.argsort(code, kind="stable")
        cut = np.searchsorted(code[order], np.arange(2 * n + 1))
        return {s: rows[order[cut[s] : cut[s + 1]]] for s in range(2 * n) if cut[s + 1] > cut[s]}

    def flags(code, answers: pa.Table) -> np.ndarray:
        cut, out = shards(code), np.zeros(len(code), np.uint8)
        for s, b in zip(answers.column("shard").to_pylist(), answers.column("blob")):
            out[cut[s] : cut[s + 1]] = X.from_blob(b.as_py()).column("flag").to_numpy()
        return out

    def ask_strings(t: pa.Table, answers: pa.Table) -> pa.Table:
        _, _, a, ends, key, at, h, doc = opened(t)
        chunk = t.column("chunk")[0].as_py()
        code, docs_of, which = distinct(h, doc, key)
        flag = np.maximum(flags(code, answers), docs_of > 1)[which]
        on = np.flatnonzero(flag)
        e, _, hot_ = surroundings(a, ends, key, at[on], h[on], doc[on], flag[on])
        out: dict[int, list[bytes]] = {}
        for s, rows in dealt(e, hot_).items():
            p = e.take(rows)
            fixed = lambda w: pa.FixedSizeBinaryArray.from_buffers(pa.binary(24), len(w), [None, pa.py_buffer(w.astype(">u8").tobytes())])
            out[s] = X.to_blob(h=p.h, left=fixed(p.left), right=fixed(p.right), n_left=p.n_left, n_right=p.n_right, id=p.ids, hot=hot_[rows])
        out[-1 - chunk] = X.to_blob(flag=flag)  # comes back as it is
        return X.asked(chunk, out)

    def answer_strings(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        if shard < 0:
            return t.select(["chunk", "shard", "blob"])
        words = lambda c: np.frombuffer(b"".join(x.buffers()[1] for x in c.chunks), ">u8").reshape(-1, 3).astype(np.uint64)
        parts = [X.from_blob(b.as_py()) for b in t.column("blob")]
        sizes = [p.num_rows for p in parts]
        p = pa.concat_tables(parts)
        e = Entries(*(p.column(c).to_numpy() for c in ("h",)), words(p.column("left")), words(p.column("right")), *(p.column(c).to_numpy() for c in ("n_left", "n_right", "id")))
        mask = np.zeros(len(e), np.uint32)
        order, family = np.argsort(e.ids, kind="stable"), LogarithmicIndex(reach)
        for i in range(0, len(order), batch):
            mask[order[i : i + batch]] = family.add(e.take(order[i : i + batch]))
        near = np.uint32((2 ** (reach + 1) - 1) ^ (2**half - 1))  # strings that hold at least half of what precedes
        mask = np.where(p.column("hot").to_numpy(), mask & (~near if shard % 2 else near), mask)
        return X.answered(shard, dict(zip(t.column("chunk").to_pylist(), (X.to_blob(mask=m) for m in np.split(mask, np.cumsum(sizes)[:-1])))))

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        table, ids, a, ends, key, at, h, doc = opened(t)
        blobs = dict(zip(answers.column("shard").to_pylist(), (b.as_py() for b in answers.column("blob"))))
        mine = [s for s in blobs if s < 0]
        flag = X.from_blob(blobs[mine[0]]).column("flag").to_numpy() if mine else np.zeros(len(at), np.uint8)
        on = np.flatnonzero(flag)
        marks = np.zeros(len(a) + 1, np.int8)
        if len(on):
            at, h, doc = at[on], h[on], doc[on]
            e, which, hot_ = surroundings(a, ends, key, at, h, doc, flag[on])
            found = np.zeros(len(e), np.uint32)
            for s, rows in dealt(e, hot_).items():
                found[rows] |= X.from_blob(blobs[s]).column("mask").to_numpy()
            mask = np.where(key[doc] > e.ids[which], whole, found[which])
            for k in range(reach + 1):
                hit = (mask >> np.uint32(k) & np.uint32(1)).astype(bool) & (e.n_left[which] >= k) & (e.n_right[which] >= reach - k)
                marks[at[hit] - k] = 1
        out = []
        for i, (lo, hi) in zip(ids, zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())):
            run = np.cumsum(marks[lo:hi], dtype=np.int32)
            g = run > 0
            g[min_len:] = run[min_len:] > run[:-min_len]
            kept = a[lo:hi][~g].tobytes()
            spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
            out.append((i, hi - lo, int(g.sum()), spans, hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "ignore")))
        if clean:
            kept = pa.array([r[4] for r in out], pa.string())
            own = {c: table.column(f"carry_{k}") for k, c in enumerate(carry)}
            return pa.table({f.name: kept if f.name == text_col else own[f.name] for f in docs_schema})
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept")
        kinds = (pa.int64(),) * 4 + (pa.string(),)
        return pa.table({c: pa.array([r[k] for r in out], kind) for k, (c, kind) in enumerate(zip(names, kinds))})

    packed = X.pack(docs, id_col, text_col, carry)
    known = X.per_shard(X.per_chunk(packed, ask_anchor), answer_anchor)
    questions = X.applied(packed, known, ask_strings, X.ASKED)
    return X.applied(packed, X.per_shard(questions, answer_strings), finish, docs.schema if clean else DIGEST if digest else FULL)


#: The digest query by brute force over every string of 50 bytes.
SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select doc_id, p, substr(h, 2 * p + 1, 100) s from (select doc_id, h, unnest(range(0, len(h) // 2 - 49)) p from d)),
f as (select s, min(doc_id) m from w group by s),
x as (select doc_id, p from w join f using (s) where m < doc_id),
c as (select distinct doc_id, unnest(range(p, p + 50)) p from x),
b as (select doc_id, p, substr(h, 2 * p + 1, 2) y from (select doc_id, h, unnest(range(0, len(h) // 2)) p from d)),
k as (select b.doc_id, string_agg(y, '' order by b.p) filter (c.p is null) kept, count(c.p) n_removed from b left join c on c.doc_id = b.doc_id and c.p = b.p group by 1),
s as (select doc_id, count(*) n from c a where not exists (select 1 from c where c.doc_id = a.doc_id and c.p = a.p - 1) group by 1)
select d.doc_id, len(h)::bigint // 2 n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n, 0)::bigint n_spans, sha256(unhex(coalesce(kept, ''))) kept_sha256 from d left join k using (doc_id) left join s using (doc_id)
"""
