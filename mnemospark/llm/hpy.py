"""A hierarchical Pitman-Yor language model over words and their spellings.

The restaurants of words are contexts of the two words before, of the one before, and
of none: tokens sit in the longest, each table of a context is a customer of the context
without its farthest word.  The base of the last is the
spelling model, whose restaurants are contexts of up to three preceding letters
(as classes of bytes).  A context's parent is the context without its farthest letter,
the last parent is uniform over bytes; each table of a restaurant is a customer
of its parent, each table of the word restaurant sends its spelling to the spelling
model.  Seating is sampled by Gibbs: a sweep unseats the customers of a dish and
seats them again, one by one, given all else; predictive probabilities are averaged
over the samples kept.

Scores are over the words seen in training and one symbol for all others, whose
probability is that of all spellings not seen; the score with each unseen word
spelt out is given beside it.

Words, pairs and triples are counted exactly, over all training documents, by a shuffle
of each chunk's distinct ones, so what the model gathers grows with the corpus.  A shard
has all contexts that end in the same word (a share of them, of a word with very many
tokens), so a context and its parent are seated together, and each triple's prediction is ``a + b * P(word)`` for the P(word) of the
restaurant without context.  Contexts are told apart by a hash of 64 bits.  The
spelling model is a table of 2^15 contexts and 256 bytes at any size.
"""

from __future__ import annotations

import contextlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _exchange as X

ORDER, CLASSES, BOUNDARY = 3, 32, 28
STOP = b"\n"  # the token that ends a text; no word holds a line end
BLOCK = 1 << 19  # triples seated at a time, whole middle words
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, spelled_score double"


def byte_classes() -> np.ndarray:
    """26 letters, digits, other ASCII, the boundary of a word, and three classes of other bytes."""
    c = np.full(256, 27, np.int64)
    c[ord("a") : ord("z") + 1] = np.arange(26)
    c[ord("0") : ord("9") + 1] = 26
    c[0x20] = BOUNDARY
    c[128:] = 29 + np.arange(128) % 3
    return c


def spellings(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each word and the space after it, context * 256 + byte; and where each word starts."""
    a = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(a)) - np.repeat(starts, sizes)
    kind, context = byte_classes()[a], np.zeros(len(a), np.int64)
    for j in range(1, ORDER + 1):
        before = np.full(len(a), BOUNDARY)
        before[j:] = np.where(place[j:] >= j, kind[:-j], BOUNDARY)
        context |= before << (5 * (j - 1))
    return context << 8 | a, starts


def seat(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables after each dish's customers, all sent away, sit down again one by one, given all other dishes.

    ``others`` is strength + discount * (tables of the restaurant's other dishes), ``parent`` the
    dish's probability in the parent.  Customers come in steps of 1/64 of those seated, and
    at least one; a step is seated by the state expected in its midst.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    rows, n = np.flatnonzero(customers > 1), 1
    c, o, q, t = customers[rows], others[rows], parent[rows], tables[rows]
    while len(rows):
        step = max(1, n // 64)
        m = np.minimum(step, c - n)
        a = (o + discount * t) * q
        p = a / (a + n - discount * t)
        if step > 1:
            half = (m - 1) / 2 * p
            a += discount * q * half
            p = a / (a + n + (m - 1) / 2 - discount * (t + half))
            t = t + rng.binomial(m, np.clip(p, 0, 1))
        else:
            t = t + (rng.random(len(rows)) < p)
        n += step
        tables[rows] = t
        left = np.flatnonzero(c > n)
        rows, c, o, q, t = rows[left], c[left], o[left], q[left], t[left]
    return tables


def discount_of(counts: np.ndarray) -> float:
    return discount_from(int((counts == 1).sum()), int((counts == 2).sum()))


def discount_from(once: int, twice: int) -> float:
    """The discount of dishes of which so many were ordered once, and twice."""
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once else 0.5


def few_orders(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many dishes have one customer, and two, in contexts of two words, and in those of one when each context above has one table."""
    of, first = _numbered(_mix(_mix(u, v), w))
    long = np.bincount(of, n, len(first))
    short = np.bincount(_numbered(_mix(v[first], ~w[first]))[0])
    return np.array([(c == k).sum() for c in (long, short) for k in (1, 2)])


def spelling_model(codes: np.ndarray, counts: np.ndarray, strength: float = 1.0, sweeps: int = 6, kept: int = 3, seed: int = 0) -> np.ndarray:
    """Natural log of the averaged predictive probability of each byte in each context, as a (contexts, 256) table."""
    rng = np.random.default_rng(seed)
    shapes = [(CLASSES**k, 256) for k in range(ORDER + 1)]
    customers = [np.zeros(s) for s in shapes]
    customers[ORDER].reshape(-1)[codes] = counts
    tables = [np.zeros(s) for s in shapes]

    def parents(x: np.ndarray) -> np.ndarray:
        return x.reshape(CLASSES, -1, 256).sum(axis=0)

    for k in range(ORDER, 0, -1):
        tables[k] = np.minimum(customers[k], 1)
        customers[k - 1] = parents(tables[k])
    tables[0] = np.minimum(customers[0], 1)
    discounts = [discount_of(c[c > 0]) for c in customers]

    def given(k: int, above: np.ndarray, rows: slice = slice(None)) -> np.ndarray:
        """Predictive probabilities of some contexts of order k, by those of their parents."""
        c, t, d = customers[k][rows], tables[k][rows], discounts[k]
        spread = strength + d * t.sum(axis=1, keepdims=True)
        return (np.maximum(c - d * t, 0) + spread * np.tile(above, (len(c) // len(above), 1))) / (strength + c.sum(axis=1, keepdims=True))

    def parents_given() -> list[np.ndarray]:
        """Of every order but the last, which is large, after the uniform base."""
        out = [np.full((1, 256), 1 / 256)]
        for k in range(ORDER):
            out.append(given(k, out[-1]))
        return out

    total = np.zeros(shapes[ORDER], np.float32)
    block = CLASSES ** (ORDER - 1)
    for sweep in range(sweeps):
        base = parents_given()
        for k in range(ORDER, -1, -1):
            rows, cols = np.nonzero(customers[k])
            others = strength + discounts[k] * (tables[k].sum(axis=1)[rows] - tables[k][rows, cols])
            tables[k][rows, cols] = seat(customers[k][rows, cols].astype(np.int64), others, base[k][rows % len(base[k]), cols], discounts[k], rng)
            if k:
                customers[k - 1] = parents(tables[k])
        if sweep >= sweeps - kept:
            above = parents_given()[-1]
            for at in range(0, len(total), block):
                total[at : at + block] += given(ORDER, above, slice(at, at + block))
    return np.log(total / kept, out=total)


def _sum_codes(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, of = np.unique(codes, return_inverse=True)
    return found, np.bincount(of, weights, minlength=len(found))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ a >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    x = ((x ^ x >> np.uint64(32)) + b) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each key among the distinct ones, and where each of those is first."""
    codes = pd.factorize(keys)[0]
    first = np.zeros(codes.max(initial=-1) + 1, np.int64)
    first[codes[::-1]] = np.arange(len(keys))[::-1]
    return codes, first


def seat_contexts(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, base: np.ndarray, rng, strength: float = 1.0, burn: int = 3, samples: int = 3, discounts: tuple[float, float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seats n customers of each word w after (u, v); ``base``: P(w) without context.  All rows of a v must be given.

    A chain of ``burn`` sweeps and then one for each of ``samples``, begun with one table a dish; a sweep
    seats contexts of two words by what those of one predict, and then those.
    For each row a and b, so that its predictive probability, averaged over the samples, is a + b * P(w);
    and each distinct w with its tables in the contexts of one word, which are the customers of the restaurant without context.
    ``discounts`` of contexts of two words and of one: else they are estimated from the counts given.
    """
    pair = _mix(u, v)
    of, first = _numbered(_mix(pair, w))
    long = _numbered(pair[first])[0]
    dish, first2 = _numbered(_mix(v[first], ~w[first]))
    at = first[first2]
    short, base, words = _numbered(v[at])[0], base[at], w[at]
    c3 = np.bincount(of, n, len(first)).astype(np.int64)
    t3 = np.minimum(c3, 1).astype(np.float64)
    c2 = np.bincount(dish, t3, len(at)).astype(np.int64)
    t2 = np.minimum(c2, 1).astype(np.float64)
    d3, d2 = discounts or (discount_of(c3), discount_of(c2))
    full = (strength + np.bincount(long, c3))[long]
    many3 = np.flatnonzero(c3 > 1)
    a, b = np.zeros(len(first)), np.zeros(len(first))

    def totals(t, of, d):
        return (strength + d * np.bincount(of, t))[of]

    for sweep in range(burn + samples):
        own2, rest2 = _parts(c2, t2, short, d2, strength)
        if len(many3):
            others = totals(t3, long, d3)[many3] - d3 * t3[many3]
            t3[many3] = seat(c3[many3], others, (own2 + rest2 * base)[dish[many3]], d3, rng)
        c2 = np.bincount(dish, t3, len(at)).astype(np.int64)
        t2 = np.minimum(t2, c2) + ((t2 == 0) & (c2 > 0))
        many2 = np.flatnonzero(c2 > 1)
        t2[c2 <= 1] = c2[c2 <= 1]
        t2[many2] = seat(c2[many2], totals(t2, short, d2)[many2] - d2 * t2[many2], base[many2], d2, rng)
        if sweep >= burn:
            own2, rest2 = _parts(c2, t2, short, d2, strength)
            rest3 = totals(t3, long, d3) / full
            a += np.maximum(c3 - d3 * t3, 0) / full + rest3 * own2[dish]
            b += rest3 * rest2[dish]
    word, first = _numbered(words)
    return a[of] / samples, b[of] / samples, words[first], np.bincount(word, t2, len(first)).astype(np.int64)


def _parts(c: np.ndarray, t: np.ndarray, of: np.ndarray, d: float, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each dish's probability: what its own customers give it, and what share of the parent's it has beside."""
    full = strength + np.bincount(of, c)
    return np.maximum(c - d * t, 0) / full[of], ((strength + d * np.bincount(of, t)) / full)[of]


def to_codes(p: np.ndarray) -> np.ndarray:
    """Probabilities as 16 bits: logarithms in steps of 1/1024 bit (0.034 % at most away), 0 for none."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(65535 + 1024 * np.log2(p)), 1, 65535), 0).astype(np.uint16)


def from_codes(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.exp2((codes.astype(np.float64) - 65535) / 1024), 0)


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Shuffles of queries run inside are dropped as they end; nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, path: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    with tidy(df.sparkSession):
        return X.written(df, path, by)


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    names = [x.split() for x in schema.split(", ")]
    return pa.table({c: pa.array([r[k] for r in rows], kinds[kind]) for k, (c, kind) in enumerate(names)})


def _planes(name: str, x: np.ndarray) -> dict[str, np.ndarray]:
    """Whole numbers byte by byte: frequent ones are small, so their bytes compress better apart."""
    x, out = np.asarray(x), {}
    for k in range(max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)):
        out[f"{name}{k}"] = (x >> 8 * k & 255).astype(np.uint8)
    return out


def _joined(t: pa.Table, name: str) -> np.ndarray:
    x = np.zeros(t.num_rows, np.int64)
    for k in range(8):
        if f"{name}{k}" in t.column_names:
            x |= t.column(f"{name}{k}").to_numpy().astype(np.int64) << 8 * k
    return x


def tokenised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text (null: none), tokens as numbers of the distinct ones, frequent ones first, and those; number 0 is the end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    words = lists.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    sizes = np.bincount(np.repeat(np.arange(len(texts)), lengths)[some.to_numpy(zero_copy_only=False)], minlength=len(texts))
    coded = words.filter(some).dictionary_encode()
    tokens = coded.indices.to_numpy()
    order = np.argsort(-np.bincount(tokens, minlength=len(coded.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    return sizes, rank[tokens], pa.concat_arrays([pa.array([STOP], pa.binary()), coded.dictionary.take(pa.array(order)).cast(pa.binary())])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, strength: float = 1.0, burn: int = 3, samples: int = 3, seed: int = 7, chunk_bytes: int = 1 << 23, share: int = 1 << 22) -> DataFrame:
    """log10 probability of every whole text, learnt from the texts whose crc32(id as text) mod ``folds`` is not ``held``.

    Tokens are the words (runs of bytes other than ASCII white space, A-Z lower-cased)
    and then one end; each is given the two before it, ends before the first.  One row per
    input row: ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    spelled_score)``; base_score is the add-half unigram score.  Both it and score take
    words unseen in training as one symbol; spelled_score has the probability of each
    one's spelling.  A null or empty text is its end alone; a row with a null id is never
    held out; repeated rows count each time; an empty table gives no rows; other columns
    are not read.  Perplexity is ``10 ** (-score / n_tokens)``.  ``chunk_bytes``: of text
    that one task counts at a time; each chunk asks each shard once.  ``share``: a middle word
    with more training tokens than these has its contexts dealt to several shards by the word
    before; each seats its share of the word's own restaurant.
    """
    spark = docs.sparkSession
    n = X.width(spark)
    asked_schema, shard_schema, blob_schema = "kind int, shard int, chunk long, blob binary", "shard int, chunk long, blob binary", "chunk long, shard int, blob binary"

    def is_held(i) -> bool:
        return i is not None and zlib.crc32(str(i).encode()) % folds == held

    def chunk_rows(chunk: int, parts: list[pa.RecordBatch]):
        """Kind 0: the chunk's tokens by its own numbers; kind 1: to each shard, its words and how often training texts have them."""
        part = pa.Table.from_batches(parts).combine_chunks()
        ids, (sizes, tokens, words) = part.column(0).to_pylist(), tokenised(part.column(1).combine_chunks())
        learnt = np.array([not is_held(i) for i in ids])
        count = np.bincount(tokens[np.repeat(learnt, sizes)], minlength=len(words))
        count[0] += learnt.sum()
        shard = np.fromiter((zlib.crc32(w) % n for w in words.to_pylist()), np.int32, len(words))
        order = np.argsort(shard, kind="stable")
        blobs = {"docs": X.to_blob(id=part.column(0), size=sizes), "tokens": X.to_blob(**_planes("t", tokens)), "shards": X.to_blob(**_planes("s", shard))}
        rows = [(0, -1, chunk, X.to_blob(**{c: pa.array([b], pa.binary()) for c, b in blobs.items()}))]
        for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            rows.append((1, int(shard[at[0]]), chunk, X.to_blob(word=words.take(pa.array(at)), n=count[at])))
        return _rows(asked_schema, rows).to_batches(max_chunksize=1)

    def read(batches):
        from pyspark import TaskContext

        chunk, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64) + 16
            cuts = np.flatnonzero(np.diff((size + np.cumsum(lengths)) // chunk_bytes)) + 1
            for at, to in zip([0, *cuts], [*cuts, batch.num_rows]):
                parts.append(batch.slice(at, to - at))
                size += int(lengths[at:to].sum())
                if size >= chunk_bytes:
                    yield from chunk_rows(chunk, parts)
                    chunk, parts, size = chunk + 1, [], 0
        if any(p.num_rows for p in parts):
            yield from chunk_rows(chunk, parts)

    def tokens_of(blob):
        """Ids, sizes and tokens of a chunk's documents, and the positions of each shard's words."""
        p = X.from_blob(blob)
        of, tokens, shard = (X.from_blob(p.column(c)[0].as_py()) for c in ("docs", "tokens", "shards"))
        tokens, shard = _joined(tokens, "t"), _joined(shard, "s")
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        return of.column("id").to_pylist(), of.column("size").to_numpy(), tokens, shard, {int(shard[at[0]]): at for at in np.split(order, cuts)}

    def merge_words(t: pa.Table) -> pa.Table:
        """A shard's words and their counts, and the numbers of those that each chunk has."""
        t = t.sort_by("chunk")
        parts = [X.from_blob(blob.as_py()) for blob in t.column("blob")]
        coded = pa.concat_arrays([x for p in parts for x in p.column("word").chunks]).dictionary_encode()
        at = coded.indices.to_numpy()
        count = np.bincount(at, np.concatenate([p.column("n").to_numpy() for p in parts]), minlength=len(coded.dictionary)).astype(np.int64)
        asked, shard = np.split(at, np.cumsum([p.num_rows for p in parts])[:-1]), t.column("shard")[0].as_py()
        rows = [(shard, chunk, X.to_blob(**_planes("at", x))) for chunk, x in zip(t.column("chunk").to_pylist(), asked)]
        return _rows(shard_schema, rows + [(shard, -1, X.to_blob(word=coded.dictionary, n=count, own=count))])

    def merge_customers(t: pa.Table) -> pa.Table:
        """A shard's words again, with the customers that the shards of contexts sent as chunk -2."""
        t = t.sort_by([("chunk", "descending")])
        words, *sent = (X.from_blob(b.as_py()) for b in t.column("blob"))
        own = np.zeros(words.num_rows, np.int64)
        for p in sent:
            own += np.bincount(_joined(p, "place"), _joined(p, "n"), len(own)).astype(np.int64)
        return _rows(shard_schema, [(t.column("shard")[0].as_py(), -1, X.to_blob(word=words.column("word"), n=words.column("n"), own=own))])

    def shard_of(t: pa.Table):
        """A shard's words, their customers, how often training texts have them, and the numbers of those that each chunk has."""
        blobs = dict(zip(t.column("chunk").to_pylist(), t.column("blob")))
        words = X.from_blob(blobs.pop(-1).as_py())
        own, count = (words.column(c).to_numpy() for c in ("own", "n"))
        return t.column("shard")[0].as_py(), words.column("word").to_pylist(), own, count, {c: _joined(X.from_blob(b.as_py()), "at") for c, b in sorted(blobs.items())}

    def gathered(shards: DataFrame, customers) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, float]]:
        """Spelling customers of all shards, summed by ranges of codes, the shards' totals summed, and the first of each."""
        slices = 16

        def send(t: pa.Table) -> pa.Table:
            shard, words, own, count, _ = shard_of(t)
            codes, weights, totals = customers(shard, words, own)
            cut = np.searchsorted(codes, np.arange(slices + 1) * (CLASSES**ORDER * 256 // slices))
            rows = [(k, X.to_blob(code=codes[i:j], n=weights[i:j])) for k, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
            return _rows("slice int, blob binary", rows + [(-1, X.to_blob(shard=[shard], **{f"t{k}": [float(x)] for k, x in enumerate(totals)}))])

        def merge(t: pa.Table) -> pa.Table:
            parts = [X.from_blob(b.as_py()) for b in t.column("blob")]
            if t.column("slice")[0].as_py() < 0:
                p = pa.concat_tables(parts)
                return _rows("slice int, blob binary", [(-1, X.to_blob(**{c: p.column(c) for c in p.column_names}))])
            codes, weights = _sum_codes(*(np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("code", "n")))
            return _rows("slice int, blob binary", [(t.column("slice")[0].as_py(), X.to_blob(code=codes, n=weights))])

        with tidy(spark):
            rows = X.per_shard(shards, send, "slice int, blob binary").groupBy("slice").applyInArrow(merge, "slice int, blob binary").collect()
        parts = {r["slice"]: X.from_blob(r["blob"]) for r in rows}
        totals = parts.pop(-1, None)
        join = lambda c: np.concatenate([parts[k].column(c).to_numpy() for k in sorted(parts)] or [np.zeros(0)])
        if totals is None:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0), {}
        sums = np.array([totals.column(c).to_numpy().sum() for c in totals.column_names[1:]])
        return join("code").astype(np.int64), join("n"), sums, dict(zip(totals.column("shard").to_pylist(), totals.column("t0").to_pylist()))

    def spelt(words, own, tables) -> tuple[np.ndarray, np.ndarray]:
        """Each table of a word sends its spelling to the spelling model."""
        known = np.flatnonzero(own)
        if not len(known):
            return np.zeros(0, np.int64), np.zeros(0)
        codes, starts = spellings([words[i] for i in known])
        return _sum_codes(codes, np.repeat(tables[known], np.diff(np.append(starts, len(codes)))))

    def log_base(words, table) -> np.ndarray:
        codes, starts = spellings(words)
        return np.add.reduceat(table.reshape(-1)[codes].astype(np.float64), starts)

    def first(shard, words, own):
        """One table a word."""
        tables = np.minimum(own, 1)
        return *spelt(words, own, tables), [tables.sum(), own.sum(), (own == 1).sum(), (own == 2).sum()]

    def chain(own, base, elsewhere, discount, rng, sweeps) -> list[np.ndarray]:
        """The tables of a shard's words in the restaurant without context after each sweep; ``elsewhere``: tables of all other shards."""
        tables, out = np.minimum(own, 1).astype(np.float64), []
        for _ in range(sweeps):
            tables = seat(own, strength + discount * (elsewhere + tables.sum() - tables), base, discount, rng)
            out.append(tables)
        return out

    path = X.scratch(spark)
    packed = written(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(read, asked_schema), path, ("kind",))
    tokens = packed.where("kind = 0").select("chunk", "blob")
    shards = written(X.per_shard(packed.where("kind = 1").select("shard", "chunk", "blob"), merge_words, shard_schema))
    X.discard(spark, f"{path}/kind=1")
    words_only = shards.where("chunk = -1")

    codes, weights, totals, types_of = gathered(words_only, first)
    types, train, once, twice = (int(x) for x in totals) if len(totals) else (0, 0, 0, 0)
    all_discount = float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once else 0.5
    early = spark.sparkContext.broadcast(spelling_model(codes, weights, seed=seed))

    def parts_of(count: np.ndarray) -> np.ndarray:
        """Into how many parts the contexts of a middle word are dealt, as powers of two, at most one a shard."""
        most = max(0, n.bit_length() - 1)
        return np.clip(np.ceil(np.log2(np.maximum(count, 1) / share)), 0, most).astype(np.uint8)

    def guess(t: pa.Table) -> pa.Table:
        """P(word), as 16 bits, while the restaurant without context has all tokens; and the word's number."""
        shard, words, own, _, asked = shard_of(t)
        base = np.exp(log_base(words, early.value))
        (tables,) = chain(own, base, types - types_of[shard], all_discount, np.random.default_rng([seed, shard]), 1)
        spread = strength + all_discount * (types - types_of[shard] + tables.sum())
        p = to_codes((np.maximum(own - all_discount * tables, 0) + spread * base) / (strength + train))
        return _rows(blob_schema, [(c, shard, X.to_blob(p=p[at], **_planes("at", at), parts=parts_of(own)[at])) for c, at in asked.items()])

    def triples(sizes, tokens, shard, parts):
        """Distinct (u, v, w) of a chunk, each u before v before w; the number of each token's; and for each shard, the positions of its own."""
        size, ends = len(shard), np.cumsum(sizes + 1)
        w = np.zeros(len(tokens) + len(sizes), np.int64)
        w[np.delete(np.arange(len(w)), ends - 1)] = tokens
        v, begin = np.roll(w, 1), ends - sizes - 1
        v[begin] = 0
        u = np.roll(v, 1)
        u[begin] = 0
        v *= size
        v += u
        del u
        pairs = None
        if size**3 >= 1 << 63:
            pairs, v = np.unique(v, return_inverse=True)
        v *= size
        v += w
        del w
        keys, of = np.unique(v, return_inverse=True)
        v, w = np.divmod(keys, size)
        v, u = np.divmod(v if pairs is None else pairs[v], size)
        own = (shard[v] + (shard[u] & (1 << parts[v].astype(np.int64)) - 1)) % n
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.diff(own[order])) + 1
        return u, v, w, of, {int(own[at[0]]): at for at in np.split(order, cuts)}

    def ask_contexts(t: pa.Table, answers: pa.Table) -> pa.Table:
        ids, sizes, tokens, shard, parts = tokens_of(t.column("blob")[0].as_py())
        p, number, split = np.zeros(len(shard), np.uint16), np.zeros(len(shard), np.int64), np.zeros(len(shard), np.uint8)
        for s, b in zip(answers.column("shard").to_pylist(), answers.column("blob")):
            got = X.from_blob(b.as_py())
            p[parts[s]], number[parts[s]], split[parts[s]] = got.column("p").to_numpy(), _joined(got, "at") * n + s, got.column("parts").to_numpy()
        u, v, w, of, own = triples(sizes, tokens, shard, split)
        learnt = np.repeat([not is_held(i) for i in ids], sizes + 1)
        count = np.bincount(of[learnt], minlength=len(w))
        count = count.astype(np.min_scalar_type(int(count.max(initial=0))))
        del of, learnt, tokens
        rows, place = [], np.zeros(len(shard), np.int64)
        for s, at in own.items():
            have = np.unique(np.concatenate([u[at], v[at], w[at]]))
            have = have[np.argsort(number[have])]
            place[have] = np.arange(len(have))
            step = np.diff(place[v[at]], prepend=0)
            rows.append((s, t.column("chunk")[0].as_py(), X.to_blob(step=np.diff(number[have], prepend=0), p=p[have]), X.to_blob(**_planes("u", place[u[at]]), **_planes("v", 2 * np.abs(step) + (step < 0)), **_planes("w", place[w[at]]), n=count[at])))
        return _rows("shard int, chunk long, words binary, blob binary", rows)

    def answer_contexts(t: pa.Table) -> pa.Table:
        """To each chunk a and b of its triples; to the shards of words, as chunk -2, their customers."""
        t = t.sort_by("chunk")
        own, columns = t.column("shard")[0].as_py(), []
        for some, blob in zip(t.column("words"), t.column("blob")):
            some, p = X.from_blob(some.as_py()), X.from_blob(blob.as_py())
            h = np.cumsum(some.column("step").to_numpy()).astype(np.uint64)
            step, w = _joined(p, "v"), _joined(p, "w")
            h = h.astype(np.min_scalar_type(int(h[-1])))
            columns.append((h[_joined(p, "u")], h[np.cumsum(np.where(step & 1, -(step >> 1), step >> 1))], h[w], p.column("n").to_numpy(), some.column("p").to_numpy()[w]))
        chunks, ends = t.column("chunk").to_pylist(), np.cumsum([len(c[0]) for c in columns])[:-1]
        del t
        u, v, w, count, p = (np.concatenate(c) for c in zip(*columns))
        del columns
        a, b, sent = np.zeros(len(u), np.uint16), np.zeros(len(u), np.uint16), []
        blocks = _mix(v.astype(np.uint64), np.uint64(1)) % np.uint64(-(-len(v) // BLOCK))
        order = np.argsort(blocks, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1)
        wide = lambda at: (z[at].astype(np.uint64) for z in (u, v, w))
        # one discount an order for all blocks of the shard
        few = sum(few_orders(*wide(at), count[at]) for at in parts) if len(parts) > 1 else None
        discounts = None if few is None else (discount_from(*few[:2]), discount_from(*few[2:]))
        for k, at in enumerate(parts):
            x, y, *of_words = seat_contexts(*wide(at), count[at], from_codes(p[at]), np.random.default_rng([seed, samples, own, k]), strength, burn, samples, discounts)
            a[at], b[at] = to_codes(x), to_codes(y)
            sent.append(of_words)
        del u, v, w, count, p
        rows = [(c, own, X.to_blob(a=x, b=y)) for c, x, y in zip(chunks, np.split(a, ends), np.split(b, ends))]
        words, customers = (np.concatenate(x) for x in zip(*sent))
        words, of = np.unique(words, return_inverse=True)
        customers = np.bincount(of, customers).astype(np.int64)
        words, customers = words[customers > 0], customers[customers > 0]
        shard = (words % np.uint64(n)).astype(np.int64)
        return _rows(blob_schema, rows + [(-2, s, X.to_blob(**_planes("place", (words[shard == s] // np.uint64(n)).astype(np.int64)), **_planes("n", customers[shard == s]))) for s in np.unique(shard).tolist()])

    asked_contexts = X.applied(tokens, X.per_shard(shards, guess, blob_schema), ask_contexts, "shard int, chunk long, words binary, blob binary")
    in_context = written(X.per_shard(asked_contexts, answer_contexts, blob_schema))
    customers = in_context.where("chunk = -2").select("shard", "chunk", "blob")
    words_only = written(X.per_shard(words_only.union(customers), merge_customers, shard_schema))

    def tally(shard, words, own):
        return np.zeros(0, np.int64), np.zeros(0), [(own > 0).sum(), own.sum(), (own == 1).sum(), (own == 2).sum()]

    _, _, totals, begun = gathered(words_only, tally)
    tables_of, seated, once, twice = (int(x) for x in totals) if len(totals) else (0, 0, 0, 0)
    discount = float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once else 0.5

    def second(shard, words, own):
        tables = chain(own, np.exp(log_base(words, early.value)), tables_of - begun[shard], discount, np.random.default_rng([seed, 1, shard]), burn)[-1]
        return *spelt(words, own, tables), [tables.sum()]

    codes, weights, totals, burnt = gathered(words_only, second)
    late = spark.sparkContext.broadcast(spelling_model(codes, weights, seed=seed + 1))
    before = float(totals[0]) if len(totals) else 0.0

    def sampled(shard, words, own):
        """Log of the base, and the tables of the samples after the burn-in."""
        base = log_base(words, late.value)
        return base, chain(own, np.exp(base), before - burnt[shard], discount, np.random.default_rng([seed, 2, shard]), samples)

    def third(shard, words, own):
        base, tables = sampled(shard, words, own)
        return np.zeros(0, np.int64), np.zeros(0), [np.mean([t.sum() for t in tables]), np.exp(base)[own > 0].sum()]

    _, _, totals, _ = gathered(words_only, third)
    spread = strength + discount * (totals[0] if len(totals) else 0.0)
    unseen = np.log10(spread * max(1 - totals[1], 1e-12) / (strength + seated)) if len(totals) else 0.0

    def answer(t: pa.Table) -> pa.Table:
        shard, words, own, count, asked = shard_of(t)
        base, tables = sampled(shard, words, own)
        with np.errstate(divide="ignore"):
            kept = np.log(np.mean([np.maximum(own - discount * t, 0) for t in tables], axis=0))
        spelled = ((np.logaddexp(kept, np.log(spread) + base) - np.log(strength + seated)) / np.log(10)).astype(np.float32)
        return _rows(blob_schema, [(c, n + shard, X.to_blob(n=count[at], q=spelled[at], parts=parts_of(count)[at])) for c, at in asked.items()])

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        ids, sizes, tokens, shard, parts = tokens_of(t.column("blob")[0].as_py())
        count, q, split = np.zeros(len(shard), np.int64), np.zeros(len(shard)), np.zeros(len(shard), np.uint8)
        blobs = dict(zip(answers.column("shard").to_pylist(), answers.column("blob")))
        for s in [s for s in blobs if s >= n]:
            got = X.from_blob(blobs.pop(s).as_py())
            count[parts[s - n]], q[parts[s - n]], split[parts[s - n]] = (got.column(c).to_numpy() for c in ("n", "q", "parts"))
        _, _, w, of, own = triples(sizes, tokens, shard, split)
        a, b = np.zeros(len(w), np.uint16), np.zeros(len(w), np.uint16)
        for s, blob in blobs.items():
            got = X.from_blob(blob.as_py())
            a[own[s]], b[own[s]] = (got.column(c).to_numpy() for c in ("a", "b"))
        a, b, known = from_codes(a), from_codes(b), count > 0
        starts, lengths = np.cumsum(sizes + 1) - sizes - 1, (sizes + 1).tolist()
        base = np.log10((count + 0.5) / (train + 0.5 * (types + 1)))
        del sizes, tokens, answers, blobs

        def total(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x[of], starts)

        sums = [total(x[w]) for x in (known.astype(np.int64), base)]
        for x in (np.where(known, q, unseen), q):
            sums.append(total(np.log10(a + b * (10.0**x)[w])))
        rows = zip(ids, map(is_held, ids), lengths, sums[0].tolist(), [train] * len(ids), *(x.tolist() for x in sums[1:]))
        return _rows(SCORES, list(rows))

    answers = X.per_shard(shards.where("chunk >= 0").union(words_only), answer, blob_schema).union(in_context.where("chunk >= 0"))
    return X.applied(tokens, answers, finish, SCORES)
