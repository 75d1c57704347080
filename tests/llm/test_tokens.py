"""BPE against the tiktoken library, language model against a plain count, suffix dedup and fingerprints against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemospark.llm import _exchange, bpe, components, hpy, simhash, suffix_dedup

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def code(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


ODD = [(None, "a\x1cb \x1d c\x85d 's ''s!'s \n\n x"), (1, None), (2, ""), (2, ""), (3, "don't I'll   ½ ²³ १२"), (4, "z" * 30_000), (5, "\n \t" * 50)]


def test_bpe_is_tiktoken(spark, docs, ranks, code):
    for df in (docs.select("doc_id", "text"), spark.createDataFrame(ODD, DOC)):
        want = Counter()
        for r in df.collect():
            ids = code.encode_ordinary(r.text or "")
            want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        assert Counter(map(tuple, bpe.encode_decode(df, ranks, digest=True).collect())) == want


def test_bpe_round_trip(spark, ranks):
    rows = bpe.encode_decode(spark.createDataFrame(ODD, DOC).selectExpr("*", "'x' as ids", "1 as chunk"), ranks).collect()
    assert Counter((r.doc_id, r.decoded) for r in rows) == Counter((i, t or "") for i, t in ODD)
    assert bpe.encode_decode(spark.createDataFrame([], DOC), ranks).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_pretokens_are_those_of_the_pattern(text):
    import regex

    assert bpe.PATTERN != P.PATTERN
    words, (at,) = bpe._pretokens([text], bpe.PATTERN)
    assert b"".join(words[i] for i in at) == text.encode("utf-8", "surrogatepass")
    if not set(text) & set("\x1c\x1d\x1e\x1f"):
        assert [words[i].decode() for i in at] == regex.findall(P.PATTERN, text)


def brute_cuts(rows, size=50):
    first = {}
    for i, b in sorted(rows, key=lambda r: r[0]):
        for p in range(len(b) - size + 1):
            first.setdefault(b[p : p + size], i)
    out = Counter()
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if first[b[p : p + size]] < i:
                gone[p : p + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i, len(b), sum(gone), sum(map(bool, bytes(gone).split(b"\0"))), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_suffix_dedup_is_brute_force(spark, docs):
    rng = random.Random(3)
    made = [(i, "".join(rng.choice("ab") for _ in range(rng.choice([0, 10, 49, 50, 51, 80, 200]))) + rng.choice(["", "x" * 60, "x" * 61 + "y", "ab" * 40, "é" * 30])) for i in range(150)]
    made += [made[5], (7, "x" * 500), (8, None), (9, "")]
    for df, options in ((docs.select("doc_id", "text"), {}), (spark.createDataFrame(made, DOC), {}), (spark.createDataFrame(made, DOC), {"hot": 1, "batch": 7})):
        rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
        assert Counter(map(tuple, suffix_dedup.deduplicate(df, digest=True, **options).collect())) == brute_cuts(rows)


def test_suffix_dedup_null_ids_and_clean(spark):
    rows = [(None, "x" * 60, 1), (None, "x" * 60, 2), (1, None, 3), (2, "é" * 40 + "q", 4), (3, "é" * 40, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk int")
    kept = {r.chunk: r.text for r in suffix_dedup.deduplicate(df, clean=True).collect()}
    assert kept == {1: "x" * 60, 2: "x" * 60, 3: "", 4: "é" * 40 + "q", 5: ""}
    assert suffix_dedup.deduplicate(df.limit(0)).collect() == []


def test_index_levels_double():
    family = suffix_dedup.LogarithmicIndex(24)
    rng = np.random.default_rng(0)
    for k in range(9):
        n = 100
        h = rng.integers(0, 2**60, n).astype(np.uint64)
        e = suffix_dedup.Entries(h, np.zeros((n, 3), np.uint64), np.zeros((n, 3), np.uint64), np.full(n, 24, np.uint8), np.full(n, 24, np.uint8), np.full(n, k))
        assert not family.add(e).any()
    sizes = [len(x) for x in family.levels]
    assert sum(sizes) == 900 and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    for level in family.levels:
        assert (family.suffix_order(level) == np.arange(len(level))).all()
    assert family.add(e).sum() == 0 and (family.scan(suffix_dedup.Entries(*[*list(vars(e).values())[:-1], np.full(100, 99)]), family.levels[-1]) > 0).all()


def test_index_examines_in_proportion():
    def work(n):
        rng, family = np.random.default_rng(1), suffix_dedup.LogarithmicIndex(24)
        h = rng.integers(0, n, n).astype(np.uint64)  # a hash is met about twice
        around = rng.integers(0, 3, (n, 3)).astype(np.uint64)
        e = suffix_dedup.Entries(h, around, around[::-1].copy(), np.full(n, 24, np.uint8), np.full(n, 24, np.uint8), np.arange(n))
        mask = np.concatenate([family.add(e.take(np.arange(i, i + 500))) for i in range(0, n, 500)])
        return family.examined, family.moved, mask, e

    few, moved, mask, e = work(8000)
    many, more, *_ = work(16000)
    assert many < 2.2 * few and more < 2.5 * moved  # not four times, as without order
    plain = suffix_dedup.LogarithmicIndex(24).scan(e, None)
    assert (mask == plain).all()


def plain_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def plain_components(ids, fps, distance=3):
    f, top = np.array(fps, np.uint64), list(range(len(ids)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    order = sorted(range(len(ids)), key=lambda i: ids[i])
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f[:i] ^ f[i]) <= distance):
            a, b = sorted((root(i), root(int(j))), key=order.index)
            top[b] = a
    return {ids[i]: ids[root(i)] for i in range(len(ids))}


def test_simhash_is_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    want = plain_components(list(fps), list(fps.values()))
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (format(fps[i], "016x"), want[i]) for i in fps}
    assert {r.doc_id for r in simhash.representatives(docs).collect()} == set(want.values())


def test_links_join_a_dense_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(120)}
    signed = [int(np.array(x, np.uint64).view(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.component for r in components.connected_components(simhash.links(df, 3), "a", "b").collect()}
    want = plain_components(signed, [int(np.array(x, np.int64).view(np.uint64)) for x in signed])
    assert {i: got.get(i, i) for i in signed} == want


def test_simhash_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "A b c d"), (3, "a b c d"), (9, None), (8, ""), (7, "zz")], DOC).selectExpr("*", "1 as fp", "2 as least")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert {(None, 3), (5, 3), (3, 3), (9, 8), (8, 8), (7, 7)} == got
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_thresholds_are_cheapest():
    cost, ts = simhash.allot([[0, 5, 50], [0, 1, 2], [0, 9, 90]], 1 - 1)
    assert sum(ts) == 0 and cost == 2 + 5 and ts == [0, 1, -1]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (7, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_language_model(spark, docs):
    texts = {r.doc_id: (r.text or "").encode().lower().split() + ["end"] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    count = Counter(w for i, ws in texts.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    rows = hpy.score(docs).collect()
    for r in rows:
        w = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_contexts_condition_words(spark, docs):
    df = spark.createDataFrame([(i, "the cat sat on a mat") for i in range(30)] + [(100, "mat a on sat cat the"), (101, "sat the zebra")], DOC)
    rows = {r.doc_id: r for r in hpy.score(df, folds=10**9, held=-1).collect()}
    assert rows[0].score > rows[100].score + 2
    few = {r.doc_id: r.score for r in hpy.score(df, folds=10**9, held=-1, chunk_bytes=1).collect()}
    assert all(abs(few[i] - r.score) < 0.2 for i, r in rows.items())


def modified_kneser_ney(texts, held):
    """log10 of held-out texts by an interpolated Kneser-Ney bigram model over seen words and one symbol for others."""
    pairs = Counter((a, b) for i, ws in texts.items() if not held[i] for a, b in zip(["end", *ws], ws))
    left, kinds, after = Counter(a for a, _ in pairs.elements()), Counter(a for a, _ in pairs), Counter(b for _, b in pairs)
    once, twice = (sum(1 for c in pairs.values() if c == k) for k in (1, 2))
    d, v = once / (once + 2 * twice), len(after) + 1
    total = 0.0
    for i, ws in texts.items():
        if held[i]:
            for a, b in zip(["end", *ws], ws):
                base = (max(after[b] - d, 0) + d * len(after) / v) / len(pairs)
                total += math.log10((max(pairs[a, b] - d, 0) + d * kinds[a] * base) / left[a] if left[a] else base)
    return total


def test_held_out_texts_are_predicted_better_than_by_bigrams(spark, docs):
    texts = {r.doc_id: (r.text or "").encode().lower().split() + ["end"] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    whole = sum(r.score for r in hpy.score(docs).collect() if r.held_out)
    assert whole > modified_kneser_ney(texts, held)
    dealt = sum(r.score for r in hpy.score(docs, share=200).collect() if r.held_out)
    assert abs(dealt / whole - 1) < 0.01


def one_by_one(rows, base, d3, d2, sweeps, burn, rng, strength=1.0):
    """Seats customers of a tiny model one by one, with tables as lists; mean predictions of each (u, v, w)."""
    tables3, tables2 = {}, {}  # (u, v) -> w -> sizes of tables; v -> w -> sizes

    def predict(tables, d, w, parent):
        n, t = sum(sum(x) for x in tables.values()), sum(len(x) for x in tables.values())
        own = tables.get(w, [])
        return (sum(own) - d * len(own) + (strength + d * t) * parent) / (strength + n)

    def sit(tables, d, w, parent):
        t, own = sum(len(x) for x in tables.values()), tables.setdefault(w, [])
        new = (strength + d * t) * parent
        x = rng.random() * (new + sum(own) - d * len(own))
        for k, size in enumerate(own):
            if (x := x - (size - d)) < 0:
                own[k] += 1
                return False
        own.append(1)
        return True

    def below(v, w):
        return predict(tables2[v], d2, w, base[w])

    sums = Counter()
    for sweep in range(sweeps):
        for uv, w in {(r[:2], r[2]): 0 for r in rows}:
            there, under = tables3.setdefault(uv, {}), tables2.setdefault(uv[1], {})
            for _ in range(len(there.pop(w, []))):
                k = rng.choices(range(len(under[w])), under[w])[0]
                under[w][k] -= 1
                if not under[w][k]:
                    del under[w][k]
            for _ in range(sum(r == (*uv, w) for r in rows)):
                if sit(there, d3, w, below(uv[1], w)):
                    sit(under, d2, w, base[w])
        if sweep >= burn:
            for u, v, w in sums.keys() | {(*uv, w) for uv in tables3 for w in base}:
                sums[u, v, w] += predict(tables3[u, v], d3, w, below(v, w)) / (sweeps - burn)
    return sums


def test_predictions_are_those_of_single_seating():
    rng = random.Random(4)
    seq = [rng.choice([0, 0, 0, 1, 1, 2, 3]) for _ in range(150)]
    base = {w: p for w, p in enumerate((0.4, 0.3, 0.2, 0.1))}
    rows = list(zip(seq, seq[1:], seq[2:]))
    count = Counter(rows)
    every = [(u, v, w) for u, v in {r[:2] for r in rows} for w in base]
    u, v, w = np.array(every, np.uint64).T
    n = np.array([count[x] for x in every])
    d3 = hpy.discount_of(n)
    d2 = hpy.discount_of(np.array(list(Counter(x[1:] for x in count).values())))
    a, b, *_ = hpy.seat_contexts(u, v, w, n, np.array([base[int(x)] for x in w]), np.random.default_rng(1), burn=20, samples=300)
    want = one_by_one(rows, base, d3, d2, 320, 20, rng)
    got = a + b * np.array([base[int(x)] for x in w])
    assert max(abs(g - want[x]) for g, x in zip(got, every)) < 0.03


def test_context_predictions_sum_to_one():
    rng = np.random.default_rng(5)
    seq = rng.integers(0, 12, 3000).astype(np.uint64)
    base = rng.dirichlet(np.ones(12))
    every = np.array([(u, v, w) for u in range(13) for v in range(12) for w in range(12)], np.uint64)  # 12 was never seen
    count = Counter(zip(seq.tolist(), seq[1:].tolist(), seq[2:].tolist()))
    n = np.array([count[tuple(x)] for x in every.tolist()])
    u, v, w = every.T
    a, b, words, customers = hpy.seat_contexts(u, v, w, n, base[w.astype(int)], np.random.default_rng(0))
    sums = (a + b * base[w.astype(int)]).reshape(-1, 12).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-9)
    p = np.append(a[a > 0], [1.0, 2.0**-60])
    assert np.allclose(hpy.from_codes(hpy.to_codes(p)), p, rtol=4e-4) and hpy.to_codes(np.zeros(1)) == 0
    pairs = len(set(zip(seq[1:].tolist(), seq[2:].tolist())))
    assert sorted(words.tolist()) == list(range(12)) and pairs <= customers.sum() <= n.sum()


def test_language_model_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (2, "A  a"), (9, "x" * 5000)], DOC).selectExpr("*", "1 as score", "2 as chunk")
    rows = hpy.score(df).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter([(None, 3), (1, 1), (2, 1), (2, 3), (9, 2)])
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert hpy.score(df.limit(0)).collect() == []


def test_seats():
    c = np.array([0, 1, 2, 5, 1000, 10**6])
    t = hpy.seat(c, np.full(6, 2.0), np.full(6, 0.25), 0.5, np.random.default_rng(0))
    assert t[0] == 0 and t[1] == 1 and (t[1:] >= 1).all() and (t <= c).all()


def test_seats_of_large_dishes_are_those_of_single_seating():
    for c, others, parent in ((1000, 200.0, 0.1), (5000, 400.0, 0.5)):
        rng, one = np.random.default_rng(1), np.ones(2000)
        for k in range(1, c):
            a = (others + 0.5 * one) * parent
            one += rng.random(2000) < a / (a + k - 0.5 * one)
        t = hpy.seat(np.full(2000, c), np.full(2000, others), np.full(2000, parent), 0.5, np.random.default_rng(2))
        assert abs(t.mean() / one.mean() - 1) < 0.02 and abs(t.std() / one.std() - 1) < 0.1


def test_scratch_is_the_shared_folder(spark):
    assert _exchange.scratch(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_representatives_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 2)
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(5, a), (5, b), (3, b), (None, a), (9, a), (9, a), (2, None), (4, ""), (7, "zz"), (7, "zz")]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as __gone", "2 as gone_id", "3 as Text_Digest", "4 as fp")
    kept = Counter((r.doc_id, r.text) for r in simhash.representatives(df).collect())
    assert kept == Counter([(5, a), (3, b), (None, a), (2, None), (7, "zz"), (7, "zz")])
    assert simhash.representatives(df).columns == df.columns and simhash.representatives(df.limit(0)).collect() == []


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "x" * 500_000)], DOC)
    rows = [(r.doc_id, r.text.encode()) for r in df.collect()]
    got = {r.doc_id: r for r in suffix_dedup.deduplicate(df, digest=True).collect()}
    assert got[1].n_removed == 0 and got[2].n_bytes == len(rows[1][1]) and got[2].n_removed >= len(rows[0][1]) - 50
    assert {r.doc_id: r.fingerprint for r in simhash.near_duplicates(df).collect()} == {i: format(plain_fingerprint(b.decode()), "016x") for i, b in rows}
    assert all(math.isfinite(r.score) for r in hpy.score(df).collect())


def test_discounts_are_those_of_all_blocks():
    """Blocks of a shard hold whole contexts, so their counts of rare dishes add up to those of the shard."""
    rng = np.random.default_rng(3)
    u, v, w = (rng.integers(0, k, 4000).astype(np.uint64) for k in (40, 30, 50))
    n = rng.integers(1, 4, 4000)
    few = sum(hpy.few_orders(u[v % 3 == k], v[v % 3 == k], w[v % 3 == k], n[v % 3 == k]) for k in range(3))
    long = Counter()
    for a, b, c, k in zip(u.tolist(), v.tolist(), w.tolist(), n.tolist()):
        long[a, b, c] += k
    short = Counter((b, c) for _, b, c in long)
    assert few.tolist() == [sum(x == k for x in counts.values()) for counts in (long, short) for k in (1, 2)]
    one = hpy.seat_contexts(u, v, w, n, np.full(4000, 0.02), np.random.default_rng(0))
    two = hpy.seat_contexts(u, v, w, n, np.full(4000, 0.02), np.random.default_rng(0), discounts=(hpy.discount_from(*few[:2]), hpy.discount_from(*few[2:])))
    assert all((x == y).all() for x, y in zip(one, two))


def test_blocks_share_their_discounts(spark, monkeypatch):
    """Held-out scores with many blocks a shard are as good as with one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total = lambda: hpy.score(docs).where("held_out").agg({"score": "sum"}).first()[0]
    whole = total()
    monkeypatch.setattr(hpy, "BLOCK", 2000)
    assert abs(total() - whole) < 0.002 * abs(whole)
