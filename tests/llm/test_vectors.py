"""Whitening and vector codes against exact arithmetic and brute force; fingerprints against sums written out."""

import hashlib
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import prefix_hash, queries, vector_codes, whitening

SF = "/root/testdata/sf0.001"
EMB = "vec_id long, embedding array<float>, label int"


def ints(v):
    return [int(np.floor(np.float64(np.float32(c)) * 256)) for c in v]


def vectors(spark, rows):
    return spark.createDataFrame(rows, EMB)


def test_products_are_exact():
    """Against rational arithmetic, with columns of very different size and nearly equal rows."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) * np.array([1e-9, 1, 1e6, 1e12, 0]) + np.array([0, 1e9, 0, 0, 7])
    mean = np.array([Fraction(0) + sum(map(Fraction, c)) / len(x) for c in x.T])
    parts = np.array([float(m) for m in mean]), np.array([float(m - Fraction(float(m))) for m in mean])
    h, low = whitening.products(*whitening.centred(x, parts))
    for i in range(5):
        for j in range(5):
            want = sum((Fraction(a) - mean[i]) * (Fraction(b) - mean[j]) for a, b in zip(x[:, i], x[:, j]))
            size = sum(abs((Fraction(a) - mean[i]) * (Fraction(b) - mean[j])) for a, b in zip(x[:, i], x[:, j]))
            assert abs(Fraction(h[i, j]) + Fraction(low[i, j]) - want) <= size * Fraction(1, 2**68)


def test_merging_keeps_what_a_double_loses():
    h, low = whitening.merged(1e16, 0.0, 1.0, 2**-50)
    assert Fraction(float(h)) + Fraction(float(low)) == Fraction(10**16 + 1) + Fraction(1, 2**50)
    x = np.array([[1e16], [1.0], [-1e16], [2**-40]])
    assert sum(map(Fraction, map(float, np.ravel(whitening.column_sums(x))))) == 1 + Fraction(1, 2**40)


def test_eigen_sees_the_low_parts():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(6, 6)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(6, dtype=np.longdouble) - 0.5 * (q.T @ q))
    want = np.array([4, 4 - 1e-11, 2, 1, 1e-3, 1e-6], np.longdouble)
    v = (q * want) @ q.T
    high = v.astype(np.float64)
    value, axes = whitening.eigen(high, (v - high).astype(np.float64))
    assert np.abs(value - want.astype(float)).max() < 1e-15
    assert np.abs(np.abs((axes.T @ q.astype(float))) - np.eye(6)).max() < 1e-6 and np.abs(np.abs((axes.T @ q.astype(float)))[2:, 2:] - np.eye(4)).max() < 1e-13


def check_whitening(got, rows):
    kept = {r[0]: ints(r[1]) for r in rows}
    fit = np.array(sorted(set(map(tuple, kept.values()))), object)
    n, s = len(fit), fit.sum(axis=0)
    y = np.array([[float(Fraction(int(v) * n - int(t), n)) for v, t in zip(r, s)] for r in fit])
    v = y.T @ y / n
    value, axes = np.linalg.eigh(v)
    value, axes = value[::-1], axes[:, ::-1]
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == len(rows) * min(4, len(s))
    for c in range(min(4, len(s))):
        want = {i: float(np.array([float(Fraction(a * n - int(t), n)) for a, t in zip(x, s)]) @ axes[:, c] / np.sqrt(value[c])) for i, x in kept.items()}
        sign = np.sign(sum(by[i, c + 1].whitened * w for i, w in want.items()))
        for i, x in kept.items():
            r = by[i, c + 1]
            assert abs(sign * r.whitened - want[i]) < 1e-8 and r.n == n and abs(r.explained - value[c] / v.trace()) < 1e-10 and r.identity_error < 1e-9
            assert r.deviation == sum((n * a - int(t)) ** 2 for a, t in zip(x, s))


def test_op12_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    check_whitening(queries.op12_whitening(spark, SF).collect(), rows)


def test_whitening_counts_copies_once_and_drops_what_is_not_finite(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(100, 0.5), -0.0], 1) for i in range(40)]
    copies = [(100 + i, rows[3][1], 1) for i in range(500)]
    bad = [(900, None, 1), (901, [1.0, None, 2.0], 1), (902, [float("nan"), 0.0, 0.0], 1), (903, [float("inf"), 0.0, 0.0], 1), (904, [], 1), (905, [1.0], 1)]
    df = vectors(spark, rows + copies + bad).selectExpr("*", "1 as component", "'a' as V", "2 as x")
    got = whitening.whiten(df).collect()
    assert {r.vec_id for r in got} == {r[0] for r in rows + copies} and {r.n for r in got} == {40}
    third = [r for r in got if r.component == 3]
    assert all(r.whitened is None and abs(r.explained) < 1e-12 for r in third)
    check = [r for r in got if r.component < 3]
    assert all(r.identity_error < 1e-10 for r in check)


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors(spark, [(1, None, None)])).collect() == []
    assert whitening.whiten(vectors(spark, [])).collect() == []
    one = whitening.whiten(vectors(spark, [(None, [0.5, 3e38], 1), (None, [0.5, 3e38], 1)])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in sorted(one, key=lambda r: r.component)] == [(None, 1, 1, 0, None, None)] * 2 + [(None, 2, 1, 0, None, None)] * 2
    far = whitening.whiten(vectors(spark, [(1, [3e38, 0.0], 1), (2, [-3e38, 0.0], 1), (3, [0.0, 1.0], 1)])).collect()
    assert {r.deviation for r in far if r.vec_id < 3} == {None} and len(far) == 6


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted(((r[0], ints(r[1])) for r in rows), key=lambda r: r[0])
    step = len(kept[0][1]) // parts
    cut = lambda x, k: x[k * step : (k + 1) * step]
    books = [[cut(x, k) for _, x in kept[:entries]] for k in range(parts)]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda x: [min(range(len(b)), key=lambda e: (far(cut(x, k), b[e]), e)) for k, b in enumerate(books)]  # noqa: E731, B023
    for _ in range(rounds):
        found = [near(x) for _, x in kept]
        new = []
        for k, b in enumerate(books):
            new.append([])
            for e, old in enumerate(b):
                mine = [cut(x, k) for (_, x), f in zip(kept, found) if f[k] == e]
                new[-1].append([sum(c) // len(mine) for c in zip(*mine)] if mine else old)
        books = new
    out = {i: (near(x), x) for i, x in kept}
    return {i: ("".join(f"{e:02x}" for e in f), sum(far(cut(x, k), books[k][e]) for k, e in enumerate(f))) for i, (f, x) in out.items()}, hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


def test_op13_is_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = queries.op13_partial_distance(spark, SF)
    cols = sorted(got.columns)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(con.sql(vector_codes.SQL).project(",".join(cols)).fetchall())


def test_op13_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").where("vec_id < 150").collect()]
    codes, digest = brute_codes(rows)
    got = vector_codes.compress(vectors(spark, rows)).collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == codes and {r.codebooks_sha256 for r in got} == {digest}
    for r in got:
        assert r.label_error == sum(g.error for g in got if g.label_error is not None and dict((q[0], q[2]) for q in rows)[g.vec_id] == dict((q[0], q[2]) for q in rows)[r.vec_id])


@pytest.mark.parametrize("seed", range(4))
def test_nearest_keeps_ties_and_large_numbers(seed):
    rng = np.random.default_rng(seed)
    book = rng.integers(-2, 3, size=(40, 3))
    parts = rng.integers(-3, 4, size=(500, 3))
    if seed % 2:
        book, parts = book.astype(object) * 2**61, parts.astype(object) * 2**61
    index, far = vector_codes.nearest(parts, book)
    for p, i, f in zip(parts.tolist(), index, far):
        all_ = [sum((a - b) ** 2 for a, b in zip(p, e)) for e in book.tolist()]
        assert f == min(all_) and i == all_.index(f)


def test_codes_of_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i % 30, [rng.gauss(0, 1) for _ in range(4)], None if i % 3 else 7) for i in range(60)]
    rows += [(None, [0.0] * 4, None), (70, [3e38, -3e38, 1.0, -0.0], 9)]
    bad = [(900, None, 1), (901, [1.0, None, 2.0, 1.0], 1), (902, [float("nan")] * 4, 1), (904, [], 1), (905, [1.0], 1), (906, [1.0] * 8, 1)]
    df = vectors(spark, rows + bad).selectExpr("*", "1 as of", "'a' as CODE", "2 as salt", "3 as v")
    one = vector_codes.compress(df, parts=2).collect()
    assert len(one) == len(rows) and sum(r.vec_id is None for r in one) == 1
    old, vector_codes.MAX_BROADCAST = vector_codes.MAX_BROADCAST, 1
    try:
        two = vector_codes.compress(df, parts=2).collect()
    finally:
        vector_codes.MAX_BROADCAST = old
    assert sorted(map(repr, one)) == sorted(map(repr, two))
    assert vector_codes.compress(vectors(spark, bad[:1])).collect() == []


def test_codes_are_read_back(spark):
    books = [np.array([[1, 2], [3, 4]]), np.array([[5, 6], [7, 8]])]
    rows = spark.createDataFrame([("0001",), ("0100",), (None,)], "code string")
    assert [r.decoded for r in vector_codes.decode(rows, books).collect()] == [[1, 2, 7, 8], [3, 4, 5, 6], None]
    x = spark.createDataFrame([(1, [3 / 256, 4 / 256, 5 / 256, 6 / 256])], "id long, v array<float>")
    assert vector_codes.encode(x, 4, books).collect() == [(1, "0100", 0)]


def naive(points, base):
    total = 0
    for k, c in enumerate(points):
        total = (total + (c + 1) * pow(base, k, prefix_hash.P)) % prefix_hash.P
    return total


def test_prefix_arrays():
    rng = random.Random(5)
    text = "".join(rng.choice("ab é漢😀\0") for _ in range(300))
    points = [ord(c) for c in text]
    for base in prefix_hash.BASES:
        a = prefix_hash.prefixes(prefix_hash.code_points(text), base)
        assert a.tolist() == [naive(points[:k], base) for k in range(301)] and prefix_hash.whole(prefix_hash.code_points(text), base) == a[-1]
        at = np.array([rng.randrange(250) for _ in range(20)])
        assert prefix_hash.spans(a, at, at + 30, base).tolist() == [naive(points[k : k + 30], base) for k in at]


def test_long_texts_are_hashed_in_blocks():
    rng = random.Random(6)
    text = "".join(rng.choice("abcd ") for _ in range(7000)) * 30
    points = prefix_hash.code_points(text)
    a, old = prefix_hash.prefixes(points), prefix_hash.BLOCK
    edge = np.array([old - 5, old, 2 * old + 9])
    assert (prefix_hash.spans(a, edge, edge + 400) == prefix_hash.spans(a, edge % 7000, edge % 7000 + 400)).all()
    p, q = prefix_hash.Printed(points), prefix_hash.Printed(prefix_hash.code_points(text[::-1]))
    assert p.spliced(q).text == prefix_hash.fingerprint(prefix_hash.spliced(text, text[::-1]))


@pytest.mark.parametrize("seed", range(5))
def test_extensions(spark, seed):
    rng = random.Random(seed)
    make = lambda: "".join(rng.choice("ab") for _ in range(rng.randrange(40)))
    rows = [(a := make(), b := make() + a, rng.randrange(-1, 40), rng.randrange(-1, 40)) for _ in range(30)] + [(None, "a", 0, 0), ("a", "a", None, 0)]

    def want(a, b, i, j):
        if None in (a, b, i, j) or not (0 <= i <= len(a) and 0 <= j <= len(b)):
            return 0
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        return n

    df = spark.createDataFrame(rows, "a string, b string, i long, j long")
    assert [r.extension for r in prefix_hash.extensions(df, "a", "b", "i", "j").collect()] == [want(*r) for r in rows]
    same = df.select(prefix_hash.equal_spans(F.col("a"), F.col("i"), F.col("b"), F.col("j"), F.lit(3)).alias("s")).collect()
    assert [r.s for r in same] == [want(*r) >= 3 for r in rows]


def test_likeness():
    rng = random.Random(7)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    like = lambda a, b: prefix_hash.likeness(prefix_hash.fingerprint(a), prefix_hash.fingerprint(b))
    for _ in range(20):
        a, b = make(3000), make(3000)
        assert like(a, b) < 0.05 and like(a, a) == 1 and 0.5 < like(a, prefix_hash.spliced(a, b)) < 0.85
        assert like("x" + a[:1400] + "y" + a[1400:] + "z", a) > 0.8  # changed at both ends and within
        assert like(a, b) == like(b, a)
    assert like("", "") == 1 and like("", "a") == 0 and like("ab", "ac") == 0.5 and like("aaaa", "aaaaa") == 0.8


def brute_edited(rows):
    """Rows in falling order of id, for ids without ties."""
    walk = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(walk):
        t, nxt = t or "", walk[(k + 1) % len(walk)][1] or ""
        new = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        fp = [prefix_hash.fingerprint(x) for x in (t, new, nxt)]
        out[i] = (len(t), hashlib.sha256(new.encode()).hexdigest(), fp[0], fp[1], prefix_hash.likeness(fp[0], fp[1]), prefix_hash.likeness(fp[0], fp[2]))
    return out


def test_op11_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_prefix_hash(spark, SF).collect()
    want = brute_edited(rows)
    assert len(got) == len(rows) and {r[0]: tuple(r[1:]) for r in got} == want
    prints = {r.doc_id: r.fingerprint for r in got}
    texts = dict(rows)
    assert all((prints[a] == prints[b]) == (texts[a] == texts[b]) for a in texts for b in texts)


@pytest.mark.parametrize("n", [1, 2, 3, 50])
def test_edited_of_few_rows(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([-1, 1]) * (k * k << 40) - k, "é漢x"[k % 3] * rng.randrange(200) or None) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r[0]: tuple(r[1:]) for r in prefix_hash.edited(df).collect()} == brute_edited(rows)


def test_edited_with_ties_and_nulls(spark):
    """One id, and null, hold most rows; repeated rows follow themselves; the walk does not hang on the layout."""
    rng = random.Random(9)
    rows = [(5, f"text {k} " * 9) for k in range(300)] + [(None, f"null {k} " * 5) for k in range(200)] + [(7, "same " * 20)] * 400 + [(k, f"own {k} " * 7) for k in range(40)] + [(7, None), (7, ""), (None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, range int, BLOB string")
    one, two = (sorted(map(repr, prefix_hash.edited(df.repartition(k)).collect())) for k in (1, 7))
    assert one == two and len(one) == len(rows)
    same = [r for r in prefix_hash.edited(df.where("doc_id = 7 and text like 'same%'")).collect()]
    assert len(same) == 400 and {r.near_next for r in same} == {1.0}
    ring = prefix_hash.edited(df).where("doc_id = 7 and n_chars = 100").collect()
    assert len(ring) == 400 and sum(r.near_next == 1 for r in ring) == 399
    assert prefix_hash.edited(df.limit(0)).collect() == []


def test_fingerprints_of_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "a" * 100_000, 3), (1, "a" * 100_000, 3)], "doc_id long, text string, fingerprint int")
    got = prefix_hash.fingerprints(df).collect()
    assert [(r.doc_id, r.n_chars) for r in got] == [(None, 0), (1, 0), (1, 100_000), (1, 100_000)] and got[0].fingerprint == got[1].fingerprint != got[2].fingerprint == got[3].fingerprint
    assert prefix_hash.fingerprints(df.limit(0)).collect() == []
