"""The audit finds exactly the records that differ, and roots agree only for equal replicas."""

import random

import duckdb
import pytest

from mnemospark.llm import fixity, queries

SF = "/root/testdata/sf0.01"
KIND = "file long, offset long, digest string"


@pytest.mark.parametrize("seed", range(3))
def test_audit_is_brute_force(spark, seed):
    rng = random.Random(seed)
    a = {(f, o): f"{rng.random()}" for f in range(-2, 4) for o in range(0, 400_000, rng.choice([9_000, 30_000]))}
    b = dict(a)
    for k in rng.sample(sorted(a), 12):
        if rng.random() < 0.5:
            b[k] = "changed"
        else:
            del b[k]
    b[3, 399_999_9] = "extra"
    make = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], KIND)
    want = {(*k, "missing" if k not in b else "extra" if k not in a else "corrupt") for k in a | b if a.get(k) != b.get(k)}
    assert {tuple(r) for r in fixity.audit(make(a), make(b)).collect()} == want
    assert fixity.audit(make(a), make(a)).collect() == []


def test_roots(spark):
    a = spark.createDataFrame([(0, 0, "x"), (0, 70_000, "y"), (1, 5, "z")], KIND)
    assert fixity.root(a) == fixity.root(a.orderBy("digest", ascending=False)) != fixity.root(a.where("digest <> 'y'"))
    assert fixity.root(a.limit(0)) is None and fixity.audit(a.limit(0), a.limit(0)).collect() == []
    assert {r.verdict for r in fixity.audit(a, a.limit(0)).collect()} == {"missing"}


def test_query_is_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    got = queries.op7_merkle_fixity(spark, SF)
    cols = sorted(got.columns)
    want = con.sql(fixity.SQL).project(",".join(f'"{c}"' for c in cols)).fetchall()
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(want) and {r[-2] for r in want} and len({r[cols.index("verdict")] for r in want}) == 3


def test_odd_pages(spark):
    rows = [(None, None, None), (None, "u", "h"), (5, "u", None), (5, "u", None), (5, "v", "é" * 9000), (7, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as sha256", "2 as file")
    got = fixity.replicas(df).collect()
    assert sorted((r.page_id is None, r.verdict) for r in got) == [(False, "corrupt"), (False, "missing"), (False, "ok"), (False, "ok"), (True, "ok"), (True, "ok")]
    assert fixity.replicas(df.limit(0)).collect() == []


def test_replicas_have_offsets_of_their_own(spark):
    """A record that is lost or longer shifts what follows it in its file, which is not called corrupt."""
    pages = spark.createDataFrame([(i, f"u{i}", "x" * (20 + i % 7)) for i in range(1500)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in fixity.replicas(pages).collect()}
    want = {i: "missing" if i % 211 == 7 else "corrupt" if i % 97 == 5 or i % 193 == 11 else "ok" for i in range(1500)}
    assert {i: r.verdict for i, r in rows.items()} == want
    shifted = [r for r in rows.values() if r.verdict == "ok" and r.offset != r.second_offset]
    assert len(shifted) > 1000


def test_files_are_read_back(spark):
    rows = [(None, None, None), (None, "u", "h"), (5, "u", None), (5, "u", None), (5, "v", "é" * 9000), (7, "", "a\r\n\r\nb"), (2500, "w", "WARC/1.0")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = fixity.record(fixity.F.col("page_id"), fixity.F.col("url"), fixity.F.col("html"))
    manifest = fixity.laid_out(df.select("page_id", fixity.F.sha2(text, 256).alias("sha256"), fixity.F.octet_length(text).cast("long").alias("n_bytes")))
    read = fixity.read_records(fixity.files(df)).collect()
    assert sorted((r.file, r.offset, r.n_bytes, r.sha256) for r in read) == sorted((r.file, r.offset, r.n_bytes, r.sha256) for r in manifest.collect())
    assert sorted(r.content.decode() for r in read) == sorted(h or "" for _, _, h in rows) and all(r.record_id.startswith("<urn:uuid:") for r in read)
    broken = spark.createDataFrame([(0, bytearray(b"junk")), (1, None), (2, bytearray(b""))], "file long, content binary")
    assert [(r.file, r.n_bytes, r.record_id) for r in fixity.read_records(broken).collect()] == [(0, 4, None)]


def test_any_longs_are_ids(spark):
    """Ids spread like hashes, negative ones, and the ends of their range."""
    rng = random.Random(3)
    ids = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(200)] + [-(1 << 63), (1 << 63) - 1, -1, 0, -1000, (1 << 62) + 5, (1 << 62) + 6] + [None] * 5
    pages = spark.createDataFrame([(i, f"u{i}", "some page " * 3) for i in ids], "page_id long, url string, html string")
    rows = fixity.replicas(pages).collect()
    mod = lambda i, n: i - n * int(i / n) if abs(i) < 1 << 50 else (abs(i) % n) * (1 if i >= 0 else -1)
    want = lambda i: "ok" if i is None else "missing" if mod(i, 211) == 7 else "corrupt" if mod(i, 97) == 5 or mod(i, 193) == 11 else "ok"
    assert sorted((str(r.page_id), r.verdict) for r in rows) == sorted((str(i), want(i)) for i in ids)
    assert {r.file for r in rows if r.page_id is not None} == {i // 1000 for i in ids if i is not None}


def test_roots_over_many_files(spark):
    rng = random.Random(4)
    made = [(rng.randrange(-(1 << 62), 1 << 62), rng.randrange(1 << 40), f"{k}") for k in range(300)]
    a = spark.createDataFrame(made, KIND)
    b = spark.createDataFrame([*made[:-1], (made[-1][0], made[-1][1], "other")], KIND)
    assert fixity.root(a) == fixity.root(a.repartition(3)) != fixity.root(b)
    assert [tuple(r) for r in fixity.audit(a, b).collect()] == [(*made[-1][:2], "corrupt")]
