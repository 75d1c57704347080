"""The index gives what a scan of all texts gives, after every write, and reads its terms alone."""

import glob
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions.stem import stem
from mnemospark.operators import postings, retrieval
from mnemospark.sources import versions

WORDS = ["deploy", "deployed", "redis", "poller", "naïve", "überall", "the", "the", "the", "running", "run", "cat", "42", "東京"]


def texts(spark, n, seed, first=0):
    rng = random.Random(seed)
    made = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 5, 40, 200]))) + f" own{i % 50}" for i in range(n)]
    return spark.createDataFrame([(i + first, t if rng.random() > 0.03 else None) for i, t in enumerate(made)], "id long, text string")


def brute(live, query, match):
    """(id, score): BM25 written out over a list of (id, text)."""
    find, wanted = T.term_finder(), sorted({stem(t.lower()) for t in query})
    tf = {i: [stem(w) for w in find(t)] for i, t in live}
    n, average = len(tf), sum(map(len, tf.values())) / max(1, len(tf))
    df = {t: sum(t in w for w in tf.values()) for t in wanted}
    out = {}
    for i, w in tf.items():
        if (all if match == "and" else any)(t in w for t in wanted):
            f = [w.count(t) for t in wanted]
            out[i] = sum(max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(w) / average)) for t, x in zip(wanted, f))
    return sorted(out.items(), key=lambda x: (-round(x[1], 13), x[0]))


def same(index, live, queries=((["redis", "THE"], "and"), (["deploying", "nothing", "own7"], "or"))):
    live = [tuple(r) for r in live.collect()]
    for q, match in queries:
        want = brute(live, q, match)
        got = index.search(q, match=match).collect()
        assert sorted((r.id, round(r.score, 9)) for r in got) == sorted((i, round(v, 9)) for i, v in want)
        top = index.search(q, 5, match=match).collect()
        assert [(r.id, round(r.score, 9)) for r in top] == [(i, round(v, 9)) for i, v in want[:5]]


def test_index_is_bm25_after_writes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "FIRST", 3)
    a, b = texts(spark, 300, 1), texts(spark, 150, 2, 1000)
    one = postings.KeywordIndex.create(a, str(tmp_path / "i"), block=16, buckets=4)
    same(one, a)
    two = one.insert(b)
    both = a.union(b)
    same(two, both)
    three = two.delete(spark.createDataFrame([(i,) for i in range(0, 1100, 3)], "id long"))
    left = both.where("id % 3 <> 0 or id >= 1100")
    same(three, left)
    again = texts(spark, 60, 3)  # ids that were deleted, and ids that are there
    four = three.insert(again)
    now = left.join(again, "id", "left_anti").union(again)
    same(four, now)
    same(four.compact(), now)
    same(two, both)  # a reader keeps its version
    assert postings.KeywordIndex.open(spark, str(tmp_path / "i")).version == four.version + 1
    assert two.known(["deploying", "zebra", "own7"]) == sorted(["deploi", "own7"]) and three.content["n"] == left.count()


@pytest.mark.parametrize("named", [4, 2000])
def test_blocks_that_cannot_win_are_not_read(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(postings, "FIRST", 2)
    monkeypatch.setattr(postings, "NAMED", named)
    df = texts(spark, 600, 5)
    index = postings.KeywordIndex.create(df, str(tmp_path / "i"), block=8, buckets=4)
    scanned, whole = [], postings.KeywordIndex._named
    monkeypatch.setattr(postings.KeywordIndex, "_named", staticmethod(lambda posts, blocks: scanned.append(len(blocks)) or whole(posts, blocks)))
    same(index, df, ((["deploy"], "and"), (["the", "cat"], "and")))
    assert named == 4 or max(scanned) < index.postings(["deploi"]).count()


def test_search_reads_its_terms_and_no_text(spark, tmp_path):
    rng = random.Random(8)
    made = [(i, " ".join(f"w{rng.randrange(20000)}" for _ in range(300))) for i in range(2000)]
    spark.createDataFrame(made, "id long, text string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    index = postings.KeywordIndex.create(df, str(tmp_path / "i"))
    size = lambda pattern: sum(os.path.getsize(f) for f in glob.glob(str(tmp_path / pattern), recursive=True))
    bucket = postings._bucket("w77", index.content["buckets"])
    read = size(f"i/segments/*/postings/bucket={bucket}/*.parquet")
    assert 0 < read < size("t/*.parquet") / 10 and [r.id for r in index.search(["w77"], 10).collect()] == [i for i, _ in brute(made, ["w77"], "and")[:10]]
    plan = spark._jvm.PythonSQLUtils.explainString(index.postings(["w77"])._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [" in plan and "text" not in plan.split("ReadSchema")[1]


def test_bad_rows_and_two_writers(spark, tmp_path):
    df = texts(spark, 20, 6)
    for bad in (df.union(df), df.union(spark.createDataFrame([(None, "x")], df.schema))):
        with pytest.raises(ValueError):
            postings.KeywordIndex.create(bad, str(tmp_path / "bad"))
    one = postings.KeywordIndex.create(df, str(tmp_path / "i"))
    one.insert(texts(spark, 5, 7, 100))
    with pytest.raises(versions.Conflict):
        one.delete(df.select("id").limit(1))
    same(postings.KeywordIndex.open(spark, str(tmp_path / "i")), df.union(texts(spark, 5, 7, 100)))
    empty = postings.KeywordIndex.create(df.limit(0), str(tmp_path / "e"))
    assert empty.search(["cat"], 3).collect() == [] and empty.delete(df).version == empty.version
    same(empty.insert(df), df)


def test_hybrid_search_takes_an_index(spark, tmp_path):
    from mnemospark.plans import fixtures as X

    sf = "/root/testdata/sf0.001"
    m = X.memories(spark, sf)
    index = postings.KeywordIndex.create(m, str(tmp_path / "i"))
    one, two = (retrieval.hybrid_search(m, X.query_vector(spark, sf), list(X.TERMS), X.AS_OF, index=i).select("rank", "id", F.round("score", 9).alias("s")).collect() for i in (None, index))
    assert one == two and one


def test_tasks_that_make_postings_are_bounded(spark, tmp_path, monkeypatch):
    """Of one bucket and a word in every text: shares, not buckets, are the tasks, and no term's block is in two of them."""
    monkeypatch.setattr(postings, "SHARE", 500, raising=False)
    df = texts(spark, 400, 5).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" common")))
    index = postings.KeywordIndex.create(df, str(tmp_path / "i"), block=16, buckets=1)
    rows = index._segments("postings", postings.POSTINGS).select("term", "block", "n", F.input_file_name().alias("file"))
    held = [r["n"] for r in rows.groupBy("file").agg(F.sum("n").alias("n")).collect()]
    assert len(held) > 4 and max(held) < 1500
    assert rows.count() == rows.select("term", "block").distinct().count()
    live = [(r.id, r.text) for r in df.collect()]
    want = brute(live, ["common", "redis"], "and")
    got = [(r.id, round(r.score, 9)) for r in index.search(["common", "redis"], 20).collect()]
    assert got == [(i, round(s, 9)) for i, s in sorted(want, key=lambda x: (-x[1], x[0]))[:20]]
