"""Long conversations, paths, crawls, session logs as a stream, cached results, and texts embedded once."""

import os
import random
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import chunking, graph, ingest, kg, vectors
from mnemospark.service import MemoryStore, ResultCache
from mnemospark.sources import versions

LOG = "# Session: 2026-01-05 10:00\n- **Session Key**: abc\n- **Topic**: a=b; c\n- **Topic**: last one\n\n## Conversation Summary\n\nuser: hello there\nassistant: it is done\nuser: thanks"


def test_one_long_conversation(spark):
    """One conversation holds all turns: exchanges and chunks come as it goes, in time that is that of a sort."""
    n = 200_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text number "), "id").alias("text"))
    start = time.time()
    rows = chunking.merge_exchanges(chunking.exchanges(turns))
    got = rows.agg(F.sum("turn_count").alias("n"), F.max(F.length("text")).alias("most"), F.count("*").alias("chunks"), F.max("chunk_index").alias("last")).first()
    assert got.n == n and got.most <= chunking.IDEAL + 14 * 20 and got.last == got.chunks - 1 and time.time() - start < 120


def test_exchanges_with_notes_nulls_and_times(spark):
    rows = [("a", 0, "note", "n", None), ("a", 1, "user", "q", 10.0), ("a", 2, None, "x", None), ("a", 3, "assistant", None, 20.0), ("a", 4, "note", "m", 5.0), ("a", 5, "user", "r", 30.0), ("a", 6, "user", "late", 4000.0), (None, 0, "user", "z", 0.0)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, timestamp double")
    got = [tuple(r) for r in chunking.exchanges(df, times=True).orderBy("conv_id", "exchange").collect()]
    assert got == [(None, 0, "[user] z", "user", 1, None), ("a", 0, "n\n\n[user] q\n\nm", "assistant,note,user", 5, 5.0), ("a", 1, "[user] r", "user", 1, 30.0), ("a", 2, "[user] late", "user", 1, 4000.0)]
    merged = chunking.merge_exchanges(chunking.exchanges(df, times=True), details=True).where("conv_id = 'a'").collect()
    assert [tuple(r)[1:] for r in merged] == [(0, "n\n\n[user] q\n\nm\n\n---\n\n[user] r\n\n---\n\n[user] late", 7, "assistant,note,user", 5.0)]


@pytest.mark.parametrize("seed", range(2))
def test_paths_and_reach(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(60)]
    df = spark.createDataFrame(pairs + pairs[:9], "src long, dst long")
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)

    def shortest(a, b, hops):
        level, seen = {a: (a,)}, {a}
        for _ in range(hops + 1):
            if b in level:
                return ">".join(map(str, level[b]))
            new = {}
            for x, p in level.items():
                for y in out.get(x, ()):
                    if y not in seen:
                        new[y] = min(new.get(y, (*p, y)), (*p, y))
            seen |= set(new)
            level = new
        return None

    for _ in range(2):
        a, b, hops = rng.randrange(30), rng.randrange(30), rng.randrange(1, 8)
        got = graph.path(df, a, b, hops).collect()
        assert [r.path for r in got] == [p for p in [shortest(a, b, hops)] if p]
    near = {r.id: r.depth for r in graph.reach(df, 3, 3).collect()}
    assert near == {b: len(p.split(">")) - 1 for b in range(30) if b != 3 and (p := shortest(3, b, 3))}
    names = spark.createDataFrame([(f"n{a}", "p", f"n{b}") for a, b in pairs], "subject string, predicate string, object string")
    both = {}
    for a, b in pairs:
        both.setdefault(a, set()).add(b)
        both.setdefault(b, set()).add(a)
    two = {y for x in both.get(5, ()) for y in both[x] | {x}} - {5}
    assert {r.entity for r in kg.related(names, "n5", 2).collect()} == {f"n{x}" for x in two}


def test_a_long_way_through_a_large_graph(spark):
    edges = spark.range(0, 100_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).union(spark.range(0, 100_000).select("id", ((F.col("id") * 7919 + 13) % 100_000).alias("dst")))
    got = graph.path(edges.withColumn("weight", F.lit(1)), 0, 40, 30).collect()
    ids = list(map(int, got[0].path.split(">")))
    assert ids[0] == 0 and ids[-1] == 40 and all(b == a + 1 or b == (a * 7919 + 13) % 100_000 for a, b in zip(ids, ids[1:])) and len(ids) <= 31


def test_crawl_counts_what_it_rejects(spark):
    texts = ["A useful paragraph here.\n\nshort\n\n```code block here```\n\n---------------\n\n<b>tagged text here</b>", "The service crashed during deployment and is broken.\n\nAnother useful one.", "", None, "word. " * 120 + "A sentence of more than ten."]
    files = spark.createDataFrame([(f"f{k}.md", t, float(k)) for k, t in enumerate(texts)], "path string, text string, modified double")
    rows, seen = ingest.crawl(files)
    got = rows.collect()
    counts = seen.get
    assert [(r.path, r.chunk_index, r.total_chunks, r.chunk) for r in sorted(got, key=lambda r: (r.path, r.chunk_index))] == [("f0.md", 0, 1, "A useful paragraph here."), ("f1.md", 1, 2, "Another useful one."), ("f4.md", 0, 1, "A sentence of more than ten.")]
    assert counts == {"files": 5, "chunks": 3, "short": 121, "code": 1, "marks": 1, "tags": 1, "unreliable": 1}
    plain = chunking.crawl_chunks(files.where("text is not null").withColumnRenamed("path", "id")).collect()
    assert len(plain) == counts["chunks"] + counts["unreliable"]


def test_session_chunks(spark):
    timed = "# Session: someday\n- **Session ID**: 17\n\n## Conversation Summary\n\nuser: [Telegram A B id:5381354945 +1m 2026-02-02 09:16 GMT+2] hi\nassistant: yes"
    files = spark.createDataFrame([("a.md", LOG, 50.0), ("b.md", timed, 60.0), ("c.md", "# Heading\n\nJust a note.", 70.0), ("d.md", "  \n", 80.0), (None, LOG, 1.0), ("e.md", None, 2.0), ("f.md", "# Session: none\nuser: x y", 90.0)], "path string, text string, modified double")
    got = {(r.path, r.chunk_index): r for r in chunking.session_chunks(files).collect()}
    assert set(got) == {("a.md", 0), ("b.md", 0), ("c.md", 0), ("f.md", 0)}
    a, b, c, f = (got[x, 0] for x in ("a.md", "b.md", "c.md", "f.md"))
    assert a.session == {"session_date": "2026-01-05 10:00", "session_key": "abc", "topic": "last one"} and (a.chunk_type, a.speakers, a.turn_count) == ("exchange", "assistant,user", 3)
    assert a.timestamp == 1767607200 and b.timestamp > 1.77e9 and (c.timestamp, f.timestamp) == (70.0, 90.0)
    assert (c.chunk_type, c.text, c.session) == ("note", "# Heading\n\nJust a note.", {}) and b.session["session_id"] == "17"
    assert chunking.session_chunks(files.limit(0)).collect() == []


def test_session_stream_is_idempotent(spark, tmp_path):
    root, store = tmp_path / "notes", str(tmp_path / "store")
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text(LOG)
    (root / "sub" / "b.md").write_text("# Heading\n\nA note that is kept here.")
    (root / "copy.md").write_text("# Heading\n\nA note that is kept here.")
    (root / "x.txt").write_text("not this")
    ingest.create_store(spark, store, 4)
    run = lambda check: ingest.ingest_sessions(ingest.file_stream(spark, str(root), 1), store, str(tmp_path / check)).awaitTermination(240)
    assert run("one")
    first = versions.Table.open(spark, store).rows().collect()
    assert len(first) == 2 and {r.chunk_type for r in first} == {"exchange", "note"} and all(r.timestamp for r in first)
    assert run("two")  # another checkpoint: every batch is run again
    assert sorted(map(repr, versions.Table.open(spark, store).rows().collect())) == sorted(map(repr, first))
    (root / "c.md").write_text("A new note that comes later.")
    assert run("one") and versions.Table.open(spark, store).rows().count() == 3


def test_cached_results(spark, tmp_path):
    table = versions.Table.create(spark.createDataFrame([(1, "red fox"), (2, "red dog")], "id long, text string"), str(tmp_path / "t"), buckets=2)
    cache, calls = ResultCache(spark, str(tmp_path / "cache"), ttl=60), []

    def ask(t, now, word="red"):
        def search():
            calls.append(word)
            return t.rows().where(F.col("text").contains(word)).select("id")

        return cache.get({"word": word, "k": 5}, t.version, search, now)

    one, hit = ask(table, 100.0)
    again, hit_2 = ask(table, 150.0)
    assert (hit, hit_2, len(calls)) == (False, True, 1) and sorted(r.id for r in again.collect()) == [1, 2]
    assert all("/cache/" in f for f in again.inputFiles())  # a hit reads nothing but what was cached
    more = table.upsert(spark.createDataFrame([(3, "red cat")], "id long, text string"))
    fresh, hit = ask(more, 150.0)
    assert not hit and sorted(r.id for r in fresh.collect()) == [1, 2, 3]
    assert [ask(table, 161.0)[1], ask(table, 161.0, "dog")[1], ask(table, 162.0)[1]] == [False, False, True] and len(calls) == 4
    cache.clear()
    assert not ask(table, 163.0)[1]


def test_texts_are_embedded_once(spark, tmp_path):
    log = str(tmp_path / "calls")
    os.mkdir(log)

    def model():
        open(f"{log}/made-{os.getpid()}-{time.time_ns()}", "w").close()

        def run(texts):
            for t in texts:
                with open(f"{log}/text-{t.replace(' ', '_')}", "a") as f:
                    f.write("x")
            return [[float(len(t)), 1.0] for t in texts]

        return run

    rows = [(k, f"text {k % 7}", 9.0) for k in range(200)] + [(900, None, 9.0), (901, " \t", 9.0), (902, "", 9.0)]
    df = spark.createDataFrame(rows, "id long, text string, made double").selectExpr("*", "'a' as SHA", "1 as of").repartition(6)
    got = vectors.embed_distinct(df, 2, model).collect()
    assert len(got) == 203 and got[0].asDict().keys() == {"id", "text", "made", "SHA", "of", "vector"}
    assert all(r.vector == ([6.0, 1.0] if r.id < 900 else [0.0, 0.0]) and r.made == 9.0 for r in got)
    files = os.listdir(log)
    assert sorted(f for f in files if f.startswith("text")) == [f"text-text_{k}" for k in range(7)] and all(os.path.getsize(f"{log}/{f}") == 1 for f in files if f.startswith("text"))
    made = [f.split("-")[1] for f in files if f.startswith("made")]
    assert len(made) == len(set(made))  # once a worker
    plain = vectors.embed_distinct(spark.createDataFrame([("a",)], "text string"), 4).first().vector
    assert plain == pytest.approx(vectors.fallback_embedding("a", 4))


def test_store_normalises_and_keeps_its_index(spark, tmp_path):
    kind = "id long, vector array<double>, text string, timestamp double, relevance double, merged boolean, importance_score double, access_counter long, label int, source_file string"
    row = lambda i, v, t: (i, v, t, 0.0, 0.5, False, None, 0, 0, "f")
    store = MemoryStore(spark.createDataFrame([row(1, [1.0, 0.0], "red fox runs")], kind), 2).indexed(str(tmp_path / "i"))
    after, _ = store.add(spark.createDataFrame([row(5, [0.0, 4.0], "red dogs sleep"), row(6, [0.0, 0.0], "zero red")], kind))
    assert {r.id: r.vector for r in after.memories.collect()} == {1: [1.0, 0.0], 5: [0.0, 1.0], 6: [0.0, 0.0]}
    assert {r.id for r in after.index.search(["dog"]).collect()} == {5} and {r.id for r in after.delete(5).index.search(["red"]).collect()} == {1, 6}
    plain = MemoryStore(after.memories, 2).search([0.0, 1.0], ["red"], 0.0).collect()
    assert after.search([0.0, 1.0], ["red"], 0.0).collect() == plain and plain


def test_executors_need_no_copy_of_the_package(tmp_path):
    """The driver alone finds the package: workers get functions by value."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from mnemospark.functions import text as T
from mnemospark.operators import chunking, neighbours, postings, retrieval
df = s.createDataFrame([(1, "The service crashed, redis is broken", [1.0, 0.0]), (2, "# Title\\n\\nfine text here", [0.0, 1.0])], "id long, text string, vector array<double>")
print(sorted(r[0] for r in df.select(T.verdict(F.col("text"))["is_flagged"]).collect()), retrieval.bm25(df, ["redis"]).count(), chunking.markdown_chunks(df).count(), neighbours.neighbours(df, 2, 1).count(), postings.KeywordIndex.create(df, {str(tmp_path / 'i')!r}, buckets=2).search(["crashed"]).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("[False, True] 1 2 2 1"), done.stderr[-3000:]


MARKS = "Words enough for one.###\n\n# Heading of this part.\nSome more.\n## Another heading here\n\nThe last one of them. ### \n \nIts end is this."


def test_marks_before_a_blank_line_are_text(spark):
    """The SQL of crawl_chunks and useful_chunks looks for headings when blank lines are gone; marks before one head nothing."""
    want = ["Words enough for one.###", "# Heading of this part.\nSome more.", "# Another heading here", "The last one of them.", "Its end is this."]
    df = spark.createDataFrame([("a", MARKS)], "id string, text string")
    assert [r.chunk for r in chunking.crawl_chunks(df).orderBy("chunk_index").collect()] == want


def test_crawl_splits_as_its_sql_does(spark, tmp_path):
    import duckdb

    from mnemospark.plans import ORACLES, QUERIES

    pad = " word" * 96  # over 500 characters with the marks, under without
    rows = [(0, MARKS, "s"), (1, pad + " sentence of the end.#############\n\n# Heading", "s"), (5, MARKS + "###", "s"), (25, None, "s"), (6, "Ê Ê Ê Ê Ê Ê Ê\n\nNaïve words of ours. " + "é " * 300 + ". Ends so here.", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("crawl_chunks", "useful_chunks", "crawl_ingest", "crawl_counters"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.sql(ORACLES[name]).project(",".join(f'"{c}"' for c in got.columns)).fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name
