"""Operators on small rows: fixed cases, brute force, properties, streams against batches."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import chunking as C
from mnemospark.operators import clustering, graph, kg, maintenance, neighbours, retrieval, tiering, vectors
from mnemospark.operators import ingest as I
from mnemospark.sources import tables as S
from mnemospark.streaming import jobs

# fixed cases: text, whether it is flagged
CASES = [
    ("<result>done</result>", True), ("text </tool> more", True), ("Deployed the service successfully", True), ("It achieves 95% accuracy", True), ("2.5x speedup measured", True),
    ("The service crashed during deployment", True), ("It is not working", True), ("failed to connect", True), ("I think that it is fine", True), ("this is unverified", True),
    ("tried it but it failed", True), ("keeps failing", True), ("This method is deprecated", True), ("replaced by the new one", True), ("command not found", True), ("your-key-here", True),
    ("Meeting at noon with Ana", False), ("The cat sat on the mat", False), ("", False), (None, False), ("2 < 3 and 5 > 4", False),
]


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]


def test_classifier_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.f for r in df.select("i", T.verdict(F.col("t"))["is_flagged"].alias("f")).collect()}
    assert got == {i: f for i, (_, f) in enumerate(CASES)}


def test_classifier_grades(spark):
    """The rule by Python's own regular expressions: count of patterns and of categories."""
    texts = ["crashed", "crashed and broken", "deprecated and broken", "deprecated, obsolete, broken, failure, not working", "deprecated broken unverified", "-e \x1b[1m OS: x", "fastfetch", "OS: Linux", "# Session: x\nuser: it crashed\nassistant: fine", "# Session: x\nuser: hi\nA: it crashed\nSystem: broken"]
    for t, v in zip(texts, [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.verdict(F.col("t")).alias("v")).collect()]):
        scan = "it crashed" if "A: it" in t else "fine" if t.startswith("#") else t
        hits = [(c, p) for c, ps in T.PATTERNS.items() for p in ps if re.search("(?i)" + p, scan)]
        m, c = len(hits), len({x for x, _ in hits})
        sure = "fastfetch" in t or t.startswith("-e")
        want = 0.85 if sure else 0.0 if not m else 0.95 if c >= 3 or m >= 5 else 0.85 if c >= 2 or m >= 3 else 0.7 if m >= 2 else 0.55
        assert v.confidence == want, (t, hits)


def test_sanitizer(spark):
    for raw, clean in [("[Telegram A id:12345 x] hello", "hello"), ("user:\nhi\n\n\n\nyou", "hi\n\nyou"), ("id:123456 kept", "kept"), (" plain ", "plain"), ("+9h 2026-02-02 09:16 GMT+2 x", "x")]:
        assert one(spark, raw, T.sanitize) == clean
    assert one(spark, "a <b>c</b>", T.remove_tags) == "a c" and one(spark, "2 < 3", T.has_tags) is False


def test_bm25_is_the_formula(spark):
    docs = {1: "red fox red", 2: "red dog", 3: "blue fox runs far away", 4: "nothing"}
    df = spark.createDataFrame(list(docs.items()), "id long, text string")
    got = {r.id: r.score for r in retrieval.bm25(df, ["red", "fox"], match="or").collect()}
    words = {i: t.split() for i, t in docs.items()}
    avg = sum(map(len, words.values())) / 4
    def idf(t):
        n = sum(t in w for w in words.values())
        return max(np.log((4 - n + 0.5) / (n + 0.5)), 1e-6)
    want = {i: sum(idf(t) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avg)) for t in ("red", "fox")) for i, w in words.items() if {"red", "fox"} & set(w)}
    assert got == pytest.approx(want)
    assert {r.id for r in retrieval.bm25(df, ["red", "fox"]).collect()} == {1}


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(c, 0.05, (30, 4)) for c in (0, 1, 2)] + [rng.uniform(-5, 5, (10, 4))])
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").cache()


def test_neighbours_are_brute_force(points):
    v, df = points
    d = ((v[:, None] - v[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    got = {(r.src, r.dst) for r in neighbours.neighbours(df, 4, 3, metric="l2", block=16).collect()}
    assert got == {(i, int(j)) for i in range(len(v)) for j in np.argsort(d[i], kind="stable")[:3]}
    near = {(r.src, r.dst) for r in neighbours.neighbours(df, 4, radius=0.02, metric="l2", block=16).collect()}
    assert near == set(zip(*map(lambda x: x.tolist(), np.nonzero(d <= 0.02))))


def test_dbscan_is_brute_force(points):
    v, df = points
    eps, least = 0.25, 4
    close = ((v[:, None] - v[None]) ** 2).sum(-1) <= eps * eps
    core = close.sum(1) >= least
    label, n = np.full(len(v), -1), 0
    for i in range(len(v)):
        if core[i] and label[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if label[j] < 0:
                    label[j] = n
                    stack += [k for k in np.flatnonzero(close[j] & core) if label[k] < 0]
            n += 1
    for i in np.flatnonzero(~core & (close & core).any(1)):
        label[i] = label[np.flatnonzero(close[i] & core)[0]]
    assert {r.id: r.label for r in clustering.dbscan(df, 4, eps, least).collect()} == dict(enumerate(label.tolist()))


def test_semantic_dedup_is_greedy(points):
    v, df = points
    kept, of = [], {}
    for i in range(len(v)):
        near = [(float(((v[i] - v[j]) ** 2).sum()), j) for j in kept if ((v[i] - v[j]) ** 2).sum() < 0.02]
        if near:
            of[i] = min(near)[1]
        else:
            kept.append(i)
    rows = maintenance.semantic_dedup(df, 4, 0.02).collect()
    assert {r.id for r in rows if r.kept} == set(kept) and {r.id: r.duplicate_of for r in rows if not r.kept} == of


def test_denoise_removes_directions(points):
    v, df = points
    m = v - v.mean(0)
    _, _, vt = np.linalg.svd(m, full_matrices=False)
    want = m - m @ vt[:1].T @ vt[:1]
    want /= np.linalg.norm(want, axis=1, keepdims=True) + 1e-8
    got = np.array([r.vector for r in vectors.denoise(df, 4, drop=1).orderBy("id").collect()])
    assert np.allclose(got, want, atol=1e-6)


def test_bloom_has_no_false_negatives(spark):
    df = spark.range(2000)
    got = {r.id for r in tiering.bloom_prefilter(df, df.where("id % 10 = 0"), 200).collect()}
    assert set(range(0, 2000, 10)) <= got and len(got) < 320


def test_paths_and_reach(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (4, 1), (9, 9)], "src long, dst long")
    assert graph.path(e, 1, 4).first().path == "1>5>4" and graph.path(e, 1, 9).first() is None and graph.path(e, 1, 1).first().path == "1"
    assert {(r.id, r.depth) for r in graph.reach(e, 1, 2).collect()} == {(2, 1), (5, 1), (3, 2), (4, 2)}


def test_triples_first_wins_and_relational(spark):
    rows = [(2, "A", "follows", "x", None, None, "f", 0.5), (1, "a", "follows", "x", None, None, "f", 0.9), (3, "A", "follows", "x", None, None, "f", 0.1)]
    t = spark.createDataFrame(rows, "seq long, subject string, predicate string, object string, subject_type string, object_type string, source_file string, confidence double")
    assert {(r.subject, r.seq) for r in kg.insert_ignore(t).collect()} == {("A", 2), ("a", 1)}
    assert [r.seq for r in kg.dedup(t).collect()] == [1]
    assert kg.relational(t, "Who is following X?").count() == 3 and kg.relational(t, "what?").count() == 0


def test_extraction(spark):
    text = "# Title\n- 2026-01-01: added retry logic\nThe poller uses redis, daily\nThe job depends on postgres\n- [ ] buy milk\n"
    rows = {(r.subject, r.predicate, r.object) for r in kg.extract_memory(spark.createDataFrame([("m", text)], "source_file string, text string")).collect()}
    assert {("agent", "added", "retry logic"), ("poller", "uses", "redis"), ("The job", "depends_on", "postgres")} <= rows


def test_markdown(spark):
    text = "# A\n\n" + "One sentence here. " * 200 + "\n\n## B\n```\n# not a heading\ncode\n```\ntail " + "x" * 300
    chunks = C.split_markdown(text)
    assert all(len(c) <= C.MAX + len("# A\n\n") for c, _ in chunks) and any("# not a heading\ncode" in c for c, _ in chunks) and chunks[0][1] == "# A"
    assert C.split_markdown("") == [] and C.split_notes(None) == [] and C.split_notes("# a\nx\n\n# b\ny") == ["# a\nx\n\n# b\ny"]


def test_turns(spark):
    body = "user: hi\n[message_id: 3]\nA: hello\nSystem: x\nuser:  \nassistant: [Telegram a 2026-02-02 09:16 GMT+2] y"
    rows = C.parse_turns(spark.createDataFrame([(1, body), (2, "just text"), (3, "")], "id long, body string")).orderBy("id", "turn").collect()
    assert [(r.id, r.role, r.text) for r in rows] == [(1, "user", "hi"), (1, "assistant", "hello"), (1, "system", "x"), (1, "assistant", "[Telegram a 2026-02-02 09:16 GMT+2] y"), (2, "note", "just text")]
    assert rows[3].timestamp == 1770016560


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a" / "x.md").write_text("# Hi\ntext")
    (tmp_path / "node_modules" / "y.md").write_text("no")
    (tmp_path / "z.txt").write_text("no")
    rows = S.markdown_files(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.text) for r in rows] == [("x.md", "# Hi\ntext")]
    t = spark.createDataFrame([("s", "p", "o", "other", "other", "f", 0.5)], "subject string, predicate string, object string, subject_type string, object_type string, source_file string, confidence double")
    S.write_triples(t, str(tmp_path / "t"))
    assert S.read_triples(spark, str(tmp_path / "t")).collect() == t.collect()
    S.append_jsonl(t, str(tmp_path / "j"))
    S.append_jsonl(t, str(tmp_path / "j"))
    assert S.read_jsonl(spark, str(tmp_path / "j"), "subject string").count() == 2


def test_manifest(spark):
    make = lambda rows: spark.createDataFrame(rows, "path string, sha256 string")
    diff = I.manifest_diff(make([("a", "1"), ("b", "1"), ("c", "1")]), make([("a", "1"), ("b", "2"), ("d", "1")]))
    assert {(r.path, r.status) for r in diff.collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "deleted"), ("d", "new")}
    store = spark.createDataFrame([("a", "h1", "x"), ("b", "h2", "y"), ("c", "h1", "x")], "path string, content_hash string, chunk string")
    chunks = spark.createDataFrame([("b", "new"), ("b", "new"), ("d", "x"), ("a", "x")], "path string, chunk string")
    assert {(r.path, r.chunk) for r in I.apply_manifest(store, diff, chunks).collect()} == {("a", "x"), ("b", "new"), ("d", "x")}


def test_streams_match_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("text"), F.col("user_id").alias("mem_id"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    for name, job, mode in (("access", jobs.access_counts, "complete"), ("windows", lambda e: jobs.windowed_counts(e, "user_id"), "complete"), ("sessions", lambda e: jobs.session_counts(e, "user_id"), "complete")):
        stream = job(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, job(events).collect()))
    seen = []
    q = jobs.upserts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), lambda b: seen.append(b.count()), str(tmp_path / "c"))
    q.awaitTermination()
    assert sum(seen) == events.count()


def test_package_stands_without_optional_parts():
    import subprocess
    import sys

    code = "import sys; sys.modules['mnemospark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_links_are_all_candidates_of_denoised_active_rows(spark):
    rng = np.random.default_rng(4)
    n, dim, k = 60, 8, 3
    m = rng.normal(size=(n, dim)) + 2
    ts, merged, files = rng.integers(0, 100000, n).astype(float), rng.random(n) < 0.2, [["a", "b", ""][i % 3] for i in range(n)]
    df = spark.createDataFrame([(i, m[i].tolist(), ts[i].item(), files[i], bool(merged[i])) for i in range(n)], "id long, vector array<double>, timestamp double, source_file string, merged boolean")
    ids = np.flatnonzero(~merged)
    x = m[ids] - m[ids].mean(axis=0)
    _, _, basis = np.linalg.svd(x, full_matrices=False)
    x = x @ basis[3:].T
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = {}
    for i in range(len(ids)):
        for j in np.argsort(-s[i])[: 2 * k]:
            a, b = int(ids[i]), int(ids[j])
            w = 0.85 * max(0, s[i, j]) + 0.15 * np.exp(-((ts[a] - ts[b]) ** 2) / (2 * 43200.0**2)) + (0.05 if files[a] and files[a] == files[b] else 0)
            if w > 0.4:
                want[a, b] = round(w, 3)
    got = {(r.src, r.dst): r.weight for r in graph.link_neighbors(df, dim, k).collect()}
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 0.0011 for e in want)
    assert max(sum(a == i for a, _ in got) for i in ids.tolist()) > k


def test_concept_tokens_are_unicode(spark):
    texts = ["Schön ÜBERALL naïve_x ab1 größer, über 東京都庁 _a_b", "plain words here", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", T.concept_tokens(F.col("text")).alias("w")).collect()
    assert {r.id: set(r.w) for r in rows} == {i: {w.lower() for w in re.findall(r"\b\w{4,}\b", t)} for i, t in enumerate(texts)}


def brute_sessions(turns):
    """The reference's rules over (role, text, timestamp), as (text, turns)."""
    made, now, first = [], [], None
    for role, text, ts in turns:
        opens = role in ("user", "system")
        if now and opens and (first and ts and abs(ts - first) > 1800 or any(r == "assistant" for r, _ in now)):
            made.append(now)
            now, first = [], None
        now.append((role, text))
        if ts and (first is None or ts < first):
            first = ts
    made = [("\n\n".join(t if r == "note" else f"[{r}] {t}" for r, t in x), len(x)) for x in [*made, now] if x]
    merged = [made[0]]
    for text, n in made[1:]:
        if len(merged[-1][0]) + len(text) <= 800:
            merged[-1] = (merged[-1][0] + "\n\n---\n\n" + text, merged[-1][1] + n)
        else:
            merged.append((text, n))
    return [(p, n) for text, n in merged for p in ([text] if len(text) <= 1500 else C._packed(re.split(r"\n{2,}", text), 1500, "\n\n", 2))]


def test_sessions_break_at_gaps_and_split_long_chunks(spark):
    rng = np.random.default_rng(6)
    convs = {0: [("user", "a" * 900, 1000), ("user", "b" * 900, 2000), ("user", "c", 2900), ("user", "d", 100), ("assistant", "e", 9000), ("user", "f", None)]}
    for c in range(1, 30):
        convs[c] = [(str(rng.choice(["user", "assistant", "system"])), "\n\n\n".join("xy " * int(k) + "z" for k in rng.integers(1, 300, rng.integers(1, 5))), [None, int(rng.integers(1, 6000))][int(rng.integers(2))]) for _ in range(rng.integers(1, 9))]
    df = spark.createDataFrame([(c, k, *t) for c, ts in convs.items() for k, t in enumerate(ts)], "conv_id long, turn int, role string, text string, timestamp long")
    rows = C.merge_exchanges(C.exchanges(df)).orderBy("conv_id", "chunk_index").collect()
    got = {c: [(r.text, r.turn_count) for r in rows if r.conv_id == c] for c in convs}
    assert got == {c: brute_sessions(ts) for c, ts in convs.items()}


def test_injection_is_of_recalled_reliable_memories(spark):
    hour = 3600.0
    rows = [(1, [1.0, 0.0], "<result>x</result> it crashed and failed again", 0.0, None), (2, [1.0, 0.0], "fine words" + " " * 9, 0.0, None), (3, [1.0, 0.1], "old words", -1000 * hour, None), (4, [0.9, 0.1], "used words", -10 * hour, 0.5), (5, [0.0, 1.0], "far words", 0.0, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, text string, timestamp double, importance_score double")
    access = spark.createDataFrame([(4, 20)], "mem_id long, n long")
    cos = 0.9 / np.hypot(0.9, 0.1)
    used = cos * np.exp(-0.05) * np.exp(-0.1) + 0.15 * 0.5 * np.exp(-0.05) + 0.05 * np.log(21)
    lines = retrieval.recall_injection(df, [1.0, 0.0], 0.0, access).first().lines
    assert lines == f"\n[MEM]\n[{round(used, 4)}] used words\n[1.0] fine words"
    assert retrieval.recall_injection(df.where("id = 5"), [1.0, 0.0], 0.0, access).collect() == []


def test_skill_commands_of_meta_files(spark):
    rows = [("skills/web/_meta.json", '{"commands": ["a b", "c", "d", "e", "f", "g"], "x": 1}'), ("skills/bad/_meta.json", "{"), ("skills/none/_meta.json", '{"x": 1}'), ("skills/web/SKILL.md", "text")]
    got = kg.extract_skills(spark.createDataFrame(rows, "source_file string, text string")).collect()
    assert {(r.subject, r.predicate, r.object, r.confidence, r.source_file) for r in got} == {("agent", "has_skill", "web", 1.0, rows[3][0]), *(("web", "has_command", c, 0.9, rows[0][0]) for c in ("a b", "c", "d", "e", "f"))}


def test_text_functions_read_patterns_as_python_does(spark):
    import re

    odd = ["it failed\rto start", "a b  ", " 　x\x1c", "größe straße über naïveté x", "user: \nhi\n\n\n\nyo\u0085", "[Telegram größe x]\n text", "<größe a=1>t</größe>", "A. B! C", "\n\n\n", ""]
    rows = spark.createDataFrame(list(enumerate(odd)), "id long, text string")
    t = F.col("text")
    got = {r.id: r for r in rows.select("id", T.stripped(t).alias("s"), T.sanitize(t).alias("c"), T.remove_tags(t).alias("g"), T.concept_tokens(t).alias("w"), T.verdict(t).alias("v")).collect()}
    for i, x in enumerate(odd):
        clean = x
        for p in T.REMOVALS:
            clean = re.sub(p, "", clean)
        assert got[i].s == x.strip() and got[i].g == re.sub(T.TAG, "", x)
        assert got[i].c == re.sub(r"\n{3,}", "\n\n", clean).strip()
        assert set(got[i].w) == set(re.findall(r"\b\w{4,}\b", x.lower()))
        hits = [p for c in T.PATTERNS for p in T.PATTERNS[c] if re.search(p, x, re.I)]
        assert set(got[i].v.patterns) <= set(hits) and bool(got[i].v.patterns) == bool(hits)
    assert got[0].v.is_flagged and got[3].w == ["größe", "straße", "über", "naïveté"]


def test_markdown_keeps_fences_and_any_text(spark):
    fence = "```py\n# not a heading\n" + "x = 1\n" * 500 + "```"
    for text in ("__CODE_BLOCK_3__ stays", f"# A\n\nBefore. {'Some words here. ' * 150}\n{fence}\nafter\n## B\n{fence}", "```\nnever closed"):
        chunks = C.split_markdown(text)
        assert sum(c.count(fence) for c, _ in chunks) == text.count(fence) and text[-20:].strip() in chunks[-1][0]
    assert [h for _, h in C.split_markdown("# A\n" + "a " * 150 + "\n# B\n" + "b " * 150)] == ["# A", "# B"]


def test_stems():
    from mnemospark.functions.stem import stem

    known = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration digitizer:digit vietnamization:vietnam decisiveness:decis sensibiliti:sensibl formative:form goodness:good revival:reviv adjustable:adjust replacement:replac adoption:adopt probate:probat rate:rate cease:ceas controll:control roll:roll at:at größe:größe"
    assert all(stem(w) == s for w, s in (x.split(":") for x in known.split()))


def test_keyword_search_matches_stems(spark):
    df = spark.createDataFrame([(1, "we deployed it"), (2, "Deploying, again"), (3, "depot"), (4, None), (5, "déployed")], "id long, text string")
    assert {r.id for r in retrieval.bm25(df, ["deploys"]).collect()} == {1, 2, 5}


def test_gaps_since_first_is_a_loop(spark):
    import random

    rng = random.Random(5)
    rows = [(k, rng.randrange(50_000), i) for i, k in enumerate(rng.choices([None, 1, 2, 3, 4], k=900))] + [(9, None, 1000)]
    df = spark.createDataFrame(rows, "user_id long, epoch long, event_id long")
    want, state = set(), {}
    for k, e, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0], r[1], r[2])):
        first, n = state.get(k, (e, 0))
        if e - first > 1800:
            first, n = e, n + 1
        state[k] = first, n
        want.add((k, i, n))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {tuple(r) for r in C.gaps_since_first(df, "user_id").collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert C.gaps_since_first(df.limit(0), "user_id").collect() == []


def test_context_is_cut_before_the_join(spark):
    from mnemospark.operators import kg

    triples = spark.createDataFrame([("redis", "runs", f"x{i}", i / 100) for i in range(40)] + [("redis", "runs", "x39", 0.1)], "subject string, predicate string, object string, confidence double")
    asked = spark.createDataFrame([(q, "is redis up?") for q in range(3)], "qid int, text string")
    found = kg.context(triples, asked).collect()
    assert {(r.qid, r.object) for r in found} == {(q, f"x{i}") for q in range(3) for i in range(30, 40)}
    assert kg.context_summary(kg.context(triples, asked)).where("qid = 0").first().summary == "Types: other(10), service(10); Relations: runs(10)"


def test_last_user_message_in_parts(spark):
    parts = "array<struct<type:string,text:string>>"
    rows = [(1, 1, "user", [("text", "[Telegram x] a"), ("image", "no"), ("text", "b")]), (1, 2, "assistant", [("text", "z")]), (2, 1, "user", [])]
    df = spark.createDataFrame(rows, f"conv_id int, turn int, role string, text {parts}")
    assert {(r.conv_id, r.text) for r in retrieval.last_user_message(df).collect()} == {(1, "a b"), (2, "")}


def test_embedding_of_blank_and_equal_texts(spark):
    from mnemospark.operators import vectors as V

    asked = []
    rows = V.embed(spark.createDataFrame([(1, "a"), (2, "a"), (3, " "), (4, None)], "id int, text string").coalesce(1), 3).orderBy("id").collect()
    assert rows[0].vector == rows[1].vector and any(rows[0].vector) and rows[2].vector == rows[3].vector == [0.0] * 3 and asked == []


def test_a_listing_sorts_no_more_texts_than_it_shows(spark):
    rows = [(i, f"text {i}", "s") for i in range(2000)] + [(7, None, "s"), (None, "no id", "s"), (None, None, "s")]
    df = spark.createDataFrame(rows, "id long, text string, source_file string").repartition(8)
    got = [(r.id, r.text) for r in S.listing(df, 12).collect()]
    assert sorted(got[:2]) == [(None, ""), (None, "no id")] and [i for i, _ in got[2:]] == [0, 1, 2, 3, 4, 5, 6, 7, 7, 8]
    assert S.listing(df.where("id is null"), 12).count() == 2 and S.listing(df.limit(0), 12).count() == 0
    assert "subquery" in S.listing(df, 12)._jdf.queryExecution().toString()  # the cut is known before texts are sorted


def test_texts_are_split_in_slices(spark, monkeypatch):
    import pyarrow as pa

    sizes = []
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["A note. " * 30] * 1000)], ["id", "text"])

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            sizes.extend(b.num_rows for b in run(iter([batch, batch.slice(0, 0)])))

    C._split(Rows(), lambda t: [(t, "")])
    assert sum(sizes) == 1000 and max(sizes) <= 256


def test_memories_leave_out_other_texts_before_the_join(spark, tmp_path):
    """Texts and events outside of the vectors' ids are filtered where they are read; the rows are those of the plain join."""
    from mnemospark.plans import fixtures

    sf = "/root/testdata/sf0.001"
    for t in ("documents", "events"):
        fixtures.read(spark, sf, t).write.parquet(f"{tmp_path}/{t}.parquet")
    e = fixtures.read(spark, sf, "embeddings")
    for rows, want in ((e.where("vec_id between 40 and 60 and vec_id <> 50"), {*range(40, 61)} - {50}), (e.where("vec_id >= 190"), {*range(190, 200)}), (e.limit(0), set())):
        rows.write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        got = fixtures.memories(spark, str(tmp_path))
        assert {r.id for r in got.select("id").collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all(any(c in line and "scalar-subquery" in line for line in plan.splitlines() if "Filter" in line) for c in ("doc_id", "event_id"))


def test_add_decision_writes_no_texts(spark):
    """The longest texts only leave their hashes; equal and null texts, rejected rows and near vectors get what they got."""
    import os

    from mnemospark.sources import tables

    long = "a sentence about the weather in march. " * 4
    salt = lambda i: "".join(chr(97 + int(x)) for x in np.random.default_rng(i).integers(0, 26, 20_000))
    rows = [(1, long + salt(1), [0.0, 1.0]), (2, long + salt(1), [5.0, 5.0]), (3, None, [9.0, 9.0]), (4, None, [7.0, 7.0]), (5, long + salt(5), [0.0, 1.1]), (6, "x", [1.0]), (7, "This is broken <result>x</result>", [3.0, 3.0])]
    df = spark.createDataFrame(rows, "id long, text string, vector array<double>")
    first = len(tables.MADE)
    got = sorted(map(tuple, maintenance.add_decision(df, 2, 0.05).collect()))
    assert got == [(1, 1, "added"), (2, 1, "exact"), (3, 3, "added"), (4, 4, "added"), (5, 1, "semantic"), (6, -1, "dimension"), (7, -1, "unreliable")]
    made = sum(os.path.getsize(os.path.join(d, f)) for top in tables.MADE[first:] for d, _, names in os.walk(top.removeprefix("file://")) for f in names)
    assert made < 30_000
