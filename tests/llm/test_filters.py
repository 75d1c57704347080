"""Quality, toxicity, URL and contamination filters: brute force, SQL, held-out accuracy, odd rows."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from mnemospark.llm import _linear, decontaminate, divergence, queries, ranking, simhash, toxicity, url_filter

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


def test_divergence_counts_are_brute_force(docs):
    word, texts = re.compile(r"[^\x20\x09-\x0D]+"), {r.doc_id: r.text for r in docs.collect()}
    rows = divergence.judge(docs).collect()
    for r in rows:
        t = texts[r.doc_id]
        w, lines = word.findall(t), [x for x in t.split("\n") if word.search(x)]
        times = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if times[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w))
        assert want == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert not (r.kept and r.base_failed)


def test_divergence_keeps_good_and_drops_bad(docs, labels):
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(quality[r.doc_id], r.kept) for r in divergence.judge(docs).collect() if r.doc_id in quality and not r.base_failed]
    assert sum(k for q, k in rows if q) >= 0.99 * sum(q for q, _ in rows)
    assert sum(not k for q, k in rows if not q) >= 0.9 * sum(not q for q, _ in rows)


def test_js_distance():
    assert divergence.js_distance(np.array([[1.0, 0.0]]), np.array([0.0, 1.0]))[0] == pytest.approx(1)
    assert divergence.js_distance(np.array([[0.3, 0.7]]), np.array([0.3, 0.7]))[0] == pytest.approx(0)


def test_divergence_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b", None), (1, None, "en"), (2, "", "en"), (2, "A  a ½  ", "en")], "doc_id long, text string, lang string").selectExpr("*", "1 as kept", "2 as word")
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.kept) for r in divergence.judge(df).collect())
    assert got == Counter([(None, 2, 2, False), (1, 0, 0, False), (2, 0, 0, False), (2, 3, 3, False)])
    assert divergence.judge(df.limit(0)).collect() == []


def accuracy(rows, label):
    held = [r for r in rows if r.held_out and r.doc_id in label]
    return sum(r.predicted == label[r.doc_id] for r in held) / len(held)


def test_ranking_held_out(docs, labels):
    rows = ranking.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert accuracy(rows, {r.doc_id: r.quality for r in labels.collect()}) > 0.97


def test_toxicity_held_out(docs, labels):
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert accuracy(rows, {r.doc_id: r.toxic for r in labels.collect()}) > 0.95
    kept = toxicity.clean(docs, labels)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}


@pytest.mark.parametrize("module", [ranking, toxicity])
def test_classifiers_odd_rows(spark, labels, module):
    df = spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (2, "A  a ½ idiot"), (3, "word " * 20_000)], DOC).selectExpr("*", "1 as quality", "2 as score", "3 as id", "4 as __label", "5 as label", "6 as __id")
    odd = labels.limit(3).union(spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 0), (2, 1, 1)], labels.schema))
    for given in (labels, odd, labels.limit(0)):
        assert Counter(r.doc_id for r in module.classify(df, given).collect()) == Counter([None, 1, 2, 2, 3])
    assert module.classify(df.limit(0), labels).collect() == []


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    fired = np.zeros((4000, 4), np.float32)
    fired[:, 0] = np.where(y, rng.random(4000) < 0.5, rng.random(4000) < 0.01)
    fired[:, 1] = fired[:, 0]  # a copy of the first
    fired[:, 2] = rng.random(4000) < 0.2
    fired[:, 3] = ~fired[:, :2].any(axis=1)
    m = toxicity.LabelModel(fired, y)
    assert m.accuracy[0] > 0.9 and abs(m.accuracy[2] - 0.3) < 0.1 and m.accuracy[3] < 0.3
    assert (m.groups[0] == m.groups[1]).all() and not (m.groups[0] == m.groups[2]).all()


def test_logistic():
    x = np.random.default_rng(1).normal(size=(2000, 2))
    w = _linear.logistic(x, _linear.sigmoid(x @ np.array([2.0, -1.0])))
    assert np.allclose(w, [2, -1], atol=0.1)


def plain_rule(url):
    after = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", after).group()
    path = re.match(r"[^?#]*", after[len(host) :]).group()
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filter.RULES if (low == r[1] or low.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return low, path, best and best[1] + best[2], best and best[0]


@pytest.mark.parametrize(("most", "hot"), [(500_000, 1 << 20), (0, 3)])
def test_url_rules_are_brute_force(spark, monkeypatch, most, hot):
    monkeypatch.setattr(url_filter, "MAX_BROADCAST", most)
    monkeypatch.setattr(url_filter, "HOT", hot)
    odd = [None, "", "no scheme", "http://COM/en/1", "http://x.com/en/7", "http://example.com/en/7?x", "http://a.example.net/de/8#y", "http://notnet/de/8", "ftp://b.net/de/", "x://net", "http://net?/de/", "http://Ünet.net/de/é", "http://org/es/\n1"]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").union(spark.createDataFrame([(10**6 + i, u) for i, u in enumerate(odd)] + [(None, "http://net/de/"), (None, "http://net/de/")], "page_id long, url string"))
    rows = url_filter.judge(pages).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in rows) == Counter((r.page_id, *plain_rule(r.url)[:3]) for r in pages.collect())
    verdict = {r.page_id: plain_rule(r.url)[3] for r in pages.collect()}
    assert all(r.verdict == (verdict[r.page_id] or r.verdict) and r.verdict in ("allow", "block") for r in rows)
    assert url_filter.judge(pages.limit(0)).collect() == []


def test_url_model_is_brute_force(spark):
    import hashlib
    from math import log

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")

    def grams(u):
        low = u.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"))
        t = "^^^" + re.sub(r"[^a-z0/.\-?=&#:_%]", "~", low) + "$"
        return [t[i : i + 4] for i in range(len(t) - 3)]

    urls = {r.url for r in pages.collect()}
    n = {"allow": Counter(), "block": Counter()}
    for u in urls:
        v = plain_rule(u)[3]
        if v and hashlib.md5(u.encode()).hexdigest()[0] not in "012":
            for g in grams(u):
                n[v].update(g[4 - k :] for k in range(1, 5))
    inside = {v: Counter() for v in n}
    kinds = {v: Counter() for v in n}
    for v, c in n.items():
        for s, x in c.items():
            inside[v][len(s), s[:-1]] += x
            kinds[v][len(s), s[:-1]] += 1

    def p(v, g):
        out = 1 / 39
        for k in range(1, 5):
            s = g[4 - k :]
            if inside[v][k, s[:-1]]:
                out = (n[v][s] + kinds[v][k, s[:-1]] * out) / (inside[v][k, s[:-1]] + kinds[v][k, s[:-1]])
        return out

    want = {u: sum(log(p("allow", g)) - log(p("block", g)) for g in grams(u)) / len(grams(u)) for u in urls}
    url = {r.page_id: r.url for r in pages.collect()}
    assert all(abs(r.score - want[url[r.page_id]]) < 1e-6 for r in url_filter.judge(pages).collect())


def test_decontamination_is_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.op10_decontaminate(spark, SF)
    cols = sorted(got.columns)
    want = con.sql(decontaminate.SQL).project(",".join(cols)).fetchall()
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(want) and any(r[0] for r in want)


@pytest.mark.parametrize(("most", "bits"), [(200_000, 27), (0, 15), (0, 3)])
def test_decontamination_odd_rows(spark, monkeypatch, most, bits):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", most)
    monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
    docs = spark.createDataFrame([(1, "x, Aa bB? cc"), (2, None), (None, "AA BB"), (3, "zz"), (4, "éa É" + " q" * 100)], DOC).selectExpr("*", "1 as row", "2 as gram", "3 as bad_id", "4 as BAD_DIGEST", "5 as bad_found")
    bench = spark.createDataFrame([(1, "aa  bb"), (None, "zz"), (4, ""), (5, None), (6, "é")], "item_id long, text string")
    rows = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.judge(docs, bench).collect()}
    assert rows == {1: (4, 2, 1, True), 2: (0, 0, 0, False), None: (2, 2, 1, True), 3: (1, 1, 0, True), 4: (102, 0, 0, False)}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {2, 4}
    assert {r.doc_id: r.text for r in decontaminate.clean(docs, bench, spans=True).collect()} == {1: "x, cc", 2: None, None: "", 3: "", 4: "éa É" + " q" * 100}
    assert decontaminate.judge(docs.limit(0), bench).count() == 0 and not any(r.contaminated for r in decontaminate.judge(docs, bench.limit(0)).collect())


def test_only_windows_that_may_hit_are_spelt_out(spark):
    rng = np.random.default_rng(0)
    text = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 5000, k))
    bench = spark.createDataFrame([(i, text(400)) for i in range(150)], "item_id long, text string")
    grams = decontaminate.ngrams(bench, 13, "item_id", "text")
    bits = 1 << 22
    held = decontaminate.bitmap(grams, bits).first()["bits"]
    heads = [r[0] % bits for r in grams.select("head").collect()]
    assert len(heads) > 50_000 and sum(bin(b).count("1") for b in held) == len(set(heads)) and all(held[h >> 3] >> (h & 7) & 1 for h in heads)
    w = spark.createDataFrame([(text(2000).split(),) for _ in range(20)], "w array<string>")
    from pyspark.sql import functions as F

    begun = w.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 4), decontaminate._heads(4))).alias("h")).where(decontaminate._held(F.lit(bytes(held)), F.col("h"), bits))
    assert begun.count() < 0.03 * 20 * 1988


def test_the_filter_is_in_no_plan(spark, monkeypatch):
    """Items of all sizes, and a filter of 16 MB: the plan stays short, and the results those of equality."""
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 27)
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(i))) for i in range(1, 20)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "x y " * 30 + " ".join(f"w{i}x{k}" for k in range(i)) + " z" * i) for i in range(1, 20)], DOC)
    got = decontaminate.judge(docs, bench)
    assert {r.doc_id: (r.n_hit, r.n_items) for r in got.collect()} == {i: (i, 1) for i in range(1, 20)}
    whole = decontaminate.hits(docs, bench)
    assert len(spark._jvm.PythonSQLUtils.explainString(whole._jdf.queryExecution(), "extended")) < 300_000
    assert [decontaminate.size_of(n) for n in (0, 10**6, 10**8, 10**10)] == [1 << 27, 1 << 27, 1 << 30, 1 << 30]


def test_items_join_late(spark):
    """Every item has one n-gram that every document has, too: lists of items are made a document, not a window."""
    text = " ".join(f"w{k}" for k in range(13))
    bench = spark.createDataFrame([(i, text) for i in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{text} x {text} x {text}") for i in range(40)], DOC)
    assert {(r.n_hit, r.n_items) for r in decontaminate.judge(docs, bench).collect()} == {(39, 300)}


@pytest.mark.parametrize("module", [ranking, toxicity])
def test_classifiers_do_not_depend_on_the_order_of_rows(docs, labels, module):
    a, b = ({r.doc_id: r.score for r in module.classify(d, labels).collect()} for d in (docs, docs.repartition(7).orderBy("text")))
    assert max(abs(a[i] - b[i]) for i in a) < 1e-9


def test_pairs_are_all_pairs():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0.5, 1, (70, 3)), rng.normal(0, 1, (50, 3))
    w = _linear.pairwise(good, bad, ridge=1e-3, block=16)

    def loss(v):
        return np.log1p(np.exp(-(good @ v)[:, None] + (bad @ v)[None, :])).mean() + 1e-3 * (v @ v) / 2

    assert all(loss(w) <= loss(w + d) + 1e-9 for d in rng.normal(0, 0.05, (200, 3)))
    x, y = np.vstack([good, bad]), np.r_[np.ones(70), np.zeros(50)]
    score = ranking.Model(x, y).score(x)
    assert abs((score >= 0.7).mean() - 70 / 120) < 0.02  # the quantile that the share of worse texts marks


def test_label_model_is_the_enumerated_posterior():
    """The posterior of every pattern of votes against Bayes' rule written out, and the fixed point of the estimation; half of the texts are labelled."""
    rng = np.random.default_rng(3)
    y, named = rng.random(6000) < 0.4, np.arange(6000) < 3000
    fired = np.column_stack([np.where(y, rng.random(6000) < a, rng.random(6000) < b) for a, b in ((0.6, 0.1), (0.5, 0.05), (0.2, 0.4))]).astype(np.float32)
    m = toxicity.LabelModel(fired, np.where(named, y, y[named].mean()), rounds=60)
    for votes in {tuple(x) for x in fired.tolist()}:
        toxic, other = (p * np.prod([r if v else 1 - r for r, v in zip(rates, votes)]) for p, rates in zip((m.prior, 1 - m.prior), m.rates))
        assert abs(m.posterior(np.array([votes], np.float32))[0] - toxic / (toxic + other)) < 1e-5
    assert (m.told[named] > 0.5).tolist() == y[named].tolist()
    q = np.where(named, y, m.posterior(fired))
    for rates, w in zip(m.rates, (q, 1 - q)):
        assert np.allclose((fired.T @ w + 0.5) / (w.sum() + 1), rates, atol=0.01)
    assert np.allclose(m.rates[0], (0.6, 0.5, 0.2), atol=0.05) and np.allclose(m.rates[1], (0.1, 0.05, 0.4), atol=0.05)
    assert ((m.posterior(fired) >= 0.5) == y)[~named].mean() > 0.75


def test_clean_keeps_rows_as_they_are(spark, labels):
    rows = [(None, "a b", 1, 2), (1, None, 1, 2), (2, "", 1, 2), (2, "", 1, 2), (3, "x", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id int, score int")
    assert Counter(map(tuple, toxicity.clean(df, labels).collect())) == Counter(rows)
    assert toxicity.clean(df.limit(0), labels).collect() == []


def test_labels_count_without_stems(spark):
    """Labels of both kinds are learnt from though no stem is mined: the fixed voters get their rates from them."""
    texts = [f"you stupid idiot {k}" if k % 2 else f"a calm day number {k}" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    plain = {r.doc_id: r.score for r in toxicity.classify(docs, labels.limit(0)).collect()}
    assert scores != plain and min(scores[k] for k in range(1, 40, 2)) > max(scores[k] for k in range(0, 40, 2))


def test_hot_rows_without_ids_are_dealt(spark, monkeypatch):
    """Rows of a hot fingerprint whose ids are null go to many tasks, and to right results."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(simhash, "HOT", 50)
    docs = spark.createDataFrame([(None, "one text that all have")] * 600 + [(7, "one text that all have"), (8, "another text altogether here")], "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 602 and {(r.doc_id, r.component_id) for r in got} == {(None, 7), (7, 7), (8, 8)}
    url = spark.createDataFrame([(None, "http://a.com/x")] * 300 + [(1, "http://b.org/es/y")], "page_id long, url string")
    monkeypatch.setattr(url_filter, "HOT", 50)
    assert url_filter.judge(url).groupBy(F.col("page_id").isNull()).count().orderBy("count").collect()[1][1] == 300
