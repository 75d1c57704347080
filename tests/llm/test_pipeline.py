"""The pipeline's stages, each against what its input says."""

import re

import pytest

cp = pytest.importorskip("corpus_pipeline")
from mnemospark.llm import decontaminate, simhash, toxicity  # noqa: E402
from mnemospark.llm._exchange import written  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] and len(cp.STAGES) == 5
    seen = [docs]
    for _, stage in cp.STAGES:
        seen.append(written(stage(spark, seen[-1], SF)))
    raw, civil, single, cut, clean, tokens = seen
    assert all(s.columns == docs.columns for s in seen[:-1])
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in seen]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids[1] == {r.doc_id for r in toxicity.classify(raw, labels).where("predicted = 0").collect()}
    assert ids[2] == {r.component_id for r in simhash.near_duplicates(civil).collect()}
    assert ids[3] == ids[2] and cut.where("n_chars <> char_length(text)").count() == 0
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids[4] == {r.doc_id for r in decontaminate.judge(cut, bench).where("not contaminated").collect()}
    assert ids[5] == ids[4] and tokens.where("n_tokens < 0").count() == 0
    texts, first = [(r.doc_id, r.text) for r in single.select("doc_id", "text").collect()], {}
    for i, t in sorted(texts):
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    kept = {r.doc_id: r.text for r in cut.collect()}
    assert all(kept[i] == t for i, t in texts if all(first[t.encode()[p : p + 50]] == i for p in range(len(t.encode()) - 49)))


def test_run_is_the_stages(spark):
    got = cp.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0


def test_no_bytes_outside_characters(spark):
    df = spark.createDataFrame([(1, "é" * 40, "en", "s", 40), (2, "aé" + "é" * 39 + "z", "en", "s", 42)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = {r.doc_id: (r.text, r.n_chars) for r in cp.cut_repeats(spark, df, SF).collect()}
    assert rows[1] == ("é" * 40, 40) and re.fullmatch("a?é*z", rows[2][0]) and rows[2][1] == len(rows[2][0])


ODD = [(None, "a b c d"), (None, "a b c d"), (3, None), (4, ""), (5, "word " * 20_000), (5, "word " * 20_000), (6, "unlike all the other texts here"), (2, "unlike all the other texts here"), (6, "its id is that of another row")]


def test_stages_take_odd_rows_and_empty_tables(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, None, "s", None) for i, t in ODD], kind)
    seen = [df]
    for _, stage in cp.STAGES:
        seen.append(written(stage(spark, seen[-1], SF)))
    kept = sorted((r.doc_id or 0, (r.text or "")[:6]) for r in seen[2].collect())
    assert kept == [(0, "a b c "), (0, "a b c "), (2, "unlike"), (3, ""), (5, "word w"), (5, "word w"), (6, "its id")]
    assert all(s.columns == df.columns for s in seen[:-1]) and seen[-1].count() == seen[4].count() == len(kept)
    import hashlib

    texts = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in seen[4].collect())
    assert sorted(r.decoded_sha256 for r in seen[5].collect()) == texts
    none = df.limit(0)
    for _, stage in cp.STAGES[:-1]:
        none = stage(spark, none, SF)
        assert none.columns == df.columns and none.count() == 0
    assert cp.encode(spark, none, SF).count() == 0
