"""A store's operations, end to end."""

import pytest

from mnemospark.operators import kg
from mnemospark.service import MemoryStore

KIND = "id long, vector array<double>, text string, timestamp double, relevance double, merged boolean, importance_score double, access_counter long, label int, source_file string"


def row(i, v, text, label=0):
    return (i, v, text, 1000.0 * i, 0.5, False, None, 0, label, "f")


@pytest.fixture()
def store(spark):
    rows = [row(1, [1.0, 0.0], "red fox runs"), row(2, [0.0, 1.0], "blue dog sleeps"), row(3, [0.7, 0.7], "red dog")]
    return MemoryStore(spark.createDataFrame(rows, KIND), 2)


def test_add(spark, store):
    new = [row(10, [1.0, 0.0], "red fox runs"), row(11, [0.999, 0.001], "another text"), row(12, [-1.0, 0.0], "it crashed"), row(13, [-1.0, 0.0], "fresh"), row(14, [1.0], "short")]
    after, got = store.add(spark.createDataFrame(new, KIND))
    assert {r.id: r.result_id for r in got.collect()} == {10: 1, 11: 1, 12: -1, 13: 13, 14: -1}
    assert {r.id for r in after.memories.collect()} == {1, 2, 3, 13}


def test_search(store):
    rows = store.search([1.0, 0.0], ["red"], 4000.0, top_k=2).orderBy("rank").collect()
    assert [r.id for r in rows] == [3, 1]
    for bad in (dict(top_k=0), dict(alpha=2), dict(min_score=-1)):
        with pytest.raises(ValueError):
            store.search([1.0, 0.0], ["red"], 0.0, **bad)
    with pytest.raises(ValueError):
        store.search([1.0], ["red"], 0.0)


def test_changes(store):
    assert store.update_relevance(2, 0.9).memories.where("id = 2").first().relevance == 0.9
    with pytest.raises(KeyError):
        store.update_relevance(99, 1)
    after, groups = store.consolidate()
    assert groups.first().summary == "red fox runs; blue dog sleeps; red dog" and after.stats().first().active == 0
    assert store.prune(86400.0 * 60, max_age_days=30).memories.count() == 0 and store.page(1, 1).first().total == 3 and [(r.id, r.total) for r in store.page(50, 5).collect()] == [(None, 3)]


def test_build_keeps_the_most_certain(spark):
    f = lambda t: spark.createDataFrame([("x", t)], "source_file string, text string")
    rows = kg.build(memory=f("- added Retry logic"), daily=f("Conversation summary\nadded retry logic"), tasks=f("- [x] do it")).collect()
    assert {(r.predicate, r.object, r.confidence) for r in rows} == {("added", "Retry logic", 0.9), ("has_task", "do it", 0.7)}


def test_more_operations(spark, store, tmp_path):
    assert store.delete(2).memories.count() == 2 and store.health()["memories"] == 3
    with pytest.raises(KeyError):
        store.delete(99)
    log = spark.createDataFrame([(1, 5.0, "q")], "mem_id long, ts double, query string")
    found, more = store.recall([1.0, 0.0], "red fox", 4000.0, log, k=2)
    assert more.count() == 1 + found.count() > 1
    assert store.recall([1.0, 0.0], "zebra", 4000.0, log, terms=["zebra"])[0].count() == 0
    assert {r.mem_id for r in store.access_stats(more).collect()} >= {1}
    bad = MemoryStore(store.memories.union(spark.createDataFrame([row(4, [1.0, 1.0], "it crashed and keeps failing")], KIND)), 2)
    same, report = bad.purge()
    assert same is bad and [r.id for r in report.collect()] == [4] and bad.purge(dry_run=False)[0].memories.count() == 3
    triples = spark.createDataFrame([("a", "uses", "redis", "other", "service")], "subject string, predicate string, object string, subject_type string, object_type string")
    whole = MemoryStore(store.memories, 2, triples)
    assert whole.kg_stats()["object_types"].collect()[0].name == "service"
    whole.save(str(tmp_path))
    store.delete(1).save(str(tmp_path))
    last = MemoryStore.open(spark, str(tmp_path))
    assert last.memories.count() == 2 and last.triples is None and last.dim == 2


def test_add_judges_only_the_rows(spark, store):
    stored = store.memories.union(spark.createDataFrame([row(4, [0.0, -1.0], "it crashed")], KIND))
    new = [row(20, [0.5, -0.9], "it crashed"), row(21, [0.0, -1.0], "calm"), row(22, [-1.0, 0.0], "one"), row(23, [-0.99, 0.0], "two"), row(24, [5.0, 5.0], "one")]
    _, got = MemoryStore(stored, 2).add(spark.createDataFrame(new, KIND))
    assert {r.id: (r.result_id, r.reason) for r in got.collect()} == {20: (-1, "unreliable"), 21: (4, "semantic"), 22: (22, "added"), 23: (22, "semantic"), 24: (22, "exact")}
