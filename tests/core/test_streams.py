"""Stateful streams against their batch forms, over shuffled micro-batches and a restart."""

import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import chunking
from mnemospark.streaming import state

HOUR = 3600


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, state.PROVIDER)
    yield spark
    spark.conf.unset(key)


def drained(spark, df, schema, make, tmp_path, parts=3):
    """What a stream over micro-batches of the rows, in two runs of one checkpoint, gives."""
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rows = df.collect()
    halves = [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    for half in halves:
        for k in range(parts):
            spark.createDataFrame(half[k * len(half) // parts : (k + 1) * len(half) // parts], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        q = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
    return spark.read.parquet(out)


def brute_tier(events, ttl, hot, least, now):
    log, expires, reads = [], {}, {}
    ids = {e[0] for e in events}
    for i in sorted(ids):
        expires[i], reads[i] = None, 0
        for at, kind, imp in sorted(((e[2], e[1], e[3]) for e in events if e[0] == i), key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0)):
            if expires[i] is not None and expires[i] < at:
                log.append((i, "expired", expires[i], expires[i], None))
                expires[i] = None
            if kind == "add":
                log.append((i, "admitted" if expires[i] is None else "refreshed", at, at + ttl, 1.0 if imp is None else imp))
                expires[i] = at + ttl
            elif kind == "access":
                reads[i] += 1
                if expires[i] is None and reads[i] > least:
                    expires[i] = at + hot
                    log.append((i, "promoted", at, expires[i], min(5.0, 1 + reads[i] / 100)))
        if expires[i] is not None and expires[i] < now:
            log.append((i, "expired", expires[i], expires[i], None))
    return sorted(log, key=repr)


def test_fast_tier(rocks, tmp_path):
    """Admission, refresh, promotion and expiry: the batch form is the rules, and the stream is the batch form, whatever the micro-batches and over a restart."""
    spark, rng = rocks, random.Random(1)
    ms = 1000 * HOUR
    made = sorted((rng.randrange(0, 400 * ms), rng.randrange(5), rng.choice(["add", "access", "access", "access", "other"]), rng.choice([None, 0.5, 2.0])) for _ in range(160))
    near = [made[k : k + 4] for k in range(0, len(made), 4)]
    for part in near:
        rng.shuffle(part)
    events = [(i, kind, at, imp) for part in near for at, i, kind, imp in part]
    schema = "memory_id long, kind string, ts timestamp, importance double"
    frame = lambda rows: spark.createDataFrame([(i, k, a, v) for i, k, a, v in rows], "memory_id long, kind string, s long, importance double").select("memory_id", "kind", F.timestamp_millis("s").alias("ts"), "importance")
    args = dict(ttl_hours=24.0, hot_ttl_hours=48.0, least=5)
    want = brute_tier(events, 24 * ms, 48 * ms, 5, 900 * ms)
    batch = state.fast_tier(frame([*events, (None, "add", 5, 1.0), (1, "add", None, 1.0)]), as_of=900 * ms, **args)
    assert sorted(map(tuple, batch.collect()), key=repr) == want and {r[1] for r in want} == {"admitted", "refreshed", "promoted", "expired"}
    # a last event of another memory, far ahead, moves the watermark past all others
    got = drained(spark, frame([*events, (99, "other", 2000 * ms, None), (99, "other", 2001 * ms, None)]), schema, lambda s: state.fast_tier(s, "40 hours", **args), tmp_path)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    at = events[100][2]
    live = {r.memory_id: r.expires_at for r in state.live(batch, at).collect()}
    last = {}
    for i, action, when, until, _ in sorted(want, key=lambda r: (r[2], r[1] != "expired")):
        if when <= at:
            last[i] = None if action == "expired" else until
    assert live == {i: u for i, u in last.items() if u is not None and u >= at}
    assert state.fast_tier(frame([])).collect() == []


def test_anchored_sessions(rocks, tmp_path):
    spark, rng = rocks, random.Random(2)
    made = sorted((rng.randrange(0, 20 * HOUR), rng.choice(["a", "b"]), k) for k in range(120))
    near = [made[k : k + 5] for k in range(0, len(made), 5)]
    for part in near:
        rng.shuffle(part)
    rows = [r for part in near for r in part]
    frame = lambda rows: spark.createDataFrame(rows, "s long, who string, event_id long").select("who", "event_id", F.timestamp_seconds("s").alias("ts"))
    df = frame(rows)
    want = {tuple(r) for r in chunking.gaps_since_first(df.withColumn("epoch", F.unix_timestamp("ts")), "who").collect()}
    assert {tuple(r) for r in state.anchored_sessions(frame([*rows, (None, "a", 7), (5, None, 8)]), "who").collect()} == want and max(r[2] for r in want) > 5
    got = drained(spark, frame([*rows, (100 * HOUR, "z", -1), (101 * HOUR, "z", -2)]), "who string, event_id long, ts timestamp", lambda s: state.anchored_sessions(s, "who", "5 hours"), tmp_path)
    assert {tuple(r) for r in got.where("who <> 'z'").collect()} == want


def test_state_needs_its_store(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        spark.range(1).select(F.lit("a").alias("who"), F.lit(1).alias("event_id"), F.current_timestamp().alias("ts")).write.parquet(str(tmp_path / "in"))
        with pytest.raises(ValueError):
            state.anchored_sessions(spark.readStream.schema("who string, event_id int, ts timestamp").parquet(str(tmp_path / "in")), "who")
    finally:
        if before:
            spark.conf.set(key, before)
