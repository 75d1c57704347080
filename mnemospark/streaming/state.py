"""Stateful streams that keep the order of event time: the fast tier with expiry, and sessions anchored at their first event.

Rows of a key wait in its state until the watermark has passed them; a timer then applies all that it has passed, in
order of time, so what comes out does not depend on how rows were dealt to micro-batches, and is what
the batch form says of the same rows.  Rows that come later than the watermark are left
out.  The state store must be RocksDB's: ``spark.sql.streaming.stateStore.providerClass``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import folded

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000
GAP = 30 * 60


class Tier:
    """One memory in the fast tier: admitted by an addition, refreshed by the next, promoted by many accesses, gone when it expires.  Times are in milliseconds."""

    def __init__(self, ttl: int, hot_ttl: int, least: int, expires: int | None = None, reads: int = 0):
        self.ttl, self.hot_ttl, self.least, self.expires, self.reads = ttl, hot_ttl, least, expires, reads

    def until(self, now: int) -> Iterator[tuple[str, int, int, float | None]]:
        """(action, at, expires, importance) of expiry before ``now``."""
        if self.expires is not None and self.expires < now:
            yield "expired", self.expires, self.expires, None
            self.expires = None

    def take(self, at: int, kind: str, importance: float | None) -> Iterator[tuple[str, int, int, float | None]]:
        """The same of an event: ``add`` or ``access``; other kinds do nothing."""
        yield from self.until(at)
        if kind == "add":
            action, self.expires = "admitted" if self.expires is None else "refreshed", at + self.ttl
            yield action, at, self.expires, 1.0 if importance is None else importance
        elif kind == "access":
            self.reads += 1
            if self.expires is None and self.reads > self.least:
                self.expires = at + self.hot_ttl
                yield "promoted", at, self.expires, min(5.0, 1 + self.reads / 100)


class Anchored:
    """Sessions of one key: a new one begins more than ``gap`` after the open one's first event."""

    def __init__(self, gap: int, first: int | None = None, session: int = -1):
        self.gap, self.first, self.session = gap, first, session

    def take(self, at: int) -> int:
        if self.first is None or at > self.first + self.gap:
            self.first, self.session = at, self.session + 1
        return self.session


def _nulls_first(row: tuple) -> tuple:
    return tuple((v is not None, v) if v is not None else (False, 0) for v in row)


class _InOrder(StatefulProcessor):
    """Rows wait until the watermark has passed their time, then apply() sees them in order."""

    waiting, kept = "", ""  # schemas of what waits, its time first, and of what is kept of a key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.waiting)
        self.own = handle.getValueState("own", self.kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        due = set(self.handle.listTimers())
        for r in rows:
            new = self.wanted(r)
            self.pending.appendValue(new)
            if new[0] not in due:
                self.handle.registerTimer(new[0])
                due.add(new[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()  # all rows up to it are here, and later timers of this batch find them done
        rows = sorted(map(tuple, self.pending.get()), key=_nulls_first) if self.pending.exists() else []
        ready, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        if ready:
            self.pending.clear()
            if later:
                self.pending.put(later)
        yield from self.apply(key, ready, now)

    def close(self) -> None:
        pass


class _TierProcessor(_InOrder):
    waiting, kept = "at long, kind string, importance double", "expires long, reads long"

    def __init__(self, ttl: int, hot_ttl: int, least: int):
        self.args = ttl, hot_ttl, least

    def wanted(self, r: Row) -> tuple:
        return r.at, r.kind, r.importance

    def apply(self, key, rows: list[tuple], now: int) -> Iterator[Row]:
        expires, reads = self.own.get() if self.own.exists() else (None, 0)
        tier = Tier(*self.args, expires, reads)
        found = [a for r in rows for a in tier.take(*r)] + list(tier.until(now))
        if tier.expires is not None and tier.expires >= now:
            self.handle.registerTimer(tier.expires + 1)
        self.own.update((tier.expires, tier.reads))
        for action, at, until, importance in found:
            yield Row(memory_id=key[0], action=action, at=at, expires_at=until, importance=importance)


class _SessionProcessor(_InOrder):
    kept = "first long, session long"

    def __init__(self, gap: int, event: str):
        self.gap, self.waiting = gap, f"at long, event {event}"

    def wanted(self, r: Row) -> tuple:
        return r.at, r.event

    def apply(self, key, rows: list[tuple], now: int) -> Iterator[Row]:
        own = Anchored(self.gap, *(self.own.get() if self.own.exists() else ()))
        out = [(event, own.take(at)) for at, event in rows]
        if out:
            self.own.update((own.first, own.session))
        for event, session in out:
            yield Row(key=key[0], event_id=event, session=session)


def _check(df: DataFrame) -> None:
    if df.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", None) != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")


def fast_tier(events: DataFrame, late: str = "1 hour", ttl_hours: float = 24.0, hot_ttl_hours: float = 48.0, least: int = 100, as_of: int | None = None) -> DataFrame:
    """(memory_id, action, at, expires_at, importance): what becomes of memories in the fast tier; times in milliseconds since 1970.

    ``events``: (memory_id, kind, ts, importance), kind ``add`` or ``access``.  An addition admits a memory for ``ttl_hours``, or refreshes it; the
    access after ``least`` others promotes one that is not there for ``hot_ttl_hours``, as often as it has expired; a memory goes when its time is over.
    The batch form tells all up to ``as_of`` (milliseconds; else the last event); null ids and times are left out.
    """
    args = int(ttl_hours * HOUR), int(hot_ttl_hours * HOUR), least
    rows = events.where(F.col("memory_id").isNotNull() & F.col("ts").isNotNull())
    one = [F.col("memory_id").cast("long").alias("memory_id"), F.unix_millis("ts").alias("at"), F.coalesce("kind", F.lit("")).alias("kind"), F.col("importance").cast("double").alias("importance")]
    schema = "memory_id long, action string, at long, expires_at long, importance double"
    if not events.isStreaming:
        now = rows.agg(F.max(F.unix_millis("ts"))).first()[0] if as_of is None else as_of
        rows = rows.select(*one).where(F.col("at") <= F.lit(now)) if now is not None else rows.select(*one)
        return folded(rows, "memory_id", ["at", "kind", "importance"], lambda: Tier(*args), lambda own, r: own.take(*r), lambda own: own.until(now), schema)
    _check(events)
    return rows.withWatermark("ts", late).select("ts", *one).groupBy("memory_id").transformWithState(_TierProcessor(*args), schema, "append", "EventTime")


def live(log: DataFrame, as_of: int) -> DataFrame:
    """(memory_id, expires_at, importance) of what is in the tier at a time, from the log of fast_tier()."""
    last = log.where(F.col("at") <= as_of).groupBy("memory_id").agg(F.max_by(F.struct("action", "expires_at", "importance"), F.struct("at", F.col("action") != "expired", "expires_at")).alias("r")).select("memory_id", "r.*")
    return last.where((F.col("action") != "expired") & (F.col("expires_at") >= as_of)).select("memory_id", "expires_at", "importance")


def anchored_sessions(events: DataFrame, key: str, late: str = "1 hour", gap: int = GAP) -> DataFrame:
    """(key, event_id, session): as chunking.gaps_since_first, for a stream of (key, event_id, ts); null keys and times are left out.

    Sessions are numbered from 0; ``gap`` is in seconds.
    """
    rows = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull())
    kinds = dict(events.dtypes)
    one = [F.col(key).alias("key"), F.unix_millis("ts").alias("at"), F.col("event_id").alias("event")]
    schema = f"key {kinds[key]}, event_id {kinds['event_id']}, session long"
    if not events.isStreaming:
        out = folded(rows.select(*one), "key", ["at", "event"], lambda: Anchored(gap * 1000), lambda own, r: [(r[1], own.take(r[0]))], lambda own: [], schema)
    else:
        _check(events)
        out = rows.withWatermark("ts", late).select("ts", *one).groupBy("key").transformWithState(_SessionProcessor(gap * 1000, kinds["event_id"]), schema, "append", "EventTime")
    return out.withColumnRenamed("key", key)
