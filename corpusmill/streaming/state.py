"""Keyed state with timers: ingestion as a stream, caches that expire, cadence of turns.

State lives in RocksDB under the query's checkpoint, one value for each key, so a restart goes on where the
last committed batch ended. Timers follow the watermark: they fire once events show that the time has come.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusmill.operators.writes import STATES

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which state with timers needs."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)


def _millis(t: datetime) -> int:
    """Of an instant; Spark hands timestamps to Python in the machine's zone, without naming it."""
    return int((t if t.tzinfo else t.astimezone(timezone.utc)).timestamp() * 1000)


class Ingestion(StatefulProcessor):
    """Moves documents through their states; one that stays unfinished for ``lease_ms`` goes back to the queue."""

    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.document = handle.getValueState("document", "state string, error string, pages bigint, refused bigint, version bigint, due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state, error, pages, refused, version, due = self.document.get() if self.document.exists() else ("", None, 0, 0, 0, 0)
        last = due - self.lease_ms if due else 0
        for e in sorted(rows, key=lambda r: r.ord):  # a document has a handful of events
            last = max(last, _millis(e.ts))
            progress = state == e.state == "processing"
            version += 1
            if not progress and e.state not in (("queued",) if not state else STATES[state]):
                refused += 1
                continue
            state, error = e.state, (e.error or "")[:500] if e.state == "failed" and e.error is not None else None
            pages = 0 if state == "queued" else max(pages, e.pages or 0)
        due = self._schedule(state, last)
        self.document.update((state, error, pages, refused, version, due))
        yield self._row(key, state, error, pages, refused, version, False)

    def _schedule(self, state: str, last: int) -> int:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if state not in ("queued", "processing"):
            return 0
        self.handle.registerTimer(last + self.lease_ms)
        return last + self.lease_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if not self.document.exists():
            return
        state, error, pages, refused, version, _ = self.document.get()
        if state in ("queued", "processing"):
            self.document.update(("queued", None, 0, refused, version + 1, 0))
            yield self._row(key, "queued", None, 0, refused, version + 1, True)

    @staticmethod
    def _row(key, state, error, pages, refused, version, requeued) -> Row:
        return Row(key=key[0], state=state, error=error, pages_done=pages, refused=refused, enqueue=state in ("queued", "processing"), version=version, requeued=requeued)

    def close(self) -> None:
        pass


def ingestion(events: DataFrame, *, lease_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """events (key, ord, ts, state, error, pages), as a stream -> a row for each change of a document.

    The row of the greatest version is the document as ``writes.ingestion`` gives it, however the events are cut
    into batches, as long as those of one key come in their order. ``requeued``: by a timer.
    """
    schema = f"key {events.schema['key'].dataType.simpleString()}, state string, error string, pages_done bigint, refused bigint, enqueue boolean, version bigint, requeued boolean"
    return events.withWatermark("ts", late).groupBy("key").transformWithState(Ingestion(lease_ms), schema, "Update", "EventTime")


class Expiring(StatefulProcessor):
    """A cache's entry for each key. Its timer removes it once the watermark is past its expiry."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, expires bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        value, expires = self.entry.get() if self.entry.exists() else (None, None)
        changed = False
        for e in sorted(rows, key=lambda r: (_millis(r.ts), r.value is None)):  # at one time entries come before requests
            if e.value is not None:
                value, expires, changed = e.value, None if e.expires is None else _millis(e.expires), True
                continue
            hit = expires is not None and expires > _millis(e.ts)
            yield Row(key=key[0], ts=e.ts, value=value if hit else None, hit=hit)
        if changed:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if expires is None:
                self.entry.clear()  # no expiry counts as expired
            else:
                self.entry.update((value, expires))
                self.handle.registerTimer(max(expires, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def expiring(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """events (key, ts, value, expires), as a stream -> (key, ts, value, hit) of each request.

    A row with a value is an entry, which replaces the key's; one without is a request at its time.
    """
    schema = f"key {events.schema['key'].dataType.simpleString()}, ts timestamp, value string, hit boolean"
    return events.withWatermark("ts", late).groupBy("key").transformWithState(Expiring(), schema, "Append", "EventTime")


class Cadence(StatefulProcessor):
    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getValueState("turns", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        n = self.turns.get()[0] if self.turns.exists() else 0
        for _ in rows:
            n += 1
            if n % self.every == 0:
                yield Row(session=key[0], turns=n)
        self.turns.update((n,))

    def close(self) -> None:
        pass


def cadence(turns: DataFrame, every: int = 3) -> DataFrame:
    """turns (session, turn) of users, as a stream: a row whenever a session has had so many more turns."""
    schema = f"session {turns.schema['session'].dataType.simpleString()}, turns bigint"
    return turns.groupBy("session").transformWithState(Cadence(every), schema, "Append", "None")


def latest(changes: DataFrame) -> DataFrame:
    """Of each document the row of the greatest version."""
    rest = [c for c in changes.columns if c != "key"]
    return changes.groupBy("key").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("key", "r.*")
