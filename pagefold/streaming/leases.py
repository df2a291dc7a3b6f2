"""Leases on jobs as a stream: keyed state and event-time timers, with the rows that a replay of the whole log has."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pagefold.operators import leases


class Leases(StatefulProcessor):
    """Events wait until the watermark passes them, so that late and unordered ones find their place; then they are folded.

    State of a job: its lease and the events that wait.  Timers stand at the events' times and at the lease's end.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "holder string, until bigint, finished boolean")
        self.waiting = handle.getListState("waiting", "at bigint, seq bigint, kind string, worker string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        events = {(r.at, r.seq, r.kind, r.worker) for r in rows} | {tuple(r) for r in self.waiting.get()}
        # What the watermark has passed was folded or is too late; before there is one it is 0.
        passed = timerValues.getCurrentWatermarkInMs() or -1
        self.wait(sorted(e for e in events if e[0] > passed))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        events = [tuple(r) for r in self.waiting.get()]
        lease = leases.Lease(*self.lease.get()) if self.lease.exists() else leases.Lease()
        found = list(leases.folded(lease, [e for e in events if e[0] <= passed], self.ttl))
        holder = lease.holder
        if (gone := lease.lapsed(passed)) is not None:
            found.append((gone, -1, "lapse", holder, "lapsed"))
        self.lease.update((lease.holder, lease.until, lease.finished))
        self.wait([e for e in events if e[0] > passed])
        if lease.holder is not None and not lease.finished:
            self.handle.registerTimer(lease.until + 1)
        for row in found:
            yield Row(job_id=key[0], at=row[0], seq=row[1], kind=row[2], worker=row[3], outcome=row[4])

    def wait(self, events: list[tuple]) -> None:
        if events:
            self.waiting.put(events)
            for at in {e[0] for e in events}:
                self.handle.registerTimer(at)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def outcomes(events: DataFrame, ttl: int, late: str = "10 minutes") -> DataFrame:
    """leases.OUTCOMES of a stream of leases.EVENTS whose `at` is in milliseconds since 1970.

    Events later than `late` are dropped, repeated ones count once.  The state store must be RocksDB's, as Spark wants
    it for timers.
    """
    rows = events.where("job_id is not null and at is not null").select("job_id", "at", F.coalesce("seq", F.lit(0)).cast("bigint").alias("seq"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("worker", F.lit("")).alias("worker"))
    timed = rows.withColumn("moment", F.timestamp_millis("at")).withWatermark("moment", late)
    return timed.groupBy("job_id").transformWithState(Leases(ttl), leases.OUTCOMES, "append", "eventtime")
