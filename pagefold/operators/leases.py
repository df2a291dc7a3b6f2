"""Leases on jobs: what a log of claims, heartbeats and finishes comes to, one rule for tables and streams.

A claim takes a job that nobody holds; a holder's heartbeat prolongs its lease; a lease that is not prolonged lapses, and
the job may be claimed again; a finished job takes no more claims.  A job's events are few, and its fold is one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = "job_id string, at bigint, seq bigint, kind string, worker string"
OUTCOMES = "job_id string, at bigint, seq bigint, kind string, worker string, outcome string"


@dataclass
class Lease:
    """Who holds a job until when (in the events' unit), and whether it is finished."""

    holder: str | None = None
    until: int = -1
    finished: bool = False

    def lapsed(self, now: int) -> int | None:
        """The moment that the lease lapsed, if it did before `now`; the job is then free."""
        if self.holder is None or self.finished or self.until >= now:
            return None
        self.holder, at = None, self.until
        return at

    def step(self, at: int, kind: str, worker: str, ttl: int) -> str:
        """The outcome of an event; lapsed() was asked before."""
        if kind == "claim":
            if self.finished or self.holder not in (None, worker):
                return "refused"
            self.holder, self.until = worker, at + ttl
            return "claimed"
        if self.finished or self.holder != worker:
            return "lost"
        if kind == "finish":
            self.finished = True
            return "finished"
        self.until = at + ttl
        return "renewed"


def folded(lease: Lease, events: list[tuple[int, int, str, str]], ttl: int) -> Iterator[tuple]:
    """(at, seq, kind, worker, outcome) of a job's events (at, seq, kind, worker) in order, and of leases that lapse before one."""
    for at, seq, kind, worker in sorted(set(events)):
        holder = lease.holder
        if (gone := lease.lapsed(at)) is not None:
            yield gone, -1, "lapse", holder, "lapsed"
        yield at, seq, kind, worker, lease.step(at, kind, worker, ttl)


def replay(events: DataFrame, ttl: int, now: int | None = None) -> DataFrame:
    """OUTCOMES of EVENTS: each event once, in the order of (at, seq), and a row `lapse` for each lease that ran out.

    An event that is told again (equal in all columns) counts once.  With `now`, leases that lapsed before it are told
    though no event comes behind them.  Events without a job or a time are left out.
    """
    rows = events.where("job_id is not null and at is not null").select("job_id", "at", F.coalesce("seq", F.lit(0)).cast("bigint").alias("seq"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("worker", F.lit("")).alias("worker"))

    def run(table: pa.Table) -> pa.Table:
        job, lease = table.column("job_id")[0].as_py(), Lease()
        found = list(folded(lease, list(zip(*(table.column(c).to_pylist() for c in ("at", "seq", "kind", "worker")), strict=True)), ttl))
        holder = lease.holder
        if now is not None and (gone := lease.lapsed(now)) is not None:
            found.append((gone, -1, "lapse", holder, "lapsed"))
        at, seq, kind, worker, outcome = map(list, zip(*found, strict=True))
        return pa.table({"job_id": [job] * len(at), "at": pa.array(at, pa.int64()), "seq": pa.array(seq, pa.int64()), "kind": kind, "worker": worker, "outcome": outcome})

    return rows.groupBy("job_id").applyInArrow(run, OUTCOMES)


def winners(jobs: DataFrame, claims: DataFrame, now) -> DataFrame:
    """(id, worker, asked): of the claims (id, worker, at) on a snapshot of jobs, the one that takes each job.

    A compare-and-set over the snapshot: a job can be taken that is not started, or running with a lapsed lease, and has
    not expired; of its claims the earliest wins, ties by worker.  asked counts the claims on it.
    """
    free = jobs.where((F.col("expires_at") >= now) & ((F.col("status") == "notStarted") | (F.col("status") == "running") & (F.col("lease_until") < now))).select("id")
    best = claims.groupBy("id").agg(F.min(F.struct("at", "worker")).alias("first"), F.count("*").alias("asked"))
    return best.join(free, "id", "left_semi").select("id", F.col("first.worker").alias("worker"), "asked")


def claimed(jobs: DataFrame, claims: DataFrame, now, lease: int) -> DataFrame:
    """The snapshot after the claims: what a winner takes is running, with a lease from now on and one attempt more."""
    taken = winners(jobs, claims, now).select(F.col("id").alias("__id"), "worker")
    joined = jobs.join(taken, F.col("id") == F.col("__id"), "left")
    won = F.col("__id").isNotNull()
    changes = {"status": F.when(won, F.lit("running")).otherwise(F.col("status")), "lease_until": F.when(won, now + lease).otherwise(F.col("lease_until")).cast(jobs.schema["lease_until"].dataType)}
    return joined.withColumns(changes).drop("__id")
