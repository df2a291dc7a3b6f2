"""Job lifecycle over snapshots: selections, eviction, recovery decisions, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefold.operators import lanes

MOST_RECOVERIES = 3
DAY = 86400


def expired(jobs: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Past their expiry and terminal, lapsed while running, or never started; oldest first."""
    gone = (F.col("expires_at") < now) & (F.col("status").isin("succeeded", "failed", "notStarted") | (F.col("lease_until") < now))
    out = jobs.where(gone)
    return out.orderBy("expires_at", "id").limit(limit) if limit else out


def orphaned(jobs: DataFrame, now: Column, before: Column, limit: int | None = None) -> DataFrame:
    """Unexpired and without a live lease: running, or not started since before `before`; oldest first."""
    idle = ((F.col("status") == "notStarted") & (F.col("created_at") < before)) | (F.col("status") == "running")
    out = jobs.where(idle & (F.col("lease_until") < now) & (F.col("expires_at") >= now))
    return out.orderBy("created_at", "id").limit(limit) if limit else out


def abandoned(jobs: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Unfinished and unexpired, whatever their lease, oldest first: what a fresh process takes up."""
    out = jobs.where(F.col("status").isin("notStarted", "running") & (F.col("expires_at") >= now))
    return out.orderBy("created_at", "id").limit(limit) if limit else out


def eviction_order(jobs: DataFrame, now: Column) -> DataFrame:
    """Finished jobs with their sort key: expired ones first, then the least recently updated."""
    return jobs.where(F.col("status").isin("succeeded", "failed")).withColumn("live", (F.col("expires_at") >= now).cast("int"))


def evict_until(jobs: DataFrame, now: Column, excess: Column, group: str) -> DataFrame:
    """The first jobs in eviction order whose bytes, in each group, make up the excess; a day's jobs are one task's."""
    block = F.struct("live", F.floor(F.col("updated_at") / DAY))
    freed = lanes.running(eviction_order(jobs, now), [group], block, ["live", "updated_at", "id"], F.col("bytes"), "freed_before")
    return freed.withColumn("freed_before", F.col("freed_before") - F.coalesce("bytes", F.lit(0))).where(F.col("freed_before") < excess)


def recovery_action(status: Column, has_input: Column, attempts: Column) -> Column:
    return (
        F.when(status.isin("succeeded", "failed"), "skip")
        .when(~has_input, "fail_no_input")
        .when(attempts >= MOST_RECOVERIES, "fail_attempts")
        .otherwise("requeue")
    )


def inflight(events: DataFrame, lane: str, block: Column, order: list[str], change: str) -> DataFrame:
    """events with the number of jobs in flight after each, a running sum of +1 and -1; block never falls along `order`."""
    return lanes.running(events, [lane], block, order, F.col(change), "inflight")


def latest(events: DataFrame, job: str, order: list[str], state: str) -> DataFrame:
    """(job, state, events): the last state of an event log; one partial aggregate, no sort."""
    return events.groupBy(job).agg(F.max_by(state, F.struct(*order)).alias(state), F.count("*").alias("events"))


def stale_work(folders: DataFrame, claimed: DataFrame, before: Column) -> DataFrame:
    """Work folders (id, modified) that no worker claims and that were last used before `before`."""
    return folders.where(F.col("modified") < before).join(claimed.select("id").distinct(), "id", "left_anti")


def sweep(jobs: DataFrame, now: Column, before: Column) -> DataFrame:
    """(id, action): what one pass of the sweeper does with each job, in its order: expire, recover, else keep."""
    gone = (F.col("expires_at") < now) & (F.col("status").isin("succeeded", "failed", "notStarted") | (F.col("lease_until") < now))
    idle = (((F.col("status") == "notStarted") & (F.col("created_at") < before)) | (F.col("status") == "running")) & (F.col("lease_until") < now) & (F.col("expires_at") >= now)
    return jobs.select("id", F.when(gone, "expire").when(idle, "recover").otherwise("keep").alias("action"))


def remaining(jobs: DataFrame, deleted: DataFrame) -> DataFrame:
    """The jobs that are left when others are deleted."""
    return jobs.join(deleted.select("id"), "id", "left_anti")


def envelope(status: Column, created: Column, updated: Column, result: Column, error: Column) -> Column:
    """The answer to a poll: status, times, then the result of a success or the error of a failure, as JSON text."""
    stamp = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(F.lit('{"status":"'), status, F.lit('","createdDateTime":"'), stamp(created), F.lit('","lastUpdatedDateTime":"'), stamp(updated), F.lit('"'))
    tail = F.when(status == "succeeded", F.concat(F.lit(',"analyzeResult":'), result)).when(status == "failed", F.concat(F.lit(',"error":'), error)).otherwise("")
    return F.concat(head, tail, F.lit("}"))
