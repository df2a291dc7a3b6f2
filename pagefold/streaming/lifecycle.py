"""The job lifecycle as a stream: the latest state of every job, and counts of admissions in event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("succeeded", "failed")


def latest_states(events: DataFrame, job: str = "job_id", state: str = "state", time: str = "ts", seq: str = "seq") -> DataFrame:
    """(job, state, events, finished) of a stream of state changes; the state store holds one row for each job.

    Changes may come late and out of order: the latest by (time, seq) stands, and a terminal state is not overwritten
    by anything but a later terminal one.
    """
    place = F.struct(F.col(state).isin(*TERMINAL).alias("terminal"), F.col(time).alias("t"), F.col(seq).alias("s"))
    return events.groupBy(job).agg(F.max_by(state, place).alias("state"), F.count("*").alias("events"), F.max(F.col(state).isin(*TERMINAL)).alias("finished"))


def admissions(events: DataFrame, window: str = "10 minutes", late: str = "1 hour", state: str = "state", time: str = "ts") -> DataFrame:
    """(start, state, n): state changes by event-time window; the watermark bounds the state that is kept."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), state).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), state, "n")


def deduplicated(events: DataFrame, keys: tuple[str, ...] = ("job_id", "seq"), late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Each change once, although a worker that was restarted may send it again."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
