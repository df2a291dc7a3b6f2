"""Attempts: outcome classes, waits, budgets, hedging delay and the order of fair service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagefold.operators import lanes

DAY = 24 * 3600
FIRST_WAIT, MOST_WAIT = 2.0, 60.0
MOST_ATTEMPTS, MOST_RETRY_ONCE = 5, 2
HEDGE_SAMPLES, HEDGE_LEAST_SAMPLES, HEDGE_FACTOR, HEDGE_MIN, HEDGE_MAX = 200, 20, 4.0, 5.0, 30.0


def outcome(caller_done: Column, status: Column, body: Column, deadline: Column, no_endpoint: Column | None = None) -> Column:
    """The class of an attempt, in the order of the outcome table.

    body: result, failed, azure_error, html, empty, cut_short.  A null status is a transport failure.  no_endpoint:
    whether an error's text says that no endpoint matched.
    """
    unmatched = F.lit(False) if no_endpoint is None else F.coalesce(no_endpoint, F.lit(False))
    missing = (status.isin(404, 405, 501) & ((body != "azure_error") | unmatched)) | ((status == 500) & unmatched)
    cut = status.isNull() | (body == "cut_short")
    return (
        F.when(caller_done, "cancelled")
        .when(cut & deadline, "retry_once")
        .when(cut, "retry")
        .when((status == 200) & (body == "failed"), "analysis_failed")
        .when((status == 200) & (body == "result"), "success")
        .when(status == 200, "terminal")
        .when(status == 202, "retry")
        .when(missing, "route_missing")
        .when(status.isin(500, 504), "retry_once")
        .when(status.isin(408, 429, 502, 503), "retry")
        .otherwise("terminal")
    )


def says_no_endpoint(text: Column) -> Column:
    """Whether an error's code and messages say that the route does not exist."""
    low = F.lower(text)
    return low.contains("unhandledendpointexception") | low.contains("no candidates found for the request path") | low.contains("request did not match any endpoints")


def retry_after(value: Column) -> Column:
    """Whole seconds from 0 to a day; anything else is 0."""
    seconds = F.trim(value).try_cast("bigint")
    return F.coalesce(F.when(seconds >= 0, F.least(seconds, F.lit(DAY))), F.lit(0)).cast("bigint")


def backoff(attempt: Column, told: Column, jitter: Column) -> Column:
    """Seconds to wait: what the server told, up to the cap, else a doubled ceiling times 0.5 to 1."""
    ceiling = F.least(F.lit(MOST_WAIT), FIRST_WAIT * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(30))))
    j = F.when(F.isnan(jitter) | jitter.isNull(), 0.0).otherwise(F.least(F.greatest(jitter, F.lit(0.0)), F.lit(1.0)))
    return F.when(told > 0, F.least(told.cast("double"), F.lit(MOST_WAIT))).otherwise(ceiling * (0.5 + 0.5 * j))


def budget(attempts: DataFrame, job: str, order: list[str], result: str) -> DataFrame:
    """(job, attempts, last_outcome): how far a whole-document loop goes.

    It ends at the first outcome that is no retry, at MOST_ATTEMPTS, or at the MOST_RETRY_ONCE-th retry_once.
    """
    upto = Window.partitionBy(job).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = attempts.select(job, F.col(result).alias("outcome"), F.row_number().over(Window.partitionBy(job).orderBy(*order)).alias("n"), F.sum(F.when(F.col(result) == "retry_once", 1).otherwise(0)).over(upto).alias("once"))
    stops = ~F.col("outcome").isin("retry", "retry_once") | (F.col("n") >= MOST_ATTEMPTS) | (F.col("once") >= MOST_RETRY_ONCE)
    ended = numbered.groupBy(job).agg(
        F.min(F.when(stops, F.struct("n", "outcome"))).alias("stop"), F.max(F.struct("n", "outcome")).alias("last")
    )
    end = F.coalesce("stop", "last")
    return ended.select(job, end["n"].cast("bigint").alias("attempts"), end["outcome"].alias("last_outcome"))


def hedge_delay(durations: DataFrame, lane: str | None, block: Column, order: list[str], seconds: str) -> DataFrame:
    """durations with the delay before a duplicate call: four medians of the last samples, within bounds.

    block never falls along `order` (see lanes.running); without a lane all rows are one.
    """
    slid = lanes.sliding_median(durations, [lane] if lane else [], block, order, seconds, HEDGE_SAMPLES)
    told = F.least(F.greatest(HEDGE_FACTOR * F.col("__median"), F.lit(HEDGE_MIN)), F.lit(HEDGE_MAX))
    return slid.withColumn("delay", F.when(F.col("__n") < HEDGE_LEAST_SAMPLES, HEDGE_MAX).otherwise(told)).drop("__n", "__median")


def fair_order(queue: DataFrame, lane: str, owner: str, block: Column, arrival: list[str]) -> DataFrame:
    """queue with `turn`, the round in which a fixed backlog's request is served, and `place`, its place in its lane.

    Rounds go by their owners' first arrivals.  block never falls along `arrival`.
    """
    first = queue.groupBy(F.col(lane).alias("__lane"), F.col(owner).alias("__owner")).agg(F.min(F.struct(block.alias("block"), F.struct(*arrival).alias("arrival"))).alias("__first"))
    turns = lanes.running(queue, [lane, owner], block, arrival, F.lit(1), "turn")
    met = turns.join(first, F.col(lane).eqNullSafe(F.col("__lane")) & F.col(owner).eqNullSafe(F.col("__owner"))).drop("__lane", "__owner")
    placed = lanes.running(met, [lane], F.struct("turn", "__first.block"), ["turn", "__first.arrival"], F.lit(1), "place")
    return placed.drop("__first")


PART_ATTEMPTS = 3


def part_loop(attempts: DataFrame, part: list[str], size: str, order: list[str], result: str) -> DataFrame:
    """(part, attempts, last_outcome, next): how a part's loop ends and what follows.

    It ends at the first outcome that is no retry, or at PART_ATTEMPTS.  next: done, cancelled, failed (no route),
    recheck (a terminal answer, or a single page that keeps failing), halve, or more (attempts are left).
    """
    numbered = attempts.select(*part, F.col(size).alias("__size"), F.col(result).alias("outcome"), F.row_number().over(Window.partitionBy(*part).orderBy(*order)).alias("n"))
    stops = ~F.col("outcome").isin("retry", "retry_once") | (F.col("n") >= PART_ATTEMPTS)
    ended = numbered.groupBy(*part).agg(F.min(F.when(stops, F.struct("n", "outcome"))).alias("stop"), F.max(F.struct("n", "outcome")).alias("last"), F.first("__size").alias("__size"))
    end = F.coalesce("stop", "last")
    follows = (
        F.when(end["outcome"] == "success", "done").when(end["outcome"] == "cancelled", "cancelled").when(end["outcome"] == "route_missing", "failed")
        .when(end["outcome"].isin("analysis_failed", "terminal"), "recheck").when(F.col("stop").isNull(), "more").when(F.col("__size") < 2, "recheck").otherwise("halve")
    )
    return ended.select(*part, end["n"].cast("bigint").alias("attempts"), end["outcome"].alias("last_outcome"), follows.alias("next"))


def counters(attempts: DataFrame, job: str, order: list[str], result: str, status: str, took_ms: str) -> DataFrame:
    """(job, attempts, retries, took_ms, failed_status): a job's counts, and the status of its latest failed call that was answered."""
    failed = ~F.col(result).isin("success", "cancelled") & F.col(status).isNotNull() & (F.col(status) != 0)
    return attempts.groupBy(job).agg(
        F.count("*").alias("attempts"), F.count_if(F.col(result).isin("retry", "retry_once")).alias("retries"), F.sum(took_ms).cast("bigint").alias("took_ms"),
        F.max_by(F.when(failed, F.col(status)), F.when(failed, F.struct(*order))).alias("failed_status"),
    )


def race(calls: DataFrame, attempt: list[str], finish: str, result: str, call: str) -> DataFrame:
    """(attempt, winner, calls): of an attempt's calls the first success wins, else the first to end; they count as one attempt."""
    place = F.struct((F.col(result) != "success").alias("lost"), F.col(finish).alias("at"), F.col(call).alias("call"))
    return calls.groupBy(*attempt).agg(F.min(place)["call"].alias("winner"), F.count("*").alias("calls"))


def fallback(mode: Column, n_violations: Column) -> Column:
    """Whether a document runs whole after all: it was never split, or its parts' results cannot be merged."""
    return F.when(mode == "whole", "whole").when(n_violations > 0, "whole_after_merge").otherwise("merged")
