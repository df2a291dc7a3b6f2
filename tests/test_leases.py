"""Leases: a replay against a plain simulation, the stream against the replay, claims on a snapshot."""

import random

from pyspark.sql import functions as F

from pagefold.operators import leases
from pagefold.streaming import leases as stream_leases

MINUTE = 60_000


def plain(events, ttl, now=None):
    """Second by second, without leases: who holds each job at an event's time."""
    out, held, done = [], {}, set()
    for job, at, seq, kind, worker in sorted(set(events), key=lambda e: (e[1], e[2], e[3], e[4], e[0])):
        for j, (w, until) in list(held.items()):
            if until < at and j == job and j not in done:
                out.append((j, until, -1, "lapse", w, "lapsed"))
                del held[j]
        mine = job in held and held[job][0] == worker
        if kind == "claim":
            told = "refused" if job in done or job in held and not mine else "claimed"
        else:
            told = "lost" if job in done or not mine else "finished" if kind == "finish" else "renewed"
        if told in ("claimed", "renewed"):
            held[job] = (worker, at + ttl)
        if told == "finished":
            done.add(job)
        out.append((job, at, seq, kind, worker, told))
    if now is not None:
        out += [(j, until, -1, "lapse", w, "lapsed") for j, (w, until) in held.items() if until < now and j not in done]
    return sorted(out)


def log(rng, n=300):
    events = [(f"j{rng.randint(0, 9)}", rng.randint(1, 200) * MINUTE, i, rng.choices(["claim", "beat", "finish"], [5, 8, 1])[0], f"w{rng.randint(0, 2)}") for i in range(n)]
    return events + rng.sample(events, 30)


def test_replay_equals_a_simulation(spark):
    for seed in range(3):
        events = log(random.Random(seed))
        got = leases.replay(spark.createDataFrame(events, leases.EVENTS), 7 * MINUTE, 205 * MINUTE)
        assert sorted(map(tuple, got.collect())) == plain(events, 7 * MINUTE, 205 * MINUTE)
    outcomes = {r.outcome for r in got.collect()}
    assert outcomes == {"claimed", "refused", "renewed", "lost", "finished", "lapsed"}


def test_edges(spark):
    rows = [(None, 1, 1, "claim", "w"), ("a", None, 1, "claim", "w"), ("a", 5, None, None, None)]
    assert [tuple(r) for r in leases.replay(spark.createDataFrame(rows, leases.EVENTS), 3).collect()] == [("a", 5, 0, "", "", "lost")]
    assert leases.replay(spark.createDataFrame([], leases.EVENTS), 3).collect() == []


def test_the_stream_has_the_rows_of_the_replay(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = sorted(log(random.Random(9), 120), key=lambda e: e[1])
        # Out of order by up to eight minutes, in three files; the last event's watermark ends all leases.
        rng = random.Random(1)
        events.sort(key=lambda e: e[1] + rng.randint(0, 8) * MINUTE)
        last = [("end", 400 * MINUTE, 999, "claim", "w")]
        for i, part in enumerate((events[:50], events[50:100], events[100:], last)):
            spark.createDataFrame(part, leases.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = stream_leases.outcomes(spark.readStream.schema(leases.EVENTS).parquet(str(tmp_path / "in")), 7 * MINUTE, "9 minutes")
            query = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            query.awaitTermination()
        got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).where("job_id <> 'end'").collect()))
        assert got == plain(events, 7 * MINUTE, 391 * MINUTE)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_one_claim_takes_a_job(spark):
    jobs = [(1, "notStarted", 0, 99), (2, "running", 5, 99), (3, "running", 50, 99), (4, "notStarted", 0, 9), (5, "succeeded", 0, 99)]
    frame = spark.createDataFrame(jobs, "id int, status string, lease_until long, expires_at long")
    claims = spark.createDataFrame([(i, w, t) for i in range(1, 7) for w, t in (("b", 2), ("a", 2), ("c", 1 if i == 2 else 3))], "id int, worker string, at long")
    assert sorted(map(tuple, leases.winners(frame, claims, F.lit(10)).collect())) == [(1, "a", 3), (2, "c", 3)]
    after = {r.id: (r.status, r.lease_until, r.worker) for r in leases.claimed(frame, claims, F.lit(10), 30).collect()}
    assert after == {1: ("running", 40, "a"), 2: ("running", 40, "c"), 3: ("running", 50, None), 4: ("notStarted", 0, None), 5: ("succeeded", 0, None)}
