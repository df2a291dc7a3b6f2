"""Lanes dealt to blocks against the same windows over whole lanes."""

import random
import statistics

from pyspark.sql import functions as F

from pagefold.operators import attempts, jobs, lanes

SCHEMA = "lane string, t long, id long, v double, extra int"


def made(n):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 6 + ["b", None]), rng.choice([7, rng.randrange(400)]), i, rng.choice([None, float(rng.randrange(50))]), 1) for i in range(n)]
    return rows


def by_lane(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_running_sums_do_not_depend_on_the_blocks(spark):
    rows = made(600)
    want = {}
    for own in by_lane(rows).values():
        total = 0
        for r in own:
            total += int(r[3] or 0)
            want[r[2]] = total
    df = spark.createDataFrame(rows, SCHEMA)
    for block in (F.floor(F.col("t") / 50), F.col("t"), F.lit(0)):
        got = lanes.running(df, ["lane"], block, ["t", "id"], F.col("v"), "total")
        assert got.columns == [*df.columns, "total"]
        assert {r.id: r.total for r in got.collect()} == want
    assert lanes.running(df.limit(0), ["lane"], F.col("t"), ["t", "id"], F.col("v"), "total").collect() == []


def test_medians_slide_over_the_chunks(spark):
    rows = made(500)
    want = {}
    for own in by_lane(rows).values():
        for i, r in enumerate(own):
            before = [x[3] for x in own[max(0, i - 20) : i] if x[3] is not None]
            want[r[2]] = (min(i, 20), statistics.median(before) if before else None)
    df = spark.createDataFrame(rows, SCHEMA)
    for chunk in (20, 37, 16384):
        got = lanes.sliding_median(df, ["lane"], F.floor(F.col("t") / 50), ["t", "id"], "v", 20, chunk).collect()
        assert {r.id: (r["__n"], r["__median"]) for r in got} == want and len(got) == len(rows)
        assert all(r.extra == 1 for r in got)


def test_no_lane_is_one_lane(spark):
    rows = [("x", i, i, 2.0, 1) for i in range(30)]
    got = attempts.hedge_delay(spark.createDataFrame(rows, SCHEMA), None, F.floor(F.col("t") / 7), ["t", "id"], "v").collect()
    assert {r.id: r.delay for r in got} == {i: 30.0 if i < 20 else 8.0 for i in range(30)}


def test_fair_order_with_one_hot_owner(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["s", None]), rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(50), i) for i in range(200)]
    want = {}
    for lane in {r[0] for r in rows}:
        turns = []
        own = [r for r in rows if r[0] == lane]
        for owner in {r[1] for r in own}:
            queue = sorted((r for r in own if r[1] == owner), key=lambda r: r[2:])
            turns += [(n, queue[0][2:], r[3]) for n, r in enumerate(queue, 1)]
        want |= {t[2]: (t[0], place) for place, t in enumerate(sorted(turns), 1)}
    df = spark.createDataFrame(rows, "surface string, owner int, t long, id long")
    got = attempts.fair_order(df, "surface", "owner", F.floor(F.col("t") / 10), ["t", "id"]).collect()
    assert {r.id: (r.turn, r.place) for r in got} == want


def test_eviction_takes_null_bytes_as_none(spark):
    rows = [(i, "succeeded", 10, 86400 * (i % 3) + i, None if i == 4 else 10, "a") for i in range(12)]
    df = spark.createDataFrame(rows, "id long, status string, expires_at long, updated_at long, bytes long, surface string")
    got = {r.id: r.freed_before for r in jobs.evict_until(df, F.lit(5), F.lit(45), "surface").collect()}
    assert got == {0: 0, 3: 10, 6: 20, 9: 30, 1: 40}
