from pyspark.sql import functions as F

from pagefold.streaming import lifecycle

KIND = "job_id string, state string, ts timestamp, seq int"


def run(spark, tmp_path, rows, transform, mode):
    for i, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :])):
        frame = spark.createDataFrame(part, "job_id string, state string, ts string, seq int").withColumn("ts", F.to_timestamp("ts"))
        frame.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(KIND).json(str(tmp_path / "in"))
        q = transform(stream).writeStream.outputMode(mode).format("memory").queryName(f"out_{tmp_path.name.replace('-', '_')}_{i}")
        q = q.option("checkpointLocation", str(tmp_path / f"cp{i}")).trigger(availableNow=True).start()
        q.awaitTermination()
    return [tuple(r) for r in spark.table(f"out_{tmp_path.name.replace('-', '_')}_1").collect()]


ROWS = [
    ("a", "notStarted", "2024-01-01 00:00:00", 1), ("a", "succeeded", "2024-01-01 00:05:00", 3), ("b", "running", "2024-01-01 00:20:00", 2),
    ("a", "running", "2024-01-01 00:06:00", 2), ("b", "notStarted", "2024-01-01 00:01:00", 1), ("b", "notStarted", "2024-01-01 00:01:00", 1),
]


def test_latest_states(spark, tmp_path):
    assert sorted(run(spark, tmp_path, ROWS, lifecycle.latest_states, "complete")) == [("a", "succeeded", 3, True), ("b", "running", 3, False)]


def test_admissions_and_duplicates(spark, tmp_path):
    got = run(spark, tmp_path, ROWS, lifecycle.admissions, "complete")
    assert sum(r[2] for r in got) == 6 and ("notStarted", 3) in {(r[1], r[2]) for r in got}


def test_duplicates_are_dropped(spark, tmp_path):
    assert len(run(spark, tmp_path, ROWS, lifecycle.deduplicated, "append")) == 5
