"""Fixed-bound histograms and zero-filled labelled counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bounds of the duration histograms, in seconds.
BOUNDS = (0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)


def bucket(value: Column, bounds=BOUNDS) -> Column:
    """The first bound at or above a value; null above the last."""
    out = F.when(F.lit(False), F.lit(0.0))
    for b in bounds:
        out = out.when(value <= b, F.lit(b))
    return out


def histogram(rows: DataFrame, value: str, bounds=BOUNDS) -> DataFrame:
    """(le, n): cumulative counts at every bound, and at +Inf, in one pass of conditional sums."""
    counted = rows.agg(*(F.count_if(F.col(value) <= b).alias(str(b)) for b in bounds), F.count(value).alias("Infinity"))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(n).cast("double").alias("le"), F.col(f"`{n}`").alias("n")) for n in counted.columns))).alias("h")).select("h.*")


def labelled_counts(rows: DataFrame, label: str, known: list[str]) -> DataFrame:
    """(label, n): a count for every known label, 0 where it has no row."""
    names = rows.sparkSession.createDataFrame([(k,) for k in known], f"{label} string")
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return names.join(counts, label, "left").select(label, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def exposition(samples: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """(line): samples of a metric in the text format of metrics scrapes; order them by line."""
    quoted = [F.concat(F.lit(f'{c}="'), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for c in labels]
    return samples.select(F.concat(F.lit(f"{name}{{"), F.concat_ws(",", *quoted), F.lit("} "), F.col(value).cast("string")).alias("line"))


def capacity(jobs: DataFrame, surface: str, slots: int, depth: int) -> DataFrame:
    """(surface, running, waiting, capacity, full): how far each surface's slots and queue are taken."""
    counted = jobs.groupBy(surface).agg(F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "notStarted").alias("waiting"))
    return counted.withColumn("capacity", F.lit(slots + depth).cast("bigint")).withColumn("full", F.col("running") + F.col("waiting") >= slots + depth)
