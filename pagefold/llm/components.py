"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefold.llm.common import discard, hot_keys, salted_join, stored


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star links each larger neighbour of a node, small star each smaller one and the node, to its minimum."""
    edges = edges.where("a != b")
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    # The centre of a large star has a row for each of its leaves.
    out = salted_join(both, lowest, "a", "n", "b", hot_keys(both.groupBy(F.col("a").alias("key")).agg(F.count("*").alias("n"))))
    if large:
        out = out.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) can reach.  Empty edges give no row.

    edges should be a stored table: it is read twice.  Rounds are written to the shared folder, so a lost executor
    repeats one round at most.
    """
    now, before = edges, []
    while True:
        half = stored(star(now, large=True), "cc")
        now = stored(star(half, large=False), "cc")
        discard(half, *before)
        before = [now]
        # Done when the edges are stars: a leaf has one centre, and no centre is a leaf.
        ends = now.select(F.col("a").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(now.select(F.col("b").alias("n"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
        if ends.groupBy("n").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf + centre > 1").isEmpty():
            break
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(centres)
