"""Validation: dangling references, orphans, member-order models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dangling(pointers: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Pointers whose target is absent."""
    return pointers.join(targets.select(*keys).distinct(), keys, "left_anti")


def order_pairs(members: DataFrame, owner: str, name: str, at: list[str]) -> DataFrame:
    """(before, after, owners): member names in the order of their first places, and how many objects show it."""
    first = members.groupBy(owner, name).agg(F.min(F.struct(*at)).alias("place"))
    a, b = first.alias("a"), first.alias("b")
    pairs = a.join(b, (F.col(f"a.{owner}") == F.col(f"b.{owner}")) & (F.col("a.place") < F.col("b.place")))
    return pairs.groupBy(F.col(f"a.{name}").alias("before"), F.col(f"b.{name}").alias("after")).agg(F.count("*").alias("owners"))


def order_conflicts(model: DataFrame, seen: DataFrame) -> DataFrame:
    """Pairs that are seen, never in the model's order, and in the model reversed."""
    turned = model.select(F.col("after").alias("before"), F.col("before").alias("after"))
    return seen.join(turned, ["before", "after"], "left_semi").join(model, ["before", "after"], "left_anti")


def numbering(rows: DataFrame, group: list[str], order: list[str], number: str) -> DataFrame:
    """Rows whose number is not their place in their group, from 1."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("expected", place.cast("bigint")).where(F.col(number) != F.col("expected"))


def tree_depths(edges: DataFrame, root: str) -> DataFrame:
    """(node, depth) of every node that is reached from the root along edges (parent, child), once for each way to it.

    Spark's recursive query: a join a level, up to spark.sql.cteRecursionLevelLimit levels, so that a tree that loops
    ends with an error and not never, and up to spark.sql.cteRecursionRowLimit rows.  An unknown root has depth 0.
    """
    sql = "WITH RECURSIVE t(node, depth) AS (SELECT :root, 0L UNION ALL SELECT child, depth + 1 FROM {edges} JOIN t ON parent = node) SELECT node, depth FROM t"
    return edges.sparkSession.sql(sql, args={"root": root}, edges=edges.select("parent", "child"))
