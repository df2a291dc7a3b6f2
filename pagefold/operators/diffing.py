"""Structural differences of two relations of scalars, and their grouping by pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Shares that a group's rows are dealt to.
SHARES = 64


def differences(whole: DataFrame, split: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, whole, split, kind): scalars that only one side has, or that differ."""
    a = whole.select(*keys, F.col(value).alias("whole"), F.lit(True).alias("in_whole"))
    b = split.select(*keys, F.col(value).alias("split"), F.lit(True).alias("in_split"))
    kind = F.when(F.col("in_split").isNull(), "missing").when(F.col("in_whole").isNull(), "added").when(~F.col("whole").eqNullSafe(F.col("split")), "changed")
    return a.join(b, keys, "full").withColumn("kind", kind).where("kind is not null").select(*keys, "whole", "split", "kind")


def patterns(found: DataFrame, by: list[str], order: list[str], example: str, most: int = 3) -> DataFrame:
    """(by, n, examples): counts and the first few examples of each group.

    The examples are the least rows by `order`.  A group may be a third of all rows: each of its shares keeps its least
    few and its count, and only these meet in one task.
    """
    keyed = found.withColumn("__share", F.pmod(F.xxhash64(*order), F.lit(SHARES)))
    least = keyed.withColumn("__nth", F.row_number().over(Window.partitionBy(*by, "__share").orderBy(*order))).where(F.col("__nth") <= most)
    least = least.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct(*order, F.col(example).alias("__example")))), 1, most).alias("kept"))
    counts = found.groupBy(*by).agg(F.count("*").alias("n"))
    text = F.array_join(F.transform("kept", lambda e: e["__example"]), "|")
    return counts.join(least, by).select(*by, "n", text.alias("examples"))


def corpus_report(found: DataFrame, documents: DataFrame, doc: str) -> DataFrame:
    """(documents, failed, page_level, document_level, passes): the gate of a comparison of many documents.

    documents (doc, ok) has every document and whether both analyses gave a result; found (doc, level) the differences.
    """
    both = documents.select(F.lit(1).alias("document"), (~F.col("ok")).cast("int").alias("failed"), F.lit(0).alias("page"), F.lit(0).alias("other"))
    both = both.unionByName(found.select(F.lit(0).alias("document"), F.lit(0).alias("failed"), (F.col("level") == "page").cast("int").alias("page"), (F.col("level") != "page").cast("int").alias("other")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    sums = both.agg(total("document").alias("documents"), total("failed").alias("failed"), total("page").alias("page_level"), total("other").alias("document_level"))
    return sums.withColumn("passes", (F.col("page_level") == 0) & (F.col("failed") == 0))
