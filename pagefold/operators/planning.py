"""Split planning: balanced parts of page sets, halving, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def balanced_plan(pages: DataFrame, most: int, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """pages with `part` (from 0) and `local_no` (from 1): parts of at most `most` pages, sizes differing by one at most.

    The first n mod k parts are one page longer, k being the least number of parts.  (doc, page) must be distinct.
    """
    whole = Window.partitionBy(doc)
    at = (F.row_number().over(whole.orderBy(page)) - 1).cast("bigint")
    sized = pages.withColumn("at", at).withColumn("n", F.count("*").over(whole))
    sized = sized.withColumn("k", F.ceil(F.col("n") / most).cast("bigint"))
    size, longer = F.expr("n div k"), F.expr("n % k")
    part = F.expr("if(at < (n % k) * (n div k + 1), at div (n div k + 1), n % k + (at - (n % k) * (n div k + 1)) div (n div k))")
    begin = part * size + F.least(part, longer)
    return sized.select(*pages.columns, part.cast("bigint").alias("part"), (F.col("at") - begin + 1).cast("bigint").alias("local_no"))


def halve(pages: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """pages with `half` 0 or 1: the first half takes the odd page; documents of one page are left out."""
    whole = Window.partitionBy(doc)
    at, n = F.row_number().over(whole.orderBy(page)), F.count("*").over(whole)
    return pages.withColumn("half", F.when(at <= F.ceil(n / 2), 0).otherwise(1).cast("bigint")).withColumn("n", n).where("n >= 2").drop("n")


def page_runs(pages: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """(doc, runs): the collapsed spelling of each document's pages, by gaps and islands."""
    island = F.col(page) - F.row_number().over(Window.partitionBy(doc).orderBy(page))
    runs = pages.withColumn("island", island).groupBy(doc, "island").agg(F.min(page).alias("first"), F.max(page).alias("last"))
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    spelled = runs.select(doc, F.struct("first", text.alias("text")).alias("run"))
    return spelled.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list("run")), lambda r: r["text"]), ",").alias("runs"))


def coverage_violations(parts: DataFrame, selected: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """(doc, page, planned): pages that are selected and in no part (0), in more than one part, or not selected (planned > 0)."""
    told = lambda rows, wanted: rows.select(doc, page, F.lit(wanted).alias("wanted"), F.lit(1 - wanted).cast("bigint").alias("planned"))
    # One grouping of both, so that neither side is sorted for a join.
    both = told(selected, 1).unionByName(told(parts, 0)).groupBy(doc, page).agg(F.max("wanted").alias("wanted"), F.sum("planned").alias("planned"))
    return both.where("wanted != planned").select(doc, page, "planned")
