"""Merging parts of documents: measures, running shifts, remapping, renumbering, agreement, assembly and its inverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_base(df: DataFrame, doc: str, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of `value` over the rows before each one in its document."""
    before = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("bigint"))


def part_shifts(parts: DataFrame, doc: str, part: str, length: str, separator_length: int = 1) -> DataFrame:
    """The offset that every part's text has in the merged text."""
    return running_base(parts, doc, [part], F.col(length) + separator_length, "shift")


def merged_content(parts: DataFrame, doc: str, part: str, content: str, separator: str = "\n") -> DataFrame:
    """(doc, content): the parts' texts in order.  A document's text is one value, as in its result."""
    ordered = F.array_sort(F.collect_list(F.struct(part, content)))
    return parts.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda p: p[content]), separator).alias("content"))


def remap_pages(rows: DataFrame, plan: DataFrame, doc: str, part: str, local: str) -> DataFrame:
    """rows with the planned page of each (doc, part, local number); null where the part has no such page."""
    planned = plan.select(doc, part, F.col("local_no").alias(local), F.col("page").alias("planned_page"))
    return rows.join(planned, [doc, part, local], "left")


def renumber(pointers: DataFrame, bases: DataFrame, keys: list[str], index: str, base: str, count: str) -> DataFrame:
    """pointers with the index in the merged array, null where it is past its own part's count."""
    joined = pointers.join(bases.select(*keys, base, count), keys, "left")
    return joined.withColumn("merged_index", F.when(F.col(index) < F.col(count), F.col(index) + F.col(base)))


def agreement(members: DataFrame, doc: str, name: str, raw: str, part: str) -> DataFrame:
    """(doc, name, agrees, n_values, n_parts): whether every part of a document has a member, and all spell it alike.

    A null is no spelling; a part is one that has any member.
    """
    counted = members.groupBy(doc, name).agg(F.count_distinct(raw).alias("n_values"), F.count_distinct(part).alias("n_parts"))
    parts = members.groupBy(doc).agg(F.count_distinct(part).alias("of_parts"))
    agrees = (F.col("n_values") == 1) & (F.col("n_parts") == F.col("of_parts"))
    return counted.join(parts, doc).select(doc, name, agrees.alias("agrees"), "n_values", "n_parts")


def islands(spans: DataFrame, doc: str, start: str, end: str, gap: int = 0) -> DataFrame:
    """(doc, first, last, n): spans joined where at most `gap` units lie between one and all before it."""
    order = Window.partitionBy(doc).orderBy(start, end)
    furthest = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("opens", F.when(furthest.isNull() | (F.col(start) > furthest + gap), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(doc, "island").agg(F.min(start).alias("first"), F.max(end).alias("last"), F.count("*").alias("n")).drop("island")


def clip(spans: DataFrame, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """The parts of spans within [low, high); an empty span stays where it lies in [low, high]."""
    a, b = F.greatest(F.col(start), low), F.least(F.col(end), high)
    inside = (a < b) | ((F.col(start) == F.col(end)) & F.col(start).between(low, high))
    return spans.where(inside).withColumn(start, a).withColumn(end, F.greatest(a, b))


def contained(inner: DataFrame, outer: DataFrame, doc: str, width: int) -> DataFrame:
    """(doc, inner_start, inner_end, holders): how many outer spans hold each inner span.

    Both meet by document and by the bucket of `width` units that the inner span starts in, an equi-join.
    """
    held = outer.select(doc, "outer_start", "outer_end", F.explode(F.sequence(F.expr(f"outer_start div {width}"), F.expr(f"outer_end div {width}"))).alias("bucket"))
    asked = inner.withColumn("bucket", F.expr(f"inner_start div {width}"))
    within = (F.col("o.outer_start") <= F.col("i.inner_start")) & (F.col("i.inner_end") <= F.col("o.outer_end"))
    joined = asked.alias("i").join(held.alias("o"), (F.col(f"i.{doc}") == F.col(f"o.{doc}")) & (F.col("i.bucket") == F.col("o.bucket")) & within, "left")
    return joined.groupBy(F.col(f"i.{doc}").alias(doc), "i.inner_start", "i.inner_end").agg(F.count("o.outer_start").alias("holders"))


def cut(rows: DataFrame, plan: DataFrame, doc: str, page: str) -> DataFrame:
    """The inverse of the merge for paged rows: each row with its part and its page's number in the part."""
    return rows.join(plan.select(doc, F.col("page").alias(page), "part", "local_no"), [doc, page])
