"""Reassembly of split documents: measure, check, shift, and merge only what passed every check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagefold.functions import units
from pagefold.operators import merge


def violations(parts: DataFrame, plan: DataFrame, unit: str = units.GRAPHEMES) -> DataFrame:
    """(doc_id, k, code) of parts (doc_id, k, pages, content) against plan (doc_id, k, planned array<int>).

    V02 planned pages empty or not ascending; V09 no content; V15 a part does not start behind the one before;
    V16 page count differs; V17 a page does not map; V20 in graphemes, a part but the last ends with CR.
    """
    order = Window.partitionBy("doc_id").orderBy("k")
    rows = parts.join(plan, ["doc_id", "k"], "full")
    last = F.element_at("planned", -1)
    local = F.forall("pages", lambda n: n <= F.size("planned"))
    mapped = F.when(local, F.transform("pages", lambda n: F.get("planned", n - 1))).otherwise(F.col("pages"))
    rows = rows.withColumn("before", F.lag(F.when(F.size("planned") > 0, last)).over(order)).withColumn("later", F.lead("k").over(order))
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size("planned") - 1, F.lit(1))), lambda i: (F.size("planned") < 2) | (F.get("planned", i) > F.get("planned", i - 1)))
    codes = F.array(
        F.when(F.coalesce(F.size("planned"), F.lit(0)).isin(0, -1) | ~rising | (F.get("planned", F.lit(0)) < 1), "V02"),
        F.when(F.col("content").isNull(), "V09"),
        F.when(F.get("planned", F.lit(0)) <= F.col("before"), "V15"),
        F.when(F.coalesce(F.size("pages"), F.lit(-1)) != F.size("planned"), "V16"),
        F.when((F.size("pages") == F.size("planned")) & ~F.coalesce(mapped == F.col("planned"), F.lit(False)), "V17"),
        F.when(F.lit(unit == units.GRAPHEMES) & F.col("later").isNotNull() & F.endswith("content", F.lit("\r")), "V20"),
    )
    return rows.select("doc_id", "k", F.explode(F.array_compact(codes)).alias("code"))


def reassemble(parts: DataFrame, plan: DataFrame, unit: str = units.GRAPHEMES, separator: str = "\n") -> tuple[DataFrame, DataFrame]:
    """(merged, violations): documents without violation as (doc_id, content), with (doc_id, k, shift) in `shifts`.

    Documents with any violation are left out before the merge does work on them.
    """
    found = violations(parts, plan, unit)
    sound = parts.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    return merge.merged_content(sound, "doc_id", "k", "content", separator), found


def shifts(parts: DataFrame, unit: str = units.GRAPHEMES, separator_length: int = 1) -> DataFrame:
    """(doc_id, k, len, shift) of parts in a unit of text."""
    measured = parts.select("doc_id", "k", units.unit_length(F.col("content"), unit).alias("len"))
    return merge.part_shifts(measured, "doc_id", "k", "len", separator_length)
