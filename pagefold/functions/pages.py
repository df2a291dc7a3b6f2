"""Page lists: the range grammar, selection, and the collapsed spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAMMAR = r"^[ \t]*[0-9]+[ \t]*(-[ \t]*[0-9]+[ \t]*)?(,[ \t]*[0-9]+[ \t]*(-[ \t]*[0-9]+[ \t]*)?)*\z"


def parse_pages(spec: Column) -> Column:
    """array<struct<first, last>> of `1-3,5`; null where a part is empty, open, zero, signed or runs backwards."""
    number = lambda part, i: F.get(F.split(part, "-"), F.lit(i))
    clean = lambda c: F.regexp_replace(c, "[ \t]", "").try_cast("int")
    ranges = F.transform(F.split(spec, ","), lambda p: F.struct(clean(number(p, 0)).alias("first"), clean(F.coalesce(number(p, 1), number(p, 0))).alias("last")))
    return F.when(spec.rlike(GRAMMAR) & F.forall(ranges, lambda r: (r["first"] >= 1) & (r["first"] <= r["last"])), ranges)


def select_pages(ranges: Column, count: Column) -> Column:
    """Ascending distinct pages of the ranges; null where one is beyond the count."""
    within = F.forall(ranges, lambda r: r["last"] <= count)
    clipped = F.transform(F.filter(ranges, lambda r: r["last"] <= count), lambda r: F.sequence(r["first"], r["last"]))
    return F.when(within, F.array_sort(F.array_distinct(F.flatten(clipped))))


def format_pages(pages: Column) -> Column:
    """`3-5,9` of an ascending list."""
    runs = F.aggregate(
        pages,
        F.array().cast("array<struct<first:int,last:int>>"),
        lambda acc, p: F.when(
            (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["last"] + 1 == p),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.get(acc, F.size(acc) - 1)["first"].alias("first"), p.alias("last")))),
        ).otherwise(F.concat(acc, F.array(F.struct(p.alias("first"), p.alias("last"))))),
    )
    return F.array_join(F.transform(runs, lambda r: F.when(r["first"] == r["last"], r["first"].cast("string")).otherwise(F.concat_ws("-", r["first"], r["last"]))), ",")


def ascending(pages: Column) -> Column:
    """Whether a list is non-empty, strictly ascending and starts at 1 or later."""
    later = F.zip_with(F.slice(pages, 2, F.greatest(F.size(pages) - 1, F.lit(0))), F.slice(pages, 1, F.greatest(F.size(pages) - 1, F.lit(0))), lambda b, a: b > a)
    return (F.size(pages) > 0) & (F.get(pages, F.lit(0)) >= 1) & F.forall(later, lambda x: x)


def halves(pages: Column) -> Column:
    """The two halves of a list, the first one longer where it is odd; null for fewer than two pages."""
    middle = F.ceil(F.size(pages) / 2).cast("int")
    return F.when(F.size(pages) >= 2, F.array(F.slice(pages, 1, middle), F.slice(pages, middle + 1, F.size(pages) - middle)))


def ladder(size: Column, attempts: int = 3) -> Column:
    """array<struct<size, attempts>>: the worst case of a part that never succeeds, halved to single pages; the last step re-checks."""
    levels = F.ceil(F.log2(size)).cast("int") + 1
    at = F.transform(F.sequence(F.lit(0), levels - 1), lambda i: F.struct(F.ceil(size / F.pow(F.lit(2.0), i)).cast("bigint").alias("size"), F.lit(attempts).alias("attempts")))
    return F.concat(at, F.array(F.struct(F.lit(1).cast("bigint").alias("size"), F.lit(2).alias("attempts"))))


def label(pages: Column, prefix: str, extension: str) -> Column:
    """A part's file name: prefix-first-last.extension."""
    return F.concat(F.lit(f"{prefix}-"), F.get(pages, F.lit(0)), F.lit("-"), F.element_at(pages, -1), F.lit(extension))
