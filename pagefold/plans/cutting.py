"""Whole results cut into parts, and results composed to one: the inverse of the merge and a use of it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagefold.functions import arrowrows, jsontext, units
from pagefold.operators import cutting
from pagefold.plans import assembly


def clusters(content):
    """The lengths, in characters, of a text's grapheme clusters, by the counter that measures merged results."""
    return F.transform(F.regexp_extract_all(content, F.lit(r"\X"), F.lit(0)), lambda c: F.length(c))


def cut(results: DataFrame, plan: DataFrame | None, unit: str = units.GRAPHEMES) -> DataFrame:
    """(doc_id, k, planned, raw, notes, problems): the parts that whole results with cross-references split into.

    results (doc_id, result), bare or in their envelope; plan (doc_id, k, planned array<int>), or None where results have
    plans array<struct<k, planned>> in order, so that nothing is joined.  Each part is spelled
    without white space and numbered by itself, so that merging the parts gives the result again.  A result that cannot
    be cut (null, malformed, or with anything that cannot be followed) gives its parts a null raw text and up to eight
    problems by their paths, and ends nothing.  A document without a plan, or a plan without a document, gives nothing.
    Results and plans are shuffled by document, once each; plans grow with results, whatever size a plan's estimate has,
    so they are merged, never sent through the driver.
    """
    rows = results
    if plan is not None:
        pages = F.col("planned").cast("array<bigint>").alias("planned")
        plans = plan.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", pages))).alias("plans"))
        rows = results.select("doc_id", "result").join(plans.hint("merge"), "doc_id")
    told = clusters(F.coalesce(F.get_json_object("result", "$.analyzeResult.content"), F.get_json_object("result", "$.content"))) if unit == units.GRAPHEMES else F.lit(None).cast("array<int>")
    joined = rows.select("doc_id", "result", "plans", told.alias("clusters"))
    kind_k = joined.schema["plans"].dataType.elementType["k"].dataType.simpleString()

    def run(batches):
        for b in arrowrows.slices(batches):
            at, rows = [], []
            for i, (result, wanted, sizes) in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)):
                planned = [p["planned"] or [] for p in wanted]
                texts, notes, problems = cutting.parts(result, planned, unit, sizes)
                rows += [(p["k"], n, t, notes, problems) for p, n, t in zip(wanted, planned, texts, strict=True)]
                at += [i] * len(wanted)
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            told = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *told], ["doc_id", "k", "planned", "raw", "notes", "problems"])

    schema = f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, k bigint, planned array<bigint>, raw string, notes array<string>, problems array<string>"
    return joined.mapInArrow(run, schema).withColumn("k", F.col("k").cast(kind_k))


def bare(results: DataFrame) -> DataFrame:
    """results (doc_id, k, raw) out of their envelopes, with their numbers of pages; a malformed one stays, with none."""
    rows = results.select("doc_id", "k", "raw")

    def one(raw: str | None) -> tuple[str | None, int]:
        try:
            found = {name: (kind, n, value) for name, kind, n, value in jsontext.members(raw or "")}
            if "analyzeResult" in found:
                raw = found["analyzeResult"][2]
                found = {name: (kind, n, value) for name, kind, n, value in jsontext.members(raw)}
        except ValueError:
            return raw, 0
        return raw, max(0, found.get("pages", ("", 0))[1])

    def run(batches):
        for b in arrowrows.slices(batches):
            told = [one(r) for r in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([r for r, _ in told], pa.string()), pa.array([n for _, n in told], pa.int64())], ["doc_id", "k", "raw", "n_pages"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, k {kinds['k']}, raw string, n_pages bigint")


FIGURES = "figures array<struct<id: string, boundingRegions: array<struct<pageNumber: bigint>>>>"


def figures(raw):
    """(page of the id, its rest, page of the first region) of each figure of a result."""
    page = lambda f: F.split_part(f["id"], F.lit("."), F.lit(1)).try_cast("bigint")
    rest = lambda f: F.substring_index(f["id"], ".", -1)
    found = F.coalesce(F.from_json(raw, FIGURES)["figures"], F.array().cast("array<struct<id:string,boundingRegions:array<struct<pageNumber:bigint>>>>"))
    return F.transform(found, lambda f: F.struct(page(f).alias("page"), rest(f).alias("rest"), F.get(f["boundingRegions"], F.lit(0))["pageNumber"].alias("first")))


def compose(results: DataFrame, unit: str = units.GRAPHEMES) -> tuple[DataFrame, DataFrame]:
    """(wholes, plan) of results (doc_id, k, raw) joined as consecutive pages of one document each.

    wholes: (doc_id, result, codes): the merge's violations; `pages` where a result has none, and `figures` where a
    merged figure does not have the page of its own id and first region mapped to the whole's, which is checked apart
    from the merge.  plan: (doc_id, k, planned).
    """
    rows = bare(results)
    base = F.coalesce(F.sum("n_pages").over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("base", base)
    planned = F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest("n_pages", F.lit(1))), lambda i: i + F.col("base"))
    parts = rows.withColumn("planned", F.when(F.col("n_pages") > 0, planned).otherwise(F.array().cast("array<bigint>")))
    mapped = F.transform(figures(F.col("raw")), lambda f: F.struct((f["page"] + F.col("base")).alias("page"), f["rest"].alias("rest"), (f["first"] + F.col("base")).alias("first")))
    want = parts.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", mapped.alias("f")))), lambda p: p["f"])).alias("want"), F.min("n_pages").alias("least"))
    found = assembly.documents(parts, assembly.DI, unit).join(want.hint("merge"), "doc_id")
    codes = F.concat(F.transform("codes", lambda c: c["code"]), F.array_compact(F.array(F.when(F.col("least") == 0, "pages"), F.when(F.col("result").isNotNull() & (figures(F.col("result")) != F.col("want")), "figures"))))
    return found.select("doc_id", F.when(F.size(codes) == 0, F.col("result")).alias("result"), F.array_distinct(codes).alias("codes")), parts.select("doc_id", "k", "planned")
