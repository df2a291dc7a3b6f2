"""Generated results keep the invariants, and come back from cut and merge in every byte."""

import json

from pyspark.sql import functions as F

from pagefold import catalog, merge_catalog  # noqa: F401
from pagefold.functions import units
from pagefold.operators import invariants
from pagefold.plans import assembly, cutting
from pagefold.sources import generated


def documents(spark):
    return spark.range(30).select(F.col("id").alias("doc_id"), (F.col("id") % 8).alias("pages"))


def plan_of(whole, size):
    k = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("pages") - 1) / size))
    return whole.select("doc_id", "pages", F.explode(k).alias("k")).select("doc_id", "k", F.sequence(size * F.col("k") + 1, F.least(size * (F.col("k") + 1), F.col("pages"))).alias("planned"))


def test_layout_results_come_back_from_any_cut(spark):
    whole = generated.layout_results(documents(spark), 3)
    before = {r.doc_id: r.result for r in whole.collect()}
    assert set(before) == {i for i in range(30) if i % 8} and [p["pageNumber"] for p in json.loads(before[7])["pages"]] == list(range(1, 8))
    for size in (1, 2, 4):
        out, _, bad = assembly.merged(cutting.cut(whole, plan_of(whole, size), units.CODE_POINTS), unit=units.CODE_POINTS)
        assert bad.collect() == [] and {r.doc_id: r.result for r in out.collect()} == before, size


def test_layout_results_keep_the_invariants(spark):
    whole = generated.layout_results(documents(spark), 3)
    assert [tuple(r) for r in invariants.result_findings(whole.select("doc_id", "result")).collect()] == []


def test_results_of_lines(spark):
    whole = generated.read_results(documents(spark))
    assert invariants.read_findings(whole.select("doc_id", "result"), model="m", unit="inch").collect() == []
    out, _, bad = assembly.merged(assembly.cut(whole, plan_of(whole, 3)), assembly.READ)
    assert bad.collect() == [] and {r.doc_id: r.result for r in out.collect()} == {r.doc_id: r.result for r in whole.collect()}


def test_no_side_of_the_round_trips_goes_through_the_driver(spark):
    """Results and plans grow with the documents, but their estimates are those of a few numbers a row: none may be broadcast."""
    for name in ("generated_round_trip", "read_round_trip", "layout_round_trip", "composed_results"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan or "Join" not in plan, name
        assert "BroadcastExchange" not in plan, name
