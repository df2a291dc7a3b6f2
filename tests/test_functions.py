import pytest
from pyspark.sql import functions as F

from pagefold.functions import pages, text, units
from pagefold.operators import attempts, diffing, merge, metrics, planning
from pagefold.plans import reassembly
from pagefold.sources import blobs


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value,points,utf16,clusters",
    [("", 0, 0, 0), ("abc", 3, 3, 3), ("é", 1, 1, 1), ("é", 2, 2, 1), ("👨‍👩‍👧", 5, 8, 1), ("🇩🇪", 2, 4, 1), ("a\nb", 3, 3, 3), ("a\r\nb", 4, 4, 3)],
)
def test_unit_lengths(spark, value, points, utf16, clusters):
    got = [one(spark, units.unit_length(F.col("t"), u), t=value) for u in (units.CODE_POINTS, units.UTF16, units.GRAPHEMES)]
    assert got == [points, utf16, clusters]


def test_unit_names_slices_and_integers(spark):
    assert one(spark, units.parse_unit(F.col("t")), t="") == units.GRAPHEMES and one(spark, units.parse_unit(F.col("t")), t="TextElements") is None
    assert one(spark, units.unit_slice(F.col("t"), F.lit(1), F.lit(2), units.GRAPHEMES), t="xéyz") == "éy"
    assert one(spark, units.unit_slice(F.col("t"), F.lit(3), F.lit(2), units.CODE_POINTS), t="abcd") is None
    for t, want in (("0", 0), ("17", 17), ("017", None), ("-1", None), ("1" * 18, int("1" * 18)), ("1" * 19, None), ("x", None)):
        assert one(spark, units.canonical_integer(F.col("t")), t=t) == want


@pytest.mark.parametrize("spec,want", [("1-3,5", [1, 2, 3, 5]), (" 2 , 1 - 2\t", [1, 2]), ("7", [7]), ("9-9,8", [8, 9])])
def test_page_specs(spark, spec, want):
    assert one(spark, pages.select_pages(pages.parse_pages(F.col("s")), F.lit(9)), s=spec) == want


@pytest.mark.parametrize("spec", ["", "1-", "-3", "0", "3-1", "1,,2", "+1", "1;2", "1 ", "a", "1-2-3", "12345678901234567890"])
def test_bad_page_specs(spark, spec):
    assert one(spark, pages.parse_pages(F.col("s")), s=spec) is None


def test_page_lists(spark):
    assert one(spark, pages.select_pages(pages.parse_pages(F.col("s")), F.lit(4)), s="3-5") is None
    spelled = lambda *p: one(spark, pages.format_pages(F.col("p")), p=list(p))
    assert spelled(3, 4, 5, 9) == "3-5,9" and spelled(1) == "1" and spelled(1, 3, 4) == "1,3-4"
    assert one(spark, pages.halves(F.col("p")), p=[1, 2, 5]) == [[1, 2], [5]] and one(spark, pages.halves(F.col("p")), p=[1]) is None
    assert one(spark, pages.ascending(F.col("p")), p=[1, 2, 9]) and not one(spark, pages.ascending(F.col("p")), p=[1, 1])


def test_balanced_plans(spark):
    rows = spark.range(1, 61).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(1).cast("bigint"), "id")).alias("page"))
    for most in (1, 3, 8):
        sizes = planning.balanced_plan(rows, most).groupBy("doc_id", "part").agg(F.count("*").alias("n"), F.min("page").alias("a"), F.max("page").alias("b"), F.max("local_no").alias("l")).collect()
        for n in range(1, 61):
            parts = sorted((r.part, r.n, r.a, r.b, r.l) for r in sizes if r.doc_id == n)
            lengths = [p[1] for p in parts]
            assert len(parts) == -(-n // most) and max(lengths) - min(lengths) <= 1 and lengths == sorted(lengths, reverse=True)
            assert all(b - a + 1 == k == last for _, k, a, b, last in parts) and sum(lengths) == n


def test_pointers_figures_masks(spark):
    assert tuple(one(spark, text.pointer(F.col("t")), t="/tables/12")) == ("tables", 12)
    for bad in ("/tables/012", "tables/1", "/tables/", "/words/1", "/tables/-1", "/pages/0", "/tables/0\n"):
        assert one(spark, text.pointer(F.col("t")), t=bad) is None
    assert tuple(one(spark, text.figure_id(F.col("t")), t="2.07")) == (2, "07") and one(spark, text.figure_id(F.col("t")), t="0.1") is None
    assert one(spark, text.mask(F.col("t"), F.lit("http://h")), t="http://h/x/3F2504E0-4F89-11D3-9A0C-0305E82C3301") == "<base>/x/<guid>"
    assert one(spark, text.mask(F.col("t")), t="2024-05-06T07:08:09Z") == "<datetime:2006-01-02T15:04:05Z>" and one(spark, text.mask(F.col("t")), t="at 2024-05-06T07:08:09Z") == "at 2024-05-06T07:08:09Z"


def test_attempts(spark):
    wait = lambda n, told, j: one(spark, attempts.backoff(F.col("n"), F.col("told"), F.col("j")), n=n, told=told, j=j)
    assert (wait(1, 0, 0.0), wait(1, 0, 1.0), wait(4, 0, 1.0), wait(50, 0, 2.0), wait(1, 7, 0.0), wait(1, 900, 0.0), wait(2, 0, float("nan"))) == (1.0, 2.0, 16.0, 60.0, 7.0, 60.0, 2.0)
    for raw, want in (("7", 7), (" 7 ", 7), ("-1", 0), ("x", 0), ("99999999", 86400), ("", 0)):
        assert one(spark, attempts.retry_after(F.col("t")), t=raw) == want
    values = spark.createDataFrame([(0.1,), (0.3,), (1.0,), (400.0,)], "v double")
    counts = {r.le: r.n for r in metrics.histogram(values, "v").collect()}
    assert [counts[b] for b in (0.25, 0.5, 1.0, 2.0, 300.0, float("inf"))] == [1, 2, 3, 3, 3, 4]


def test_merge_of_cut_rows_is_the_identity(spark):
    rows = spark.range(1, 24).select(F.lit(1).alias("doc_id"), F.col("id").alias("page"), F.concat(F.lit("w"), "id").alias("word"))
    plan = planning.balanced_plan(rows.select("doc_id", "page"), 5)
    parts = merge.cut(rows, plan, "doc_id", "page").select("doc_id", "part", F.col("local_no").alias("number"), "word")
    back = merge.remap_pages(parts, plan, "doc_id", "part", "number")
    assert sorted((r.planned_page, r.word) for r in back.collect()) == sorted((r.page, r.word) for r in rows.collect())


def test_reassembly_refuses_bad_parts(spark):
    parts = spark.createDataFrame([(1, 0, [1, 2], "a"), (1, 1, [1], "b"), (2, 0, [1], "x\r"), (2, 1, [1], "y"), (3, 0, [1, 2], "z"), (4, 0, [7], "q"), (5, 0, [1], None), (6, 0, [1], "s"), (6, 1, [1], "t")], "doc_id int, k int, pages array<int>, content string")
    plan = spark.createDataFrame([(1, 0, [3, 4]), (1, 1, [9]), (2, 0, [1]), (2, 1, [2]), (3, 0, [1]), (4, 0, [6]), (5, 0, [1]), (6, 0, [5]), (6, 1, [5])], "doc_id int, k int, planned array<int>")
    merged, found = reassembly.reassemble(parts, plan)
    assert {(r.doc_id, r.k, r.code) for r in found.collect()} == {(2, 0, "V20"), (3, 0, "V16"), (4, 0, "V17"), (5, 0, "V09"), (6, 1, "V15")}
    assert [tuple(r) for r in merged.collect()] == [(1, "a\nb")]
    assert [(r.k, r["len"], r["shift"]) for r in reassembly.shifts(parts.where("doc_id = 1")).orderBy("k").collect()] == [(0, 1, 0), (1, 1, 2)]


def test_differences_and_blobs(spark):
    a = spark.createDataFrame([("p", 1, "x"), ("p", 2, None), ("q", 1, "y")], "k string, i int, v string")
    b = spark.createDataFrame([("p", 1, "z"), ("p", 2, None), ("r", 1, "n")], "k string, i int, v string")
    assert {(r.k, r.i, r.kind) for r in diffing.differences(a, b, ["k", "i"], "v").collect()} == {("p", 1, "changed"), ("q", 1, "missing"), ("r", 1, "added")}
    path = lambda i: one(spark, blobs.blob_path(F.col("t"), F.lit("res")), t=i)
    assert [path(i) for i in ("abcdef", "ab", "a", "", "a/../b")] == ["ab/cd/abcdef.res", "ab/zz/ab.res", "zz/zz/a.res", "zz/zz/_.res", "a_/__/a____b.res"]


def test_redaction(spark):
    assert one(spark, text.redact_url(F.col("t")), t="http://u:p@h/x") == "http://u:xxxxx@h/x" and one(spark, text.redact_url(F.col("t")), t="http://h:8/x@y") == "http://h:8/x@y"


def test_nested_arrow_columns_as_python_values():
    import random

    import pyarrow as pa

    from pagefold.functions import arrowrows

    rng = random.Random(1)
    kind = pa.list_(pa.struct([("k", pa.int64()), ("m", pa.list_(pa.struct([("n", pa.string()), ("b", pa.bool_())]))), ("s", pa.list_(pa.int64()))]))
    inner = lambda: None if rng.random() < 0.2 else [{"n": rng.choice(["a", None]), "b": True} for _ in range(rng.randint(0, 3))]
    rows = [None if rng.random() < 0.1 else [{"k": rng.choice([1, None]), "m": inner(), "s": [1, 2]} for _ in range(rng.randint(0, 4))] for _ in range(200)]
    column = pa.array(rows, kind)
    assert arrowrows.values(column) == rows and arrowrows.values(column.slice(33, 50)) == rows[33:83] and arrowrows.values(column.slice(0, 0)) == []
