"""Work that is bounded by task: slices of batches, tasks of so many rows, digests by blocks, quick readers that equal the slow ones."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagefold import catalog
from pagefold.functions import arrowrows, jsontext, jsontree, units
from pagefold.operators import planning, shred
from pagefold.plans import assembly


def test_slices_hold_so_many_bytes_and_every_row():
    rows = [[{"a": "x" * (i % 50), "b": list(range(i % 4))}] * (i % 3) if i % 7 else None for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(rows, pa.list_(pa.struct([("a", pa.string()), ("b", pa.list_(pa.int64()))])))], ["i", "v"])
    found = list(arrowrows.slices([batch], 4096))
    assert len(found) > 10 and all(b.nbytes <= 4096 for b in found)
    assert [v for b in found for v in arrowrows.values(b.column(1))] == rows and sum((b.column(0).to_pylist() for b in found), []) == list(range(2000))
    wide = pa.RecordBatch.from_arrays([pa.array(["y" * 9000, "z", "w" * 9000])], ["t"])
    assert [b.num_rows for b in arrowrows.slices([wide], 4096)] == [1, 1, 1] or sum(b.num_rows for b in arrowrows.slices([wide], 4096)) == 3


def test_one_row_group_is_dealt_to_all_tasks(spark, tmp_path):
    spark.range(8000).selectExpr("id", "repeat(cast(id as string), 20) as t").coalesce(1).write.parquet(f"{tmp_path}/x.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        dealt = catalog.spread(spark.read.parquet(f"{tmp_path}/x.parquet"), "id", 1000)
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(sizes) == 8000 and max(sizes) < 2000


def test_digests_by_blocks_equal_those_of_whole_groups(spark):
    data = [(k, i, None if i % 11 == 3 else f"{k}{i}") for k in ("a", "b") for i in range(0, 30_000, 7)] + [("c", 5, None), ("d", -9000, "x"), ("d", 1, ""), ("d", 1, "y")]
    rows = spark.createDataFrame(data, "k string, i long, v string").repartition(5)
    found = {r.k: (r.n, r.h) for r in shred.digests(rows, ["k"], "i", "v", "h").collect()}
    for k in "abcd":
        own = sorted((i, v or "") for key, i, v in data if key == k and v is not None)
        assert found[k] == (sum(key == k for key, *_ in data), hashlib.md5(",".join(v for _, v in own).encode()).hexdigest())


def test_slices_of_utf16_units_split_no_character(spark):
    texts = ["a😀b", "", "😀😀", "é\n中x", None]
    for at in range(-1, 5):
        for n in range(0, 5):
            got = [r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select(units.unit_slice(F.col("t"), F.lit(at), F.lit(n), units.UTF16).alias("c")).collect()]
            for t, c in zip(texts, got, strict=True):
                places = [0]
                for ch in t or "":
                    places.append(places[-1] + len(ch.encode("utf-16-be")) // 2)
                ok = t is not None and at in places and at + n in places
                assert c == (t[places.index(at) : places.index(at + n)] if ok else None), (t, at, n)


@pytest.mark.parametrize("text", ['{"a\\u0062":[1.50,-0,1E3,"x\\"\\\\n\\ud83d\\ude00"],"a":null,"a":true}', ' [ {} , [] ] ', '"\\n"', "1", '{"n":01}', "NaN", '["\\x"]', "[1]x", "", '{"' + "n" * 5000 + '":1}', '["a\tb"]'])
def test_quick_trees_keep_every_spelling_and_refuse_the_same(text):
    try:
        want = [(p, k, text[a:b]) for p, k, a, b, n in jsontext.values(text) if n < 0]
    except ValueError as e:
        with pytest.raises(jsontext.Malformed) as found:
            jsontree.parse(text)
        assert str(found.value) == str(e)
    else:
        assert [(p, n.kind, n.raw) for p, n in jsontree.walk(jsontree.parse(text)) if n.kind not in ("Object", "Array")] == want


def test_quick_measures_equal_those_of_one_pass(monkeypatch):
    texts = [
        '{"content":"a\\n","pages":[{"pageNumber":1,"spans":[{"offset":0,"length":2}]},{"page\\u004eumber":2}],"x":{"a":1}}', '{"pages":[{"pageNumber":1,"pageNumber":2}],"content":3}', '{"pages":{"0":{"pageNumber":1}}}',
        '{"content":"","pages":[{},{"pageNumber":0},{"spans":{"k":{"offset":1,"length":7}}}]}', '{"pages":[],"pages":[]}', "{}", " {} x", "[]", '{"content":"a",}', '{"p\\u0061ges":[1, 2.0]}',
    ]
    quick = [assembly.measure(t, assembly.DI) for t in texts]
    assert any(jsontext.decoded_members(t) for t in texts)
    monkeypatch.setattr(jsontext, "decoded_members", lambda text: None)
    assert quick == [assembly.measure(t, assembly.DI) for t in texts]


def test_coverage_is_one_grouping(spark, capsys):
    rows = lambda data: spark.createDataFrame(data, "doc_id long, page long")
    found = planning.coverage_violations(rows([(1, 1), (1, 1), (1, 3), (2, 2)]), rows([(1, 1), (1, 2), (2, 2)]))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 2), (1, 2, 0), (1, 3, 1)]
    found.explain()
    assert "Join" not in capsys.readouterr().out
