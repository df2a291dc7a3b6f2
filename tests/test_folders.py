"""Sharded folders as a source: rows equal a listing, filters prune, pages follow one another."""

import os

import pytest
from pyspark.sql import functions as F

from pagefold.sources import folders


@pytest.fixture
def listed(spark, tmp_path):
    want = []
    for i in range(40):
        shard, name = f"{i % 7:02x}", f"blob-{i:03d}" + (".pdf" if i % 3 else ".json")
        (tmp_path / shard).mkdir(exist_ok=True)
        (tmp_path / shard / name).write_bytes(b"x" * i)
        want.append((shard, name, i, str(tmp_path / shard / name)))
    (tmp_path / "stray.txt").write_text("beside the shards")
    (tmp_path / "empty").mkdir()
    spark.dataSource.register(folders.Folders)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield tmp_path, sorted(want)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def load(spark, path):
    return spark.read.format("folders").option("path", path).load()


def test_rows_equal_a_listing(spark, listed):
    path, want = listed
    for uri in (str(path), f"file://{path}", f"{path}/"):
        rows = load(spark, uri)
        assert sorted((r.shard, r.name, r.bytes, r.path) for r in rows.collect()) == want and rows.rdd.getNumPartitions() == 8
    assert all(abs(r.modified - os.path.getmtime(r.path) * 1000) < 2 for r in rows.collect())
    assert load(spark, str(path / "nowhere")).collect() == [] and load(spark, str(path / "empty")).collect() == []


def test_filters_prune_shards_and_files(spark, listed):
    path, want = listed
    rows = load(spark, str(path))
    for condition, n in (("shard = '02'", 1), ("shard in ('01', '05')", 2), ("shard >= '05'", 3), ("shard > '01' and shard < '04'", 2), ("shard = 'none'", 1), ("name like 'blob-01%'", 8), ("shard = '02' and bytes > 10", 1)):
        got = rows.where(condition)
        frame = spark.createDataFrame(want, "shard string, name string, bytes long, path string").where(condition)
        assert sorted((r.shard, r.name) for r in got.collect()) == sorted((r.shard, r.name) for r in frame.collect()), condition
        assert got.rdd.getNumPartitions() == n, condition


def test_pages_follow_one_another(spark, listed):
    path, want = listed
    after, seen = None, []
    while rows := folders.page(load(spark, str(path)), after, 9).collect():
        seen += [(r.shard, r.name) for r in rows]
        after = seen[-1]
    assert seen == [w[:2] for w in want]


def test_reader_alone(tmp_path):
    with pytest.raises(ValueError, match="path"):
        folders.Folders({}).reader(None)
    reader = folders.Reader(str(tmp_path))
    odd = [folders.EqualTo(("bytes",), 3), folders.EqualTo(("shard",), None), folders.GreaterThan(("name",), "b")]
    assert list(reader.pushFilters(odd)) == odd[:2] and reader.filters == odd[2:]
    assert [list(reader.read(p)) for p in reader.partitions()] == [[]]


def test_null_columns_do_not_match(spark, listed):
    assert load(spark, str(listed[0])).where(F.col("shard").isNull()).collect() == []


def test_members_of_files_by_range(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "CHUNK", 5)
    texts = {"a": '{"x": [1, 2], "y":"é"}', "b": '{"x":', "c": "{}", "d": '{"long":"' + "s" * 100 + '"}'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("a", "b", "c", "d", "none")] + [(None,)], "path string")
    rows = folders.member_ranges(files, most_bytes=60).collect()
    told = sorted((os.path.basename(r.path), r.name, r.start, r.end, (r.problem or "").split(":")[0]) for r in rows)
    assert [t for t in told if t[0] == "a"] == [("a", "x", 6, 12, ""), ("a", "y", 18, 22, "")]
    assert [t[:2] + t[4:] for t in told if t[0] != "a"] == [("b", None, "Malformed"), ("d", None, "Malformed"), ("none", None, "FileNotFoundError")]
    raw = (tmp_path / "a").read_bytes()
    assert raw[6:12] == b"[1, 2]" and raw[18:22].decode() == '"é"'
