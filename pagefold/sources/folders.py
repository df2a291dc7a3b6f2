"""Sharded folders as a source: a row for each file, a task for each shard, shards pruned by pushed filters.

    spark.dataSource.register(folders.Folders)
    spark.read.format("folders").option("path", "s3://bucket/blobs").load().where("shard = 'ab'")

Filters on `shard` prune folders before anything is listed, and those on `name` leave files out as they are listed.  Spark
wants spark.sql.python.filterPushdown.enabled to be set for that, and says so where it is not.  The driver lists shards,
never files.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

SCHEMA = "shard string, name string, bytes bigint, modified bigint, path string"


def opened(uri: str):
    """(file system, path) of a folder given as a path or URI."""
    from pyarrow import fs

    at = re.sub(r"^file:(//)?(?=/)", "", uri).rstrip("/")
    return fs.FileSystem.from_uri(uri.rstrip("/")) if "://" in at else (fs.LocalFileSystem(), at)


def holds(filters: list[Filter], column: str, value: str) -> bool:
    """Whether a value passes all filters that name its column."""
    tests = {
        EqualTo: lambda f: value == f.value, In: lambda f: value in f.value, StringStartsWith: lambda f: value.startswith(f.value), GreaterThan: lambda f: value > f.value,
        GreaterThanOrEqual: lambda f: value >= f.value, LessThan: lambda f: value < f.value, LessThanOrEqual: lambda f: value <= f.value,
    }
    return all(tests[type(f)](f) for f in filters if f.attribute == (column,))


class Shard(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class Reader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri, self.filters = uri, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        told = (EqualTo, In, StringStartsWith, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
        for f in filters:
            values = f.value if isinstance(f, In) else (getattr(f, "value", None),)
            # Names are compared by code points here and by bytes in Spark, which order alike.
            if type(f) in told and f.attribute in (("shard",), ("name",)) and all(isinstance(v, str) for v in values):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Shard]:
        from pyarrow import fs

        store, at = opened(self.uri)
        found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return [Shard(f.base_name) for f in sorted(found, key=lambda f: f.base_name) if f.type == fs.FileType.Directory and holds(self.filters, "shard", f.base_name)] or [Shard("")]

    def read(self, partition: Shard) -> Iterator[tuple]:
        from pyarrow import fs

        if not partition.name:
            return
        store, at = opened(self.uri)
        # A shard that went since it was listed has no files.
        for f in store.get_file_info(fs.FileSelector(f"{at}/{partition.name}", allow_not_found=True)):
            if f.type == fs.FileType.File and holds(self.filters, "name", f.base_name):
                yield partition.name, f.base_name, f.size, f.mtime_ns // 1_000_000 if f.mtime_ns else None, f.path


class Folders(DataSource):
    """Files one level below a folder's sub-folders, the shards; SCHEMA, in no order."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        if not self.options.get("path"):
            raise ValueError("the folder is given by the option path")
        return Reader(self.options["path"])


def page(files, after: tuple[str, str] | None, limit: int):
    """The next `limit` files in the order of (shard, name), behind the last one of the page before."""
    from pyspark.sql import functions as F

    rows = files if after is None else files.where((F.col("shard") > after[0]) | (F.col("shard") == after[0]) & (F.col("name") > after[1])).where(F.col("shard") >= after[0])
    return rows.orderBy("shard", "name").limit(limit)

#: Bytes that a task reads of a file at once.
CHUNK = 1 << 20


def member_ranges(files, path: str = "path", store: str = "", most_bytes: int | None = None):
    """(path, name, start, end, problem): where the members of the JSON object in each file begin and end.

    A task holds a chunk of a file and no more, so that files may be larger than memory; `store` is put before each path
    (as `s3://`).  A file that cannot be read, is no JSON object, or has more than most_bytes gives one row with its
    problem, behind the members that were told before it was met.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    from pagefold.functions import bytescan

    def scanned(uri: str):
        try:
            fs, at = opened(uri)
            with fs.open_input_stream(at) as f:
                yield from ((*found, None) for found in bytescan.member_ranges(iter(lambda: f.read(CHUNK), b""), most_bytes))
        except (OSError, ValueError) as e:
            yield None, None, None, f"{type(e).__name__}: {e}"

    def run(batches):
        for b in batches:
            for at in b.column(0).to_pylist():
                if rows := list(scanned(store + at)):
                    names, starts, ends, problems = map(list, zip(*rows, strict=True))
                    told = [pa.array(names, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(problems, pa.string())]
                    yield pa.RecordBatch.from_arrays([pa.array([at] * len(rows), pa.string()), *told], ["path", "name", "start", "end", "problem"])

    return files.where(F.col(path).isNotNull()).select(F.col(path).alias("path")).mapInArrow(run, "path string, name string, start bigint, end bigint, problem string")
