"""Helpers shared by the training-data operators: table access, shared scratch space, text batches, joins with hot keys."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors get the task functions by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["pagefold"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a local master, where it is unset, a fresh one."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        told = "file://" + tempfile.mkdtemp(prefix="pagefold-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(told)
    return told.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; Hadoop deletes it when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote and that nothing will read any more."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of an Arrow batch that a task is given; a longer row stands alone.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's tasks get batches of about BATCH_BYTES at most.

    By default a batch is up to 10,000 rows or 64 MB of whole texts, held by the JVM outside its heap and by Python,
    once each way and in every task.  Rows and their order stay the same.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Bits that tell tasks which keys are in a set (2 MB, whatever the set's size).
SPOTS = 1 << 24


def spot_of(*columns):
    return F.pmod(F.xxhash64(*columns), F.lit(SPOTS))


def spots(keys: DataFrame, *columns) -> np.ndarray:
    """One bit for each hash of the keys: a key without its bit is not among them, one with it may be.

    At most SPOTS / 64 rows reach the driver; however many keys there are, the bits stay as many.
    """
    spot = keys.select(spot_of(*columns).alias("spot")).selectExpr("cast(spot div 64 as int) word", "shiftleft(1L, cast(spot % 64 as int)) bits")
    out = np.zeros(SPOTS // 64, np.int64)
    for r in spot.groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def spotted(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each of the spots in `at` has its bit."""
    return ((bits[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)) == 1


#: A key that holds more than one in so many rows is hot; so at most so many keys are, whatever the input.
HOT = 4096
#: Tasks that the rows of a hot key are dealt to.
SPREAD = 64


def hot_keys(counts: DataFrame, key: str = "key", n: str = "n", least: int = 1000) -> list:
    """The keys of (key, n) that hold more than 1/HOT of all rows, and more than `least`: at most HOT of them."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) > max(least, total / HOT)).select(key).collect()]


def salted_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, deal_by: str, hot: list, how: str = "inner", hint: str = "merge") -> DataFrame:
    """left joined to right, which has one row for each key, by a merge or what hint says: both sides may grow with the corpus.

    Rows of the hot keys are dealt to SPREAD tasks by the hash of deal_by, and their right rows are copied to each.
    """
    if not hot:
        return left.join(right.hint(hint), F.col(left_key) == F.col(right_key), how)
    salt = F.when(F.col(left_key).isin(hot), F.pmod(F.xxhash64(deal_by), F.lit(SPREAD))).otherwise(F.lit(0).cast("long"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))
    copies = F.when(F.col(right_key).isin(hot), every).otherwise(F.array(F.lit(0).cast("long")))
    left, right = left.withColumn("__salt", salt), right.withColumn("__copy", F.explode(copies))
    return left.join(right.hint(hint), (F.col(left_key) == F.col(right_key)) & (F.col("__salt") == F.col("__copy")), how).drop("__salt", "__copy")


def pieces(batch: pa.RecordBatch, column: int, limit: int = 1 << 20):
    """Slices of a record batch whose texts hold about `limit` bytes each; a longer text stands alone."""
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def file_system(uri: str):
    """(pyarrow file system or None, path) of a folder given as a URI: None where plain paths reach it."""
    at = re.sub(r"^file:(//)?(?=/)", "", uri)
    if "://" in at:
        from pyarrow import fs

        return fs.FileSystem.from_uri(uri)
    return None, at
