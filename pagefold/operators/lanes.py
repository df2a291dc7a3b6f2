"""Running sums and sliding windows over long lanes, a lane's rows dealt to blocks.

A lane may be a third of all rows.  A window over a whole lane is one task; here each block of a lane is one, and only
the blocks' totals, one row each, meet in a lane's window.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

#: Rows of a lane that slide in one task.
CHUNK = 16384


def running(rows: DataFrame, lane: list[str], block: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with `name`: the sum of `value` over a lane's rows up to and with each, by `order`.

    block: any orderable value that never falls along `order`; it says which rows one task sums.  The sum does not
    depend on it.  `order` must be total, or ties are taken in any order.  A null value adds nothing.
    """
    keyed = rows.withColumn("__block", block).withColumn("__value", F.coalesce(value, F.lit(0)).cast("bigint"))
    keys = [*lane, "__block"]
    totals = keyed.groupBy(*keys).agg(F.sum("__value").alias("__total"))
    before = Window.partitionBy(*lane).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*(F.col(c).alias(f"__of_{i}") for i, c in enumerate(keys)), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = keyed.withColumn("__within", F.sum("__value").over(upto))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__of_{i}")) for i, c in enumerate(keys)))
    met = summed.join(bases, same)
    return met.select(*rows.columns, (F.col("__base") + F.col("__within")).alias(name))


def sliding_median(rows: DataFrame, lane: list[str], block: Column, order: list[str], value: str, samples: int, chunk: int = CHUNK) -> DataFrame:
    """rows with `__n` and `__median`: how many rows, `samples` at most, come before each in its lane, and their median.

    Rows are numbered along the lane and dealt to chunks of equal size; each chunk also gets the last rows of the one
    before it, which are dropped again.  Null values have no part in a median.
    """
    placed = running(rows, lane, block, order, F.lit(1), "__place").withColumn("__chunk", F.floor((F.col("__place") - 1) / chunk))
    last = F.pmod(F.col("__place") - 1, F.lit(chunk)) >= chunk - samples
    both = F.when(last, F.array(F.col("__chunk"), F.col("__chunk") + 1)).otherwise(F.array(F.col("__chunk")))
    dealt = placed.withColumn("__to", F.explode(both))

    def slide(part: pa.Table) -> pa.Table:
        part = part.sort_by("__place")
        values = pd.Series(part[value].to_numpy(zero_copy_only=False), dtype="float64")
        before = pa.array(values.rolling(samples, min_periods=1).median().shift(1), pa.float64(), from_pandas=True)
        n = pc.min_element_wise(pc.subtract(part["__place"], 1), samples)
        part = part.append_column("__n", n).append_column("__median", before)
        return part.filter(pc.equal(part["__chunk"], part["__to"])).drop_columns(["__place", "__chunk", "__to"])

    kept = dealt.drop("__place", "__chunk", "__to").schema
    return dealt.groupBy(*lane, "__to").applyInArrow(slide, StructType([*kept, StructField("__n", LongType()), StructField("__median", DoubleType())]))
