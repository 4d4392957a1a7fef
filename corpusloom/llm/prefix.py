"""Running sums over groups of any size, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slices of a group; a group of a third of all rows is summed in so many tasks.
SLICES = 4096


def running_sums(df: DataFrame, group: str, value: str, order: str, slices: int = SLICES, out: str = "start") -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the group that come before, in a seeded order.

    The order is by the hash of ``order`` (a unique id), cut into slices by its leading part. Slices are summed first (at most
    ``slices`` rows a group), then only the rows inside a slice are put in order.
    """
    keyed = df.withColumn("_h", F.xxhash64(F.col(order), F.lit(17))).withColumn("_slice", F.pmod(F.shiftrightunsigned("_h", 32), F.lit(slices)).cast("int"))
    whole = keyed.groupBy(group, "_slice").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(F.col(group).alias("_g"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_slice").orderBy("_h", order).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = placed.join(whole, placed[group].eqNullSafe(F.col("_g")) & (F.col("_slice") == F.col("_s")))
    return joined.withColumn(out, F.col("_inside") + F.col("_before")).drop("_h", "_slice", "_inside", "_before", "_g", "_s")
