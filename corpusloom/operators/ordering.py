"""Numbers over a total order of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize


def numbered(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """``df`` with 1-based numbers in an order, by ranges: each range counts itself and adds what lies before it.

    All of ``df`` is written once, so it should have no more columns than are needed.
    No task sees more than its range, unlike a window over everything.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    ranged = materialize(df.withColumns(keys).repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))  # one row a range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return ranged.withColumn("_inside", inside).join(F.broadcast(starts), "_part").withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint")).drop("_part", "_inside", "_before", *keys)
