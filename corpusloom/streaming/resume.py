"""Catalog rows as a stream: every file version is processed once, across restarts.

The stream's checkpoint remembers which input files were read; the ledger, written together with a batch's results, removes
what a repeated batch or a late delivery would process again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corpusloom.functions.paths import canonical_path

LEDGER = "tree_id int, file_path string, version timestamp_ntz"


def process_versions(spark: SparkSession, arriving: str, schema: StructType, out: str, work: Callable[[DataFrame], DataFrame], checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Read catalog rows as Parquet files arrive; apply ``work`` to the new versions of each batch; append results and ledger.

    A batch is written to folders named by its number, so that a repeated batch overwrites itself.
    """

    def one(batch: DataFrame, number: int) -> None:
        keyed = batch.select("*", canonical_path(F.col("rel_path")).alias("file_path"), F.col("mtime").alias("version"))
        first = keyed.dropDuplicates(["tree_id", "file_path", "version"])
        ledger = _ledger(batch.sparkSession, out, number)
        same = first["tree_id"].eqNullSafe(ledger["tree_id"]) & first["file_path"].eqNullSafe(ledger["file_path"]) & first["version"].eqNullSafe(ledger["version"])
        new = first.join(ledger, same, "left_anti").persist()
        work(new.drop("file_path", "version")).write.mode("overwrite").parquet(f"{out}/results/batch={number}")
        new.select("tree_id", "file_path", "version").write.mode("overwrite").parquet(f"{out}/ledger/batch={number}")
        new.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(arriving)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ledger(spark: SparkSession, out: str, number: int) -> DataFrame:
    """The versions of the batches before this one."""
    try:
        return spark.read.schema(LEDGER + ", batch bigint").parquet(f"{out}/ledger").where(F.col("batch") < number).drop("batch")
    except Exception as e:  # the first batch finds no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)
