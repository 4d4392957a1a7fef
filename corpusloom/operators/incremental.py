"""Processing only new or changed records.

A record is a file (``tree_id`` and canonical ``rel_path``), its version is ``mtime``; null is a version of its own.
A run commits its state to the shared storage: the time of the oldest transaction still open, and the files that are still
pending. The next run rereads what was loaded since that time, takes the pending files along, and anti-joins (key, version) pairs
against the ledger of processed versions, so that the overlap of two reads is removed and neither a failure nor a late row
skips or repeats a version.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpusloom.functions.paths import canonical_path
from corpusloom.session import materialize

KEY = ["tree_id", "file_path"]


def processed_ledger(journal: DataFrame, runs: DataFrame) -> DataFrame:
    """The versions that are done: ``done`` entries of runs whose output was kept, each once."""
    kept = runs.where(F.col("output_kept")).select("scan_no").distinct()
    return (
        journal.where((F.lower(F.trim("state")) == "done") & F.col("tree_id").isNotNull() & F.col("rel_path").isNotNull())
        .join(kept, "scan_no", "left_semi")
        .select("tree_id", canonical_path(F.col("rel_path")).alias("file_path"), F.col("mtime").alias("version"))
        .distinct()
    )


def keyed(catalog: DataFrame) -> DataFrame:
    """The files of the catalog, with their canonical path: ``tree_id, file_path, version, scan_no, scan_row_id, loaded_at``.

    Rows without a tree or path are no files and are left out. Extra columns are ignored.
    """
    known = catalog.where("tree_id IS NOT NULL AND rel_path IS NOT NULL")  # before the path crosses into Python
    return known.select("tree_id", canonical_path(F.col("rel_path")).alias("file_path"), F.col("mtime").alias("version"), "scan_no", "scan_row_id", "loaded_at")


def current_versions(rows: DataFrame) -> DataFrame:
    """Of ``keyed`` rows, one row per file: the version in its rows of the highest ``scan_no`` and the smallest ``scan_row_id`` with that version.

    If rows of that scan disagree, the latest time counts (a time before null). Both groupings pre-aggregate before their
    shuffle, so a tree that holds a third of all rows is spread by path.
    """
    versions = rows.groupBy(*KEY, "version").agg(
        F.max("scan_no").alias("scan_no"), F.min("scan_row_id").alias("scan_row_id"), F.min("loaded_at").alias("loaded_at")
    )
    last = F.max(F.struct("scan_no", F.col("version").isNotNull().alias("known"), "version", "scan_row_id", "loaded_at"))
    return versions.groupBy(*KEY).agg(last.alias("last")).select(*KEY, "last.version", "last.scan_row_id", "last.scan_no", "last.loaded_at")


def pending_versions(rows: DataFrame, journal: DataFrame, runs: DataFrame) -> DataFrame:
    """The file versions of ``keyed`` rows that are still to be processed, each once: ``tree_id, file_path, version, scan_row_id,
    scan_no, loaded_at``. Empty tables give no rows; null states, times and flags never count as done."""
    now, done = current_versions(rows).alias("now"), processed_ledger(journal, runs).alias("done")
    same = [F.col(f"now.{k}") == F.col(f"done.{k}") for k in KEY] + [F.col("now.version").eqNullSafe(F.col("done.version"))]
    return now.join(done, same[0] & same[1] & same[2], "left_anti")


def next_versions(rows: DataFrame, journal: DataFrame, runs: DataFrame, state: RunState) -> DataFrame:
    """``pending_versions`` for the run after the committed ``state``: only files that were touched since the oldest transaction
    then open (or at an unknown time), and those then pending, are read; each with its whole history, so that a late row of an
    old scan can't pass for the current version. Without a usable state everything is read."""
    saved = state.read(runs)
    if saved is None:
        return pending_versions(rows, journal, runs)
    since, pending = saved
    touched = rows.where((F.col("loaded_at") >= F.lit(since)) | F.col("loaded_at").isNull()).select(*KEY)
    return pending_versions(rows.join(touched.union(pending).distinct(), KEY, "left_semi"), journal, runs)


class RunState:
    """What a run leaves to the next, in a folder that all machines share; written by Spark.

    The pending files are written first, then the row of ``marks`` that names them: a commit is that row. A run that fails
    before leaves the state as it was, and the next one rereads rather than skips.
    """

    MARKS = "number int, reread_from timestamp_ntz, kept array<int>"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _last(self):
        try:
            return self.spark.read.schema(self.MARKS).parquet(f"{self.folder}/marks").orderBy(F.desc("number")).first()
        except AnalysisException as e:  # nothing was committed yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def read(self, runs: DataFrame) -> tuple[datetime, DataFrame] | None:
        """The time to reread from and the files then pending; None (read everything) if nothing was committed, if that time is
        unknown, or if a run whose output had been kept at the commit is no longer so, as what it had done may be of any age."""
        last = self._last()
        if last is None or last.reread_from is None or not set(last.kept) <= _kept(runs):
            return None
        return last.reread_from, self.spark.read.schema("tree_id int, file_path string").parquet(f"{self.folder}/pending-{last.number}")

    def commit(self, rows: DataFrame, pending: DataFrame, runs: DataFrame) -> datetime | None:
        """Save the state after a run over ``keyed`` rows: reread from the newest load time, but no later than the start of any
        run that has not ended or whose output was not kept, which may yet show rows loaded since then."""
        last = self._last()
        number = last.number + 1 if last else 1
        at = rows.agg(F.max("loaded_at")).first()[0]
        unsettled = runs.where(F.col("ended_at").isNull() | ~F.coalesce("output_kept", F.lit(False)))
        start, n, known = unsettled.agg(F.min("started_at"), F.count("*"), F.count("started_at")).first()
        at = None if n > known or at is None else min(at, start) if n else at
        pending.select(F.col("tree_id").cast("int").alias("tree_id"), "file_path").write.mode("overwrite").parquet(f"{self.folder}/pending-{number}")
        mark = self.spark.createDataFrame([(number, at, sorted(_kept(runs)))], self.MARKS)
        mark.coalesce(1).write.mode("append").parquet(f"{self.folder}/marks")
        return at


def as_of(catalog: DataFrame, journal: DataFrame, runs: DataFrame, at: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``keyed`` rows, journal and runs as they stood at a time; runs that had not ended are open."""
    when = F.lit(at)
    then = runs.where(F.coalesce(F.col("started_at") <= when, F.lit(True))).withColumn("ended_at", F.when(F.col("ended_at") <= when, F.col("ended_at")))
    return catalog.where(F.col("loaded_at") <= when), journal.where(F.col("logged_at") <= when), then


def replayed(catalog: DataFrame, journal: DataFrame, runs: DataFrame, folder: str) -> DataFrame:
    """The versions that the next run has to process, through the state that the last run which ended has left (committed here
    from the tables as they stood then, as no run of theirs left one)."""
    rows = materialize(keyed(catalog), "files")
    state = RunState(catalog.sparkSession, folder)
    ended = runs.agg(F.max("ended_at")).first()[0]
    if ended is not None:
        old_rows, old_journal, old_runs = as_of(rows, journal, runs, ended)
        state.commit(old_rows, pending_versions(old_rows, old_journal, old_runs), old_runs)
    return next_versions(rows, journal, runs, state)


def _kept(runs: DataFrame) -> set[int]:
    """The runs whose output is kept; the table has one row per run."""
    return {r.scan_no for r in runs.where("output_kept AND scan_no IS NOT NULL").select("scan_no").distinct().collect()}
