"""Content hashes and groups of files with equal content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordering import numbered
from corpusloom.operators.skew import join_counts
from corpusloom.session import materialize


def content_hash(content: Column, algo: str = "sha256") -> Column:
    if algo == "sha256":
        return F.sha2(content, 256)
    if algo == "sha1":
        return F.sha1(content)
    if algo == "md5":
        return F.md5(content)
    raise ValueError(f"unknown hash algorithm: {algo}")


def with_hash(files: DataFrame, content: Column, size: Column, algo: str = "sha256", max_bytes: int = 0, when: Column | None = None) -> DataFrame:
    """``content_hash``, its algorithm, or the reason why there is none. Empty content is hashed; ``max_bytes`` 0 is no limit.

    A plan that doesn't use the hash never reads the content.
    """
    too_large = (size > max_bytes) if max_bytes > 0 else F.lit(False)
    wanted = F.lit(True) if when is None else when
    hashed = F.when(wanted & ~too_large, content_hash(content, algo))
    reason = F.when(wanted & too_large, F.format_string("size>%d", F.lit(max_bytes))).when(wanted & content.isNull(), "read_error")
    return files.withColumn("content_hash", hashed).withColumn("content_hash_algo", F.when(F.col("content_hash").isNotNull(), algo)).withColumn("content_hash_skipped_reason", reason)


def hash_outcomes(files: DataFrame) -> DataFrame:
    """``ok, oversize, failed``: one row."""
    skipped = F.col("content_hash_skipped_reason")
    return files.agg(
        F.count_if(F.col("content_hash").isNotNull()).alias("ok"),
        F.count_if(F.coalesce(skipped.startswith("size>"), F.lit(False))).alias("oversize"),
        F.count_if(F.coalesce(~skipped.startswith("size>"), F.lit(False))).alias("failed"),
    )


def duplicate_groups(files: DataFrame, path: str = "rel_path", size: str = "size_bytes") -> DataFrame:
    """``content_hash, files, main_path, main_size, redundant_bytes`` of each content that two or more files share.

    The main file is the first by lower-cased path. Only counts and least rows are kept per hash, with map-side combining, so
    a content that a third of all files share costs one row per task.
    """
    first = F.min(F.struct(F.lower(path).alias("l"), F.col(path).alias("p"), F.col(size).cast("bigint").alias("s")))
    return (
        files.where(F.col("content_hash").isNotNull())
        .groupBy("content_hash")
        .agg(F.count("*").alias("files"), first.alias("m"))
        .where("files > 1")
        .select("content_hash", "files", F.col("m.p").alias("main_path"), F.col("m.s").alias("main_size"), (F.col("m.s") * (F.col("files") - 1)).alias("redundant_bytes"))
    )


def duplicate_roles(files: DataFrame, path: str = "rel_path", size: str = "size_bytes", keep: tuple[str, ...] | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Every file of a duplicate group with its role, ``MAIN`` or ``DUP``, and the columns ``keep`` (all, if None); ``groups`` may
    bring numbers along. A content that a third of all files share is joined without bringing them together."""
    if groups is None:
        groups = duplicate_groups(files, path, size)
    groups = materialize(groups.drop("main_size"), "groups")
    wanted = files if keep is None else files.select("content_hash", *dict.fromkeys((*keep, path)))
    rows = materialize(wanted.where(F.col("content_hash").isNotNull()), "hashed")
    return join_counts(rows, groups, "content_hash", "files").withColumn("role", F.when(F.col(path) == F.col("main_path"), "MAIN").otherwise("DUP"))


def ranked_groups(groups: DataFrame) -> DataFrame:
    """Groups in report order (most redundant first, then by main path) with their number."""
    return numbered(groups, [-F.col("redundant_bytes"), F.col("main_path"), F.col("content_hash")], "group_no")


def duplicate_totals(groups: DataFrame) -> DataFrame:
    """``groups, files, redundant_files, redundant_bytes``: one row, zeros where there is no group."""
    zero = F.lit(0).cast("bigint")
    return groups.agg(
        F.count("*").alias("groups"),
        F.coalesce(F.sum("files"), zero).alias("files"),
        F.coalesce(F.sum(F.col("files") - 1), zero).alias("redundant_files"),
        F.coalesce(F.sum("redundant_bytes"), zero).alias("redundant_bytes"),
    )
