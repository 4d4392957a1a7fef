"""A directory tree as a table: the Python data source ``filetree``.

Unlike the built-in binary source it lists empty files and names that begin with ``_``, and it tells creation times with
their provenance. Directories directly below the root are read by separate tasks. Content is not read here: see
``with_content``, which a plan that doesn't use it never runs.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusloom.functions import files as X

SCHEMA = "path string, rel_path string, size_bytes bigint, mtime timestamp_ntz, ctime timestamp_ntz, ctime_source string"


class _Part(InputPartition):
    def __init__(self, directory: str, deep: bool):
        self.directory, self.deep = directory, deep


def creation_time(stat: os.stat_result, windows: bool = os.name == "nt") -> tuple[datetime | None, str]:
    """The creation time and what it rests on, the best source first."""
    birth = getattr(stat, "st_birthtime", None)
    if birth is not None:
        return datetime.fromtimestamp(birth), "birthtime"
    return datetime.fromtimestamp(stat.st_ctime), "win_ctime" if windows else "status_ctime"


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options.get("path") or "")
        if not os.path.isdir(self.root):
            raise ValueError(f"no such directory: {self.root}")

    def partitions(self) -> list[InputPartition]:
        below = sorted(e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False))
        return [_Part(self.root, False), *(_Part(p, True) for p in below)]

    def read(self, part: _Part) -> Iterator[tuple]:
        for at, dirs, names in os.walk(part.directory):
            if not part.deep:
                dirs.clear()
            for name in sorted(names):
                path = os.path.join(at, name)
                rel = os.path.relpath(path, self.root).replace(os.sep, "/")
                try:
                    stat = os.stat(path)
                    yield path, rel, stat.st_size, datetime.fromtimestamp(stat.st_mtime), *creation_time(stat)
                except OSError:  # it is still a file of the tree
                    yield path, rel, 0, None, None, "unavailable"


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FileTreeReader(self.options)


def _purged(dirs: tuple[str, ...], names: tuple[str, ...], suffixes: tuple[str, ...]) -> Column:
    return X.purge_reason(F.col("rel_path"), X.PURGED_DIRECTORIES + dirs, X.PURGED_NAMES + names, X.PURGED_SUFFIXES + tuple(s.lower() for s in suffixes))


def _tree(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").load(root)


def scan(spark: SparkSession, root: str, images: tuple[str, ...] = X.IMAGE_EXTENSIONS, extra_dirs: tuple[str, ...] = (), extra_names: tuple[str, ...] = (), extra_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """The catalog of a tree: purged, classified, with ids; in no order (``catalog_order`` gives the report's)."""
    return classified(_tree(spark, root).where(_purged(extra_dirs, extra_names, extra_suffixes).isNull()), images)


def purge_counts(spark: SparkSession, root: str, extra_dirs: tuple[str, ...] = (), extra_names: tuple[str, ...] = (), extra_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """``reason, files`` of what ``scan`` leaves out."""
    why = _purged(extra_dirs, extra_names, extra_suffixes)
    return _tree(spark, root).select(why.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("files"))


def classified(files: DataFrame, images: tuple[str, ...] = X.IMAGE_EXTENSIONS) -> DataFrame:
    ext = X.suffix(F.col("rel_path"))
    return files.withColumns({"ext": ext, "kind": X.kind_of(ext, images), "size_class": X.size_class(F.col("size_bytes")), "file_id": X.file_id(F.col("rel_path")), "file_key": X.file_key(F.col("rel_path"))})


def catalog_order() -> list[Column]:
    """Case-insensitive by path; the path itself makes the order total."""
    return [F.lower("rel_path"), F.col("rel_path")]


def with_content(files: DataFrame, path: str = "path", max_bytes: int = 1 << 31) -> DataFrame:
    """``files`` with ``content`` and ``read_error``; larger files than ``max_bytes`` and unreadable ones have no content."""
    schema = files.schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(path)
            for i in range(batch.num_rows):  # one file at a time, so that memory holds one content
                row, p = batch.slice(i, 1), batch.column(at)[i].as_py()
                content = error = None
                try:
                    if os.path.getsize(p) > max_bytes:
                        error = f"size>{max_bytes}"
                    else:
                        with open(p, "rb") as f:
                            content = f.read()
                except (OSError, TypeError) as e:
                    error = f"read_error: {type(e).__name__}"
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary()), pa.array([error], pa.string())], [*row.schema.names, "content", "read_error"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return files.mapInArrow(read, f"{columns}, content binary, read_error string")
