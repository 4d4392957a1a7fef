"""Single files in a folder that all machines share, a path or a URI of any file system that Arrow knows."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame


def filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


class Aside:
    """A file that is written aside and renamed when it is whole, so that a repeated task writes the same file again."""

    def __init__(self, folder: str, name: str):
        self.system, base = filesystem(folder)
        self.system.create_dir(base, recursive=True)
        self.path = f"{base}/{name}"
        self.aside = f"{self.path}.{TaskContext.get().taskAttemptId()}"
        self.stream, self.bytes = self.system.open_output_stream(self.aside), 0

    def write(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.bytes += len(raw)

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.aside, self.path)


def write_files(texts: DataFrame, folder: str) -> DataFrame:
    """Write every row of ``texts(name, text)`` as a file; returns ``name, bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = Aside(folder, name)
                out.write((text or "").encode())
                out.close()
                sizes.append(out.bytes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return texts.select("name", "text").mapInArrow(run, "name string, bytes bigint")
