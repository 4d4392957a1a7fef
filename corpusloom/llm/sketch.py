"""Corpus counts in a dense table of fixed size, so that what is broadcast has a proven bound.

Keys are hashed into ``2**bits`` cells. Every partition keeps one dense array (its map-side combine) and emits it in blocks;
the blocks are summed on their own shuffle key, by streaming, so no task ever holds more than its share of the cells.
A cell can only over-count (two keys in one cell); ``rows`` independent hashes with a minimum make that rare.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 1 << 14
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an array of uint64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def cells_of(keys: np.ndarray, bits: int, seed: int = 0) -> np.ndarray:
    return (mix(keys, seed) >> np.uint64(64 - bits)).astype(np.int64)


def hashed_counts(df: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, rows: int = 1) -> np.ndarray:
    """``rows x 2**bits`` counts of the uint64 keys that ``keys`` yields for each Arrow batch of ``df`` (every row is read)."""
    size = rows << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for found in keys(batch):
                for r in range(rows):
                    at = cells_of(found, bits, r)
                    part = total[r << bits : (r + 1) << bits]
                    if at.size > (1 << bits) >> 3:
                        part += np.bincount(at, minlength=1 << bits)
                    else:
                        cells, n = np.unique(at, return_counts=True)
                        part[cells] += n
        blocks = total.reshape(-1, min(BLOCK, size))
        kept = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array([_pack(blocks[k]) for k in kept], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = _unpack(counts.as_py())
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_pack(v) for v in sums.values()], pa.binary())], ["block", "counts"])

    schema = "block int, counts binary"
    parts = min(max(1, size // BLOCK), 64)
    summed = df.mapInArrow(count, schema).repartition(parts, "block").mapInArrow(add, schema)
    total = np.zeros((max(1, size // BLOCK), min(BLOCK, size)), np.int64)
    for row in summed.collect():  # at most size / BLOCK rows
        total[row.block] = _unpack(row.counts)
    return total.reshape(rows, 1 << bits)


def _pack(counts: np.ndarray) -> bytes:
    """A width byte and the counts in the narrowest unsigned type that holds them."""
    top = int(counts.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The least of the counts that the rows of ``table`` hold for each key."""
    bits = table.shape[1].bit_length() - 1
    return np.minimum.reduce([table[r][cells_of(keys, bits, r)] for r in range(table.shape[0])])
