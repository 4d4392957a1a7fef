"""Laying ordered blocks into size-bounded volumes by next-fit, in parallel.

Next-fit is a fold over the whole order. It is made parallel by what a range of the order does to an open volume: where the
range breaks first depends only on how full the volume is that enters it, and from a break on, the range runs its own course.
Each task therefore tabulates, for every possible first break, how many volumes follow and how full the last one leaves it;
the ranges' tables are then chained in one narrow pass, and each task lays its blocks knowing how it is entered.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize


def _course(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For a volume that begins at each block: the volumes begun from there to the end of the range, and the last one's fill."""
    n = len(sizes)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    # The first block that no longer fits into a volume beginning at i; an oversized block lies alone.
    after = np.maximum(np.searchsorted(ends, ends[:n] + capacity, "right") - 1, np.arange(n) + 1)
    after = np.where((after < n) & (ends[after] == ends[:n]), after + 1, after)  # nothing but empty blocks so far: it takes an oversized one
    begun, fill = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        j = after[i]
        begun[i] = 1 + (begun[j] if j < n else 0)
        fill[i] = ends[n] - ends[i] if j >= n else fill[j]
    return begun, fill


def next_fit(blocks: DataFrame, order: list[Column], key: str, size: str, capacity: int, header_bytes: int = 0, ranges: int | None = None) -> DataFrame:
    """``key, size, volume`` (from 1): volumes of at most ``capacity`` bytes in the given order, volume 1 entered by the header.

    A block over the capacity lies alone in its volume (split it first, see ``oversize_parts``). Null sizes count as 0. The
    order must be total for the result to be the same each time.
    """
    if capacity <= 0:
        raise ValueError("the volume limit leaves no room for content")
    spark = blocks.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = blocks.schema[key].dataType.simpleString()
    sized = blocks.select(*(c.alias(f"_o{i}") for i, c in enumerate(order)), key, F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("size"))
    names = [f"_o{i}" for i in range(len(order))]
    ordered = materialize(sized.repartitionByRange(ranges, *names).sortWithinPartitions(*names).withColumn("_part", F.spark_partition_id()), "ordered")
    narrow = ordered.select("_part", *names, "size").repartition(ranges, "_part").sortWithinPartitions("_part", *names).select("_part", "size")

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            parts, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(parts):
                held.setdefault(int(p), []).append(sizes[parts == p])
        for p, chunks in held.items():
            sizes = np.concatenate(chunks)
            begun, fill = _course(sizes, capacity)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            # A break at block j is possible only if the blocks before it fit into a volume at all.
            last = min(int(np.searchsorted(ends, capacity, "right")), len(sizes))
            j = np.arange(last)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(last + 1, p), pa.int32()), pa.array(np.append(ends[1 : last + 1], -1), pa.int64()), pa.array(np.append(begun[j], 0), pa.int64()), pa.array(np.append(fill[j], ends[-1]), pa.int64())],
                ["part", "through", "begun", "fill"],
            )

    table = narrow.mapInArrow(tabulate, "part int, through bigint, begun bigint, fill bigint")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for batch in batches:
            for p, t, b, f in zip(*(c.to_pylist() for c in batch.columns)):
                rows.setdefault(p, []).append((t, b, f))
        entered, volume, carried = [], 1, header_bytes
        for p in sorted(rows):
            entered.append((p, volume, carried))
            whole = next(f for t, _, f in rows[p] if t == -1)
            breaks = sorted((x for x in rows[p] if x[0] >= 0), key=lambda x: x[0])  # stable: empty blocks keep their order
            at = bisect_right(breaks, capacity - carried, key=lambda x: x[0])
            if at == len(breaks):  # all of the range fits into the open volume
                carried += whole
            else:
                _, begun, fill = breaks[at]
                empty = carried == 0 and (at == 0 or breaks[at - 1][0] == 0)  # an untouched volume takes even an oversized block
                volume, carried = volume + begun - empty, fill  # ``begun`` counts the volume that the break begins
        cols = list(zip(*entered)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["part", "volume", "carried"])

    # One task chains the ranges' tables, of at most a volume's blocks a range; they are written first, so that it tabulates nothing.
    entries = materialize(table, "breaks").repartition(1).mapInArrow(chain, "part bigint, volume bigint, carried bigint")
    entry = {r.part: (r.volume, r.carried) for r in entries.collect()}  # one row a range
    sent = spark.sparkContext.broadcast(entry)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[int, int]] = {}
        for batch in batches:
            parts, sizes = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            out = np.empty(len(sizes), np.int64)
            starts = np.flatnonzero(np.diff(parts, prepend=parts[:1] - 1))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(parts)]):
                volume, fill = state.get(int(parts[a]), sent.value[int(parts[a])])
                ends = np.concatenate([[0], np.cumsum(sizes[a:b])])
                at = 0
                while at < b - a:  # a step a volume
                    upto = int(np.searchsorted(ends, ends[at] + capacity - fill, "right")) - 1
                    if upto <= at and fill == 0:  # an oversized block, alone but for empty ones before it
                        upto = at + 1
                    elif fill == 0 and upto < b - a and ends[upto] == ends[at]:
                        upto += 1
                    if upto > at:
                        out[a + at : a + upto] = volume
                        fill += int(ends[upto] - ends[at])
                        at = upto
                    if at < b - a:
                        volume, fill = volume + 1, 0
                state[int(parts[a])] = volume, fill
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.int64())], [key, "size", "volume"])

    rows = ordered.select("_part", *names, key, "size").repartition(ranges, "_part").sortWithinPartitions("_part", *names)
    return rows.select("_part", key, "size").mapInArrow(lay, f"`{key}` {kind}, size bigint, volume bigint")


def volume_stats(plan: DataFrame) -> DataFrame:
    """``volume, blocks, bytes`` of each volume."""
    return plan.groupBy("volume").agg(F.count("*").alias("blocks"), F.sum("size").alias("bytes"))


def volume_links(stats: DataFrame) -> DataFrame:
    """Volumes with the one before and after, null at the ends."""
    known = stats.select("volume")
    back = known.select((F.col("volume") + 1).alias("volume"), F.col("volume").alias("previous"))
    ahead = known.select((F.col("volume") - 1).alias("volume"), F.col("volume").alias("next"))
    return stats.join(back, "volume", "left").join(ahead, "volume", "left")


def cut_points(raw: bytes, first: int, later: int) -> list[int]:
    """Ends of consecutive parts: after the last line break within the limit, else between characters. A first limit under
    1024 bytes is not worth a part, and the later one holds."""
    out, at = [], 0
    limit = first if first >= 1024 else later
    while at < len(raw):
        end = min(at + limit, len(raw))
        if end < len(raw):
            line = raw.rfind(b"\n", at, end)
            if line > at:
                end = line + 1
            else:
                while end > at + 1 and raw[end] & 0xC0 == 0x80:
                    end -= 1
        out.append(end)
        at, limit = end, later
    return out


def oversize_parts(blocks: DataFrame, key: str, text: str, capacity: int) -> DataFrame:
    """``key, part, parts, byte_start, byte_end, block``: every block as parts that fit a volume, with the text of each; one part if
    it fits whole.

    Only oversized blocks cross into Python. A part leaves 512 bytes for the marks of its continuation.
    """
    kind = blocks.schema[key].dataType.simpleString()
    n = F.octet_length(text).cast("bigint")
    whole = blocks.where(n <= capacity).select(key, F.lit(1).alias("part"), F.lit(1).alias("parts"), F.lit(0).cast("bigint").alias("byte_start"), n.alias("byte_end"), F.col(text).alias("block"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = t.encode()
                ends = cut_points(raw, capacity - 512, capacity - 512)
                m = len(ends)
                said = [raw[a:b].decode() for a, b in zip([0, *ends], ends)]
                cols = [pa.array([k.as_py()] * m, batch.schema.field(0).type), pa.array(range(1, m + 1), pa.int32()), pa.array([m] * m, pa.int32()), pa.array([0, *ends[:-1]], pa.int64()), pa.array(ends, pa.int64()), pa.array(said, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [key, "part", "parts", "byte_start", "byte_end", "block"])

    return whole.unionByName(blocks.where(n > capacity).select(key, text).mapInArrow(cut, f"`{key}` {kind}, part int, parts int, byte_start bigint, byte_end bigint, block string"))


def _volume_name(name: str, volume: int, total: int) -> str:
    return f"{name}_part_{volume:03d}_of_{total:03d}.md"


def write_volumes(plan: DataFrame, blocks: DataFrame, key: str, text: str, order: list[str], out_dir: str, name: str = "merged") -> DataFrame:
    """Write ``<name>_part_iii_of_nnn.md`` files of a plan into a shared folder; returns ``volume, path, bytes``.

    Volumes are written by their tasks, one after the other, never as a whole in memory. A repeated task writes the same
    files again, aside and renamed.
    """
    total = int(plan.agg(F.coalesce(F.max("volume"), F.lit(0))).first()[0])
    rows = plan.select(key, "volume").join(blocks.select(key, text, *[c for c in order if c != key]), key)
    placed = rows.repartition("volume").sortWithinPartitions("volume", *order).select("volume", text)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusloom.sources.files import Aside

        now, f, made = None, None, []

        def close() -> None:
            if f is not None:
                f.write(f"\n---\n\n# End of Volume {now} / {total}\n{'# END OF BUNDLE' if now == total else f'- 下一卷: {_volume_name(name, now + 1, total)}'}\n".encode())
                f.close()
                made.append((now, f.path, f.bytes))

        for batch in batches:
            for volume, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if volume != now:
                    close()
                    now = volume
                    f = Aside(out_dir, _volume_name(name, volume, total))
                    before = _volume_name(name, volume - 1, total) if volume > 1 else "无(本卷为首卷)"
                    f.write(f"# Volume {volume} of {total}\n\n- 上一卷: {before}\n\n---\n\n".encode())
                f.write((block or "").encode())
        close()
        cols = list(zip(*made)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64()))], ["volume", "path", "bytes"])

    return placed.mapInArrow(write, "volume bigint, path string, bytes bigint")
