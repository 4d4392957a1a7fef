"""Filling containers of fixed capacity, every stretch of them in the target proportions of the sources.

Items wait in one queue per source. Deficit round-robin serves every queue its quantum (target share x window) a round, and
what a queue could not use for want of a fitting item is carried on: an item is served in the round in which the queue's
credit first covers all it has served and the item. As credit is a running sum, rounds are found without any sequential
task. Each window is then packed by best fit, the largest first; what remains in containers that aren't full is carried into
the next window of the partition, and from the partitions into a last packing.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.prefix import running_sums
from corpusloom.session import materialize

#: Containers in a window, windows that share a task, and the fill from which a container is closed.
WINDOW, TOGETHER, FULL = 64, 32, 0.995
#: Tasks whose leftovers are packed again by one.
GATHER = 64


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(free space, items) of containers for ``(id, size)`` items of at most ``capacity``: best fit, the largest item first."""
    free: list[tuple[int, int]] = []  # (free space, container), sorted
    held: list[list[tuple[int, int]]] = []
    for item in sorted(items, key=lambda x: (-x[1], x[0])):
        at = bisect_left(free, (item[1], -1))
        if at < len(free):
            space, k = free.pop(at)
        else:
            space, k = capacity, len(held)
            held.append([])
        held[k].append(item)
        insort(free, (space - item[1], k))
    return [(space, held[k]) for space, k in sorted(free, key=lambda x: x[1])]


def _packer(capacity: int, prefix: str, last: bool):
    """Packs windows as they come; containers that aren't full are carried on, in the last packing they are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        made, window, waiting, carried = 0, None, [], []

        def close(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made, waiting, carried
            rows: list[tuple[str | None, int, int]] = []
            boxes = best_fit(carried + waiting, capacity)
            carried, waiting = [], []
            for free, items in boxes:
                if last or free <= (1 - FULL) * capacity:
                    rows += [(f"{prefix}{part}.{made}", i, n) for i, n in items]
                    made += 1
                else:
                    carried += items
            # What is carried into the next window is less than a window, else the fullest containers are closed.
            if not final and sum(n for _, n in carried) > WINDOW * capacity // 4:
                for free, items in sorted(best_fit(carried, capacity), key=lambda x: x[0])[: WINDOW // 8]:
                    gone = {i for i, _ in items}
                    carried = [c for c in carried if c[0] not in gone]
                    rows += [(f"{prefix}{part}.{made}", i, n) for i, n in items]
                    made += 1
            if final:
                rows += [(None, i, n) for i, n in carried]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["container", "item", "bytes"])

        for batch in batches:
            for w, i, n in zip(*(c.to_pylist() for c in batch.columns)):
                if w != window and waiting:
                    yield from close(False)
                window = w
                waiting.append((i, n))
        yield from close(True)

    return run


def pack(df: DataFrame, item: str, size: str, source: str, capacity: int, targets: dict[str, float] | None = None) -> DataFrame:
    """``container, window, queue, item, part, byte_start, byte_end`` of every row of ``df`` (``item`` is a unique bigint).

    An item over ``capacity`` fills containers of its own and leaves its rest to be packed; no other is divided. Null or
    negative sizes count as 0; an empty item lies in one container as a part of no bytes. A null source is a queue of its own.
    ``window`` is the one that served the item; it may lie in a container that was closed later (``window_shares`` reports both).
    ``targets`` are the sources' shares of a window; by default each source's share of all bytes, so that every window
    mirrors the whole. Sources without a target are served as if by their own share.
    """
    spark = df.sparkSession
    if capacity <= 0:
        raise ValueError("a container must hold something")
    rows = df.select(
        F.col(item).cast("bigint").alias("item"),
        F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size"),
        F.coalesce(F.col(source).cast("string"), F.lit("?")).alias("queue"),
    )
    rows = rows.withColumn("whole", F.when(F.col("size") > capacity, F.floor(F.col("size") / capacity)).otherwise(0).cast("bigint"))
    rows = rows.withColumn("rest", F.col("size") - F.col("whole") * capacity)
    rows = materialize(rows, "items")
    alone = rows.where("whole > 0").select("item", "queue", F.explode(F.sequence(F.lit(1), F.col("whole"))).alias("part"))
    alone = alone.select(
        F.concat(F.lit("w"), F.col("item"), F.lit("."), F.col("part")).alias("container"),
        F.lit(None).cast("bigint").alias("window"),
        "queue",
        "item",
        F.col("part").cast("int").alias("part"),
        ((F.col("part") - 1) * capacity).alias("byte_start"),
        (F.col("part") * capacity).alias("byte_end"),
    )
    loose = rows.where("rest > 0 OR whole = 0")
    shares = loose.groupBy("queue").agg(F.sum("rest").alias("own"))
    total = shares.agg(F.sum("own")).first()[0] or 1
    share = F.col("own") / F.lit(float(total))
    if targets:
        given = spark.createDataFrame([(k, float(v)) for k, v in targets.items()], "queue string, target double")
        shares = shares.join(given, "queue", "left")
        share = F.coalesce("target", share)
    quantum = shares.select("queue", F.greatest(share * float(WINDOW * capacity), F.lit(1.0)).alias("quantum"))
    placed = running_sums(loose.select("item", "queue", "rest"), "queue", "rest", "item")
    served = placed.join(quantum, "queue").withColumn("window", F.greatest(F.ceil((F.col("start") + F.col("rest")) / F.col("quantum")) - 1, F.lit(0)).cast("bigint"))
    served = materialize(served.select("item", "queue", "window", "rest"), "served")
    schema = "container string, item bigint, bytes bigint"
    ready = served.select("window", "item", "rest").repartition(F.floor(F.col("window") / TOGETHER)).sortWithinPartitions("window", "item")
    first = materialize(ready.mapInArrow(_packer(capacity, "m", False), schema), "packed")
    # What the partitions carried over, of each less than a window, is packed again by ever fewer tasks.
    packed, over = first.where("container IS NOT NULL"), first.where("container IS NULL")
    tasks, level = int(spark.conf.get("spark.sql.shuffle.partitions")), 1
    while tasks > GATHER:
        tasks //= GATHER
        again = over.select(F.lit(0).cast("bigint").alias("window"), "item", "bytes").repartition(tasks, "item").sortWithinPartitions("item")
        again = materialize(again.mapInArrow(_packer(capacity, f"c{level}-", False), schema), "packed")
        packed, over, level = packed.unionByName(again.where("container IS NOT NULL")), again.where("container IS NULL"), level + 1
    rest = over.select(F.lit(0).cast("bigint").alias("window"), "item", "bytes").repartition(1).sortWithinPartitions("item")  # less than a window a task
    packed = packed.unionByName(rest.mapInArrow(_packer(capacity, "r", True), schema))
    ends = packed.join(served.select("item", "queue", "window"), "item").join(rows.where("whole > 0").select("item", "whole"), "item", "left")
    ends = ends.withColumn("whole", F.coalesce("whole", F.lit(0)))
    mixed = ends.select(
        "container",
        "window",
        "queue",
        "item",
        (F.col("whole") + 1).cast("int").alias("part"),
        (F.col("whole") * capacity).alias("byte_start"),
        (F.col("whole") * capacity + F.col("bytes")).alias("byte_end"),
    )
    return mixed.unionByName(alone)


def window_shares(packed: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``window, queue, bytes, share, target``: what each queue has of the bytes served in each window, against its target (its
    share of all bytes, where ``targets`` gives none). A window lacks what its queues had no fitting item for; the next one makes
    up for it. Containers that a single item fills belong to no window."""
    spark = packed.sparkSession
    each = packed.where("window IS NOT NULL").groupBy("window", "queue").agg(F.sum(F.col("byte_end") - F.col("byte_start")).alias("bytes"))
    each = materialize(each, "windows")
    whole = each.groupBy("window").agg(F.sum("bytes").alias("all"))
    own = each.groupBy("queue").agg(F.sum("bytes").alias("own"))
    total = own.agg(F.sum("own")).first()[0] or 1
    target = F.col("own") / F.lit(float(total))
    if targets:
        given = spark.createDataFrame([(k, float(v)) for k, v in targets.items()], "queue string, given double")
        own, target = own.join(given, "queue", "left"), F.coalesce("given", target)
    share = F.when(F.col("all") > 0, F.col("bytes") / F.col("all")).otherwise(0.0)
    joined = each.join(whole, "window").join(own.select("queue", target.alias("target")), "queue")
    return joined.select("window", "queue", "bytes", F.round(share, 6).alias("share"), F.round("target", 6).alias("target"))


def piece_sizes(pieces: DataFrame) -> DataFrame:
    """``item, size, queue``: the true bytes of each piece (its slice of the spool file, else its inline text) and its queue, by
    the file's extension; inline pieces are a queue of their own. A slice that ends before it begins counts as empty."""
    slice_ = F.when(F.col("byte_end").isNotNull() & F.col("byte_start").isNotNull(), F.greatest(F.col("byte_end") - F.col("byte_start"), F.lit(0)))
    inline = F.octet_length("inline_text").cast("bigint")
    size = F.when(F.col("inline_text").isNotNull() & slice_.isNull(), inline).otherwise(F.coalesce(slice_, inline, F.lit(0)))
    ext = F.lower(F.regexp_extract("rel_path", r"\.([A-Za-z0-9]{1,8})$", 1))
    return pieces.select(F.col("piece_id").alias("item"), size.alias("size"), F.when(F.col("rel_path").isNull(), "inline").otherwise(ext).alias("queue"))
