"""Joins of rows with what was counted per key, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one row in so many is hot; there can't be more hot keys than this.
SHARE = 1024


def join_counts(rows: DataFrame, counts: DataFrame, key: str, n: str, wanted: Column | None = None) -> DataFrame:
    """``rows`` joined (inner) with ``counts``, one row per ``key`` with the number ``n`` of rows that have it.

    Hot keys, at most ``SHARE``, are broadcast and their rows stay where they are; the rest is joined by shuffle, where no key
    has more than one row in ``SHARE``. ``wanted`` restricts ``counts`` after the sum over all keys was taken. Both inputs are
    read several times, so they should be written tables. Null keys join nothing.
    """
    total, most = counts.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    if wanted is not None:
        counts = counts.where(wanted)
    if most * SHARE <= total:
        return rows.join(counts, key)
    hot = F.col(n) * SHARE > total
    few = F.broadcast(counts.where(hot))  # at most SHARE rows, as their n sum up to total at most
    cold = rows.join(F.broadcast(counts.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(cold.join(counts.where(~hot), key))
