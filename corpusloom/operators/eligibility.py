"""Eligibility of catalogued files: extension, kind, size and time rules, with every reason a file fails. All are columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MB = 1 << 20


@dataclass(frozen=True)
class ExtensionRule:
    """Which extensions and kinds may pass. What is excluded never passes; where something is included, only that does."""

    include_exts: frozenset[str] = frozenset()
    exclude_exts: frozenset[str] = frozenset()
    include_kinds: frozenset[str] = frozenset()
    exclude_kinds: frozenset[str] = frozenset()
    reject_unsupported: bool = False

    def failure(self, ext: Column, kind: Column) -> Column:
        """The first rule that a file fails, or null."""

        def among(c: Column, values: frozenset[str]) -> Column:
            return F.coalesce(c.isin(*sorted(values)), F.lit(False)) if values else F.lit(False)

        out = F.when(among(ext, self.exclude_exts), F.concat(F.lit("exclude_ext="), ext)).when(among(kind, self.exclude_kinds), F.concat(F.lit("exclude_kind="), kind))
        if self.include_exts:
            out = out.when(~among(ext, self.include_exts), F.concat(F.lit("not_in_include_ext="), F.coalesce(ext, F.lit(""))))
        if self.include_kinds:
            out = out.when(~among(kind, self.include_kinds), F.concat(F.lit("not_in_include_kind="), F.coalesce(kind, F.lit(""))))
        if self.reject_unsupported:
            out = out.when(kind == "unsupported", "unsupported")
        return out


@dataclass(frozen=True)
class SizeRule:
    """A closed interval in MB; no least size at 0 or below, no greatest below 0. A greatest of 0 lets only empty files pass."""

    min_mb: float = -1
    max_mb: float = -1

    @property
    def least(self) -> int | None:
        return int(self.min_mb * _MB) if self.min_mb > 0 else None

    @property
    def greatest(self) -> int | None:
        return int(self.max_mb * _MB) if self.max_mb >= 0 else None


@dataclass(frozen=True)
class Rules:
    """Rules by extension, else by kind, else a default; a found rule replaces the others whole."""

    by_ext: Mapping[str, object] = field(default_factory=dict)
    by_kind: Mapping[str, object] = field(default_factory=dict)
    default: object = None

    def value(self, ext: Column, kind: Column, of) -> Column:
        """``of(rule)`` of the rule that holds for a file, as literals inside the plan (-1 stands for None)."""

        def lit(rule) -> Column:
            v = of(rule)
            return F.lit(-1 if v is None else v).cast("double")

        out = None
        for column, rules in ((ext, self.by_ext), (kind, self.by_kind)):
            for key in sorted(rules):
                out = (F if out is None else out).when(column == key, lit(rules[key]))
        return lit(self.default) if out is None else out.otherwise(lit(self.default))


def size_failure(size: Column, ext: Column, kind: Column, rules: Rules) -> Column:
    least = rules.value(ext, kind, lambda r: r.least)
    greatest = rules.value(ext, kind, lambda r: r.greatest)
    return F.when((least >= 0) & (size < least), F.format_string("size<%d", least.cast("bigint"))).when((greatest >= 0) & (size > greatest), F.format_string("size>%d", greatest.cast("bigint")))


def time_failure(at: Column, after: datetime | None, before: datetime | None) -> Column:
    """Outside a closed interval; an unknown time passes. A bound without a time of day is its midnight."""
    out = F.when(F.lit(False), F.lit(""))
    if after is not None:
        out = out.when(at < F.lit(after).cast("timestamp_ntz"), "before_start")
    if before is not None:
        out = out.when(at > F.lit(before).cast("timestamp_ntz"), "after_end")
    return out


FILTERS = ("ext_filter", "size_filter", "mtime_filter", "ctime_filter")


def with_eligibility(catalog: DataFrame, failures: Mapping[str, Column]) -> DataFrame:
    """``eligibility_reasons`` (each as ``filter: reason``, in the order given) and ``eligible`` (none). No row is dropped."""
    said = [F.concat(F.lit(f"{name}: "), why) for name, why in failures.items()]
    reasons = F.array_compact(F.array(*said)) if said else F.array().cast("array<string>")
    return catalog.withColumn("eligibility_reasons", reasons).withColumn("eligible", F.size("eligibility_reasons") == 0)


def in_bucket(reasons: Column, name: str) -> Column:
    """Whether a filter rejected the file; a file with two reasons is in two buckets."""
    return F.exists(reasons, lambda r: F.startswith(r, F.lit(name)))


def reject_breakdown(catalog: DataFrame) -> DataFrame:
    """``filter, files``: how many files each filter rejected."""
    return catalog.select(F.explode("eligibility_reasons").alias("r")).groupBy(F.split("r", ":")[0].alias("filter")).agg(F.count("*").alias("files"))


def parse_date(text: str) -> datetime:
    """A date or time in one of four notations."""
    for pattern in ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y/%m/%d"):
        try:
            return datetime.strptime(text.strip(), pattern)
        except ValueError:
            continue
    raise ValueError(f"not a date: {text!r}")
