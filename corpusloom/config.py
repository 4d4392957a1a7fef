"""Settings of a bundle run, read from flags, the environment, an env file and defaults, in this order."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, replace
from datetime import datetime

from corpusloom.functions.files import IMAGE_EXTENSIONS
from corpusloom.operators.eligibility import ExtensionRule, Rules, SizeRule, parse_date
from corpusloom.operators.truncation import TruncationRule


def truth(text: str) -> bool:
    return text.strip().lower() in ("1", "true", "yes", "y", "on")


def names(text: str) -> frozenset[str]:
    return frozenset(x.strip() for x in text.split(",") if x.strip())


def extensions(text: str) -> frozenset[str]:
    """Lower-cased extensions with their dot."""
    return frozenset("." + x.lower().lstrip(".") for x in names(text))


def _date(text: str) -> datetime | None:
    return parse_date(text) if text.strip() else None


def _setting(key: str, read: Callable, default):
    return field(default=default, metadata={"key": key, "read": read})


@dataclass(frozen=True)
class Settings:
    input_dir: str = _setting("INPUT_DIR", str, "")
    output_dir: str = _setting("OUTPUT_DIR", str, "")
    output_timestamp: bool = _setting("OUTPUT_TIMESTAMP_SUFFIX", truth, True)
    max_size_mb: int = _setting("MAX_SIZE_MB", int, 19)
    log_level: str = _setting("LOG_LEVEL", str, "INFO")
    csv_max_rows: int = _setting("CSV_MAX_ROWS", int, 200)
    scanned_chars_per_page: int = _setting("SCANNED_PDF_CHAR_PER_PAGE", int, 50)
    ocr_enabled: bool = _setting("OCR_ENABLED", truth, False)
    ocr_engine: str = _setting("OCR_ENGINE", str, "accurate_basic")
    ocr_max_retries: int = _setting("OCR_MAX_RETRIES", int, 3)
    ocr_min_interval: float = _setting("OCR_MIN_INTERVAL", float, 0.5)
    ocr_image_exts: frozenset[str] = _setting("OCR_IMAGE_EXTS", extensions, frozenset(IMAGE_EXTENSIONS))
    ocr_max_image_bytes: int = _setting("OCR_MAX_IMAGE_BYTES", int, 4 << 20)
    mtime_filter: bool = _setting("MTIME_FILTER_ENABLED", truth, False)
    mtime_after: datetime | None = _setting("MTIME_FILTER_AFTER", _date, None)
    mtime_before: datetime | None = _setting("MTIME_FILTER_BEFORE", _date, None)
    ctime_filter: bool = _setting("CTIME_FILTER_ENABLED", truth, False)
    ctime_after: datetime | None = _setting("CTIME_FILTER_AFTER", _date, None)
    ctime_before: datetime | None = _setting("CTIME_FILTER_BEFORE", _date, None)
    include_exts: frozenset[str] = _setting("ELIGIBILITY_INCLUDE_EXTS", extensions, frozenset())
    exclude_exts: frozenset[str] = _setting("ELIGIBILITY_EXCLUDE_EXTS", extensions, frozenset())
    include_kinds: frozenset[str] = _setting("ELIGIBILITY_INCLUDE_KINDS", names, frozenset())
    exclude_kinds: frozenset[str] = _setting("ELIGIBILITY_EXCLUDE_KINDS", names, frozenset())
    unsupported_policy: str = _setting("ELIGIBILITY_UNSUPPORTED_POLICY", str, "allow")
    inventory_in_bundle: bool = _setting("FULL_INVENTORY_IN_MERGED", truth, True)
    inventory_in_report: bool = _setting("FULL_INVENTORY_IN_REPORT", truth, True)
    purge_dirs: frozenset[str] = _setting("PURGE_DIR_NAMES_EXTRA", names, frozenset())
    purge_names: frozenset[str] = _setting("PURGE_FILENAMES_EXTRA", names, frozenset())
    purge_suffixes: frozenset[str] = _setting("PURGE_SUFFIXES_EXTRA", extensions, frozenset())
    log_max_bytes: int = _setting("LOG_FILE_MAX_BYTES", int, 10 << 20)
    log_head_ratio: float = _setting("LOG_TRUNCATE_HEAD_RATIO", float, 0.5)
    keep_intermediate: bool = _setting("KEEP_INTERMEDIATE_FILES", truth, False)
    intermediate_subdir: str = _setting("INTERMEDIATE_SUBDIR", str, "intermediate")
    metadata: bool = _setting("FILE_METADATA_ENABLED", truth, False)
    hash_algo: str = _setting("FILE_HASH_ALGO", str, "sha256")
    metadata_position: str = _setting("FILE_METADATA_POSITION", str, "body")
    show_hash: bool = _setting("FILE_METADATA_SHOW_HASH", truth, True)
    hash_max_bytes: int = _setting("FILE_HASH_MAX_BYTES", int, 0)
    hash_short_len: int = _setting("FILE_HASH_SHORT_LEN", int, 16)
    duplicates: bool = _setting("DUPLICATE_DETECTION_ENABLED", truth, False)
    truncation: bool = _setting("TRUNC_ENABLED", truth, True)
    truncation_seed: int = _setting("TRUNC_SEED", int, 0)
    size_filter: bool = _setting("SIZE_FILTER_ENABLED", truth, True)
    truncation_rules: Rules = field(default_factory=lambda: Rules(default=TruncationRule()))
    size_rules: Rules = field(default_factory=lambda: Rules(default=SizeRule()))

    @property
    def extension_rule(self) -> ExtensionRule:
        return ExtensionRule(self.include_exts, self.exclude_exts, self.include_kinds, self.exclude_kinds, self.unsupported_policy == "reject")

    @property
    def needs_hash(self) -> bool:
        return self.duplicates or (self.metadata and self.metadata_position != "none" and self.show_hash)

    def check(self) -> Settings:
        """The settings themselves, or a ValueError that names every rule they break."""
        wrong = [
            text
            for bad, text in (
                (self.max_size_mb <= 0, "MAX_SIZE_MB must be above 0"),
                (self.log_max_bytes <= 0, "LOG_FILE_MAX_BYTES must be above 0"),
                (not 0 < self.log_head_ratio < 1, "LOG_TRUNCATE_HEAD_RATIO must lie between 0 and 1"),
                (self.metadata_position not in ("toc", "body", "both", "none"), "FILE_METADATA_POSITION must be toc, body, both or none"),
                (self.hash_algo not in ("sha256", "sha1", "md5"), "FILE_HASH_ALGO must be sha256, sha1 or md5"),
                (self.hash_max_bytes < 0, "FILE_HASH_MAX_BYTES must not be negative"),
                (not 4 <= self.hash_short_len <= 64, "FILE_HASH_SHORT_LEN must lie between 4 and 64"),
                (bool(self.mtime_after and self.mtime_before and self.mtime_after > self.mtime_before), "MTIME_FILTER_AFTER lies behind MTIME_FILTER_BEFORE"),
                (bool(self.ctime_after and self.ctime_before and self.ctime_after > self.ctime_before), "CTIME_FILTER_AFTER lies behind CTIME_FILTER_BEFORE"),
            )
            if bad
        ]
        if wrong:
            raise ValueError("; ".join(wrong))
        return self


def env_file(path: str) -> dict[str, str]:
    """``KEY=value`` lines; comments, blanks and quotes as usual."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in map(str.strip, f):
            if line and not line.startswith("#") and "=" in line:
                key, value = line.removeprefix("export ").split("=", 1)
                out[key.strip()] = value.strip().strip("'\"")
    return out


def _rules(env: Mapping[str, str], prefix: str, parts: Mapping[str, str], cls, base) -> Rules:
    """Rules by extension, kind and default from ``<prefix>_(EXT|KIND)_<name>_<part>``; what a key leaves out is inherited
    from the default rule, an extension's from its kind's."""

    def read(start, keys: str):
        values = {}
        for part, attribute in parts.items():
            text = env.get(f"{keys}_{part}", "").strip()
            if text:
                old = getattr(start, attribute)
                values[attribute] = truth(text) if isinstance(old, bool) else type(old)(float(text))
        return replace(start, **values)

    default = read(base, f"{prefix}_DEFAULT")
    endings = "|".join(sorted(parts, key=len, reverse=True))
    found = {m.groups() for k in env if (m := re.fullmatch(rf"{prefix}_(EXT|KIND)_(.+)_(?:{endings})", k))}
    kinds = {n.lower(): read(default, f"{prefix}_KIND_{n}") for what, n in found if what == "KIND"}
    from corpusloom.functions.files import EXTENSION_KINDS

    exts = {"." + n.lower(): read(kinds.get(EXTENSION_KINDS.get("." + n.lower(), ""), default), f"{prefix}_EXT_{n}") for what, n in found if what == "EXT"}
    return Rules(exts, kinds, default)


def load(flags: Mapping[str, object] | None = None, env: Mapping[str, str] | None = None, file: str | None = None) -> Settings:
    """Settings from flags (by field name), the environment, an env file and the defaults. A value that can't be read is an error."""
    merged = (env_file(file) if file else {}) | dict(os.environ if env is None else env)
    values = {}
    for f in fields(Settings):
        key = f.metadata.get("key")
        if key and (text := merged.get(key, "").strip()):
            values[f.name] = f.metadata["read"](text)
    values["truncation_rules"] = _rules(merged, "TRUNC", {"ENABLED": "enabled", "HEAD_MB": "head_mb", "TAIL_MB": "tail_mb", "CHUNK_MB": "chunk_mb", "MIDDLE_CHUNKS": "middle_chunks"}, TruncationRule, TruncationRule(False, 2.0, 2.0, 1.0, 2))
    values["size_rules"] = _rules(merged, "SIZE_FILTER", {"MIN_MB": "min_mb", "MAX_MB": "max_mb"}, SizeRule, SizeRule(-1.0, -1.0))
    values |= {k: v for k, v in (flags or {}).items() if v is not None}
    s = Settings(**values)
    if s.duplicates and not s.metadata:
        s = replace(s, metadata=True, metadata_position="none" if (flags or {}).get("metadata") is False else s.metadata_position)
    return s.check()
