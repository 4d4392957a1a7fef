"""A whole run: a tree of files to size-bounded Markdown volumes, with a report and a journal that a later run resumes from."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import Settings
from corpusloom.functions import files as X
from corpusloom.operators import duplicates, render, truncation, volumes
from corpusloom.operators import eligibility as E
from corpusloom.operators.ordering import numbered
from corpusloom.session import materialize
from corpusloom.sources.converters import Converter, Options, convert_files
from corpusloom.sources.files import write_files
from corpusloom.sources.filetree import purge_counts, scan, with_content
from corpusloom.sources.ocr import OcrClient, Patience, image_converter

#: Bytes of a volume that are kept for its head and tail.
RESERVE = 1024


def catalog(spark: SparkSession, s: Settings) -> DataFrame:
    """The full inventory with its verdicts; rejected files stay, as rows."""
    found = scan(spark, s.input_dir, tuple(sorted(s.ocr_image_exts)), tuple(s.purge_dirs), tuple(s.purge_names), tuple(s.purge_suffixes))
    ext, kind = F.col("ext"), F.col("kind")
    rules = {"ext_filter": s.extension_rule.failure(ext, kind)}
    if s.size_filter:
        rules["size_filter"] = E.size_failure(F.col("size_bytes"), ext, kind, s.size_rules)
    if s.mtime_filter:
        rules["mtime_filter"] = E.time_failure(F.col("mtime"), s.mtime_after, s.mtime_before)
    if s.ctime_filter:
        rules["ctime_filter"] = E.time_failure(F.col("ctime"), s.ctime_after, s.ctime_before)
    return E.with_eligibility(found, rules)


def purged(spark: SparkSession, s: Settings) -> DataFrame:
    """``reason, files``: how many files of the tree are never catalogued, by reason."""
    return purge_counts(spark, s.input_dir, tuple(s.purge_dirs), tuple(s.purge_names), tuple(s.purge_suffixes))


#: The kinds whose bytes may be cut before they are converted; of all others only the Markdown is, afterwards.
TEXT_KINDS = ("txt", "markdown", "html", "json", "csv", "param", "log", "rlog", *X.FENCE_LANGUAGES)


def _truncation(s: Settings) -> tuple[dict[str, truncation.TruncationRule], Column]:
    """The rules by name and the name of each row's rule, by its extension, else its kind."""
    if not s.truncation:
        return {}, F.lit("none")
    every = {"default": s.truncation_rules.default} | {f"kind {k}": r for k, r in s.truncation_rules.by_kind.items()} | {f"ext {e}": r for e, r in s.truncation_rules.by_ext.items()}
    by_ext, by_kind = F.concat(F.lit("ext "), F.col("ext")), F.concat(F.lit("kind "), F.col("kind"))
    rule = F.when(F.col("ext").isin(*s.truncation_rules.by_ext), by_ext).when(F.col("kind").isin(*s.truncation_rules.by_kind), by_kind).otherwise("default")
    return {n: r for n, r in every.items() if r.keeps_something}, rule


def extract(files: DataFrame, s: Settings, plugins: dict[str, Converter] | None = None) -> DataFrame:
    """Converted rows of the eligible files (``file_key`` and the conversion).

    By its rule, a text kind is shortened before it is converted and every success afterwards; both leave a warning. Zipped,
    executable and other binary files are read whole.
    """
    known = files.where("eligible").select("file_key", "path", "rel_path", "ext", "kind")
    content = with_content(known)
    rules, rule = _truncation(s)
    said = None
    if rules:
        text = F.col("kind").isin(*TEXT_KINDS) & F.col("content").isNotNull()
        cut = truncation.truncate_items(content.where(text), "file_key", F.col("content"), F.col("rel_path"), rules, rule, s.truncation_seed, "PRE-READ TRUNCATED")
        cut = materialize(cut.where("truncated"), "cut")
        said = cut.select("file_key", truncation.summary("pre-read", F.size("sample_offsets")).alias("_said"))
        content = content.join(cut.select("file_key", F.col("content").alias("_cut")), "file_key", "left").withColumn("content", F.coalesce("_cut", "content"))
    options = Options(csv_rows=s.csv_max_rows, log_bytes=s.log_max_bytes, log_head_ratio=s.log_head_ratio, scanned_chars_per_page=s.scanned_chars_per_page, image_bytes=s.ocr_max_image_bytes)
    done = convert_files(content, "file_key", "kind", "content", "rel_path", options, plugins, reason="read_error")
    if rules:
        before = F.when(F.col("_said").isNotNull(), F.array("_said")).otherwise(F.array().cast("array<string>"))
        done = done.join(said, "file_key", "left").withColumn("warnings", F.concat(before, F.coalesce("warnings", F.array().cast("array<string>")))).drop("_said")
        named = materialize(done, "converted").join(known.select("file_key", "rel_path", rule.alias("_rule"), "kind"), "file_key")
        named = named.withColumn("_rule", F.when(F.col("kind") == "unsupported", "none").otherwise(F.col("_rule")))
        done = truncation.with_post_truncation(named, "file_key", rules, "_rule", "rel_path", s.truncation_seed).select(*done.columns)
    return done


def ocr_plugins(s: Settings, make_client: Callable[[], OcrClient] | None) -> dict[str, Converter]:
    """The converter of images if OCR is enabled and a service is given; else images are skipped."""
    if not s.ocr_enabled or make_client is None:
        return {}
    return {"image": image_converter(make_client, Patience(s.ocr_max_retries, s.ocr_min_interval))}


def run(spark: SparkSession, s: Settings, plugins: dict[str, Converter] | None = None, completed: DataFrame | None = None, make_client: Callable[[], OcrClient] | None = None) -> dict[str, str]:
    """Write the volumes, the report's tables and the journal below the output directory (shared by all executors).

    ``make_client`` makes the OCR service's client inside a worker. ``completed`` (``file_key`` and a conversion, from an earlier run's journal) is taken over; only other files are converted.
    """
    out = s.output_dir + (datetime.now().strftime("_%Y%m%d_%H%M%S") if s.output_timestamp else "")
    plugins = ocr_plugins(s, make_client) | (plugins or {})
    log = logging.getLogger("corpusloom")
    log.setLevel(s.log_level.upper())
    files = materialize(catalog(spark, s), "catalog")
    log.info("catalogued %s", s.input_dir)
    if s.needs_hash:
        read = with_content(files.where("eligible"))
        hashed = duplicates.with_hash(read, F.col("content"), F.col("size_bytes"), s.hash_algo, s.hash_max_bytes).drop("content", "read_error")
        files = materialize(files.where("NOT eligible").unionByName(hashed, allowMissingColumns=True), "hashed")
    todo = files if completed is None else files.join(completed.select("file_key"), "file_key", "left_anti")
    done = extract(todo, s, plugins)
    if completed is not None:
        done = done.unionByName(completed.join(files.where("eligible").select("file_key"), "file_key", "left_semi"))
    done = materialize(done, "conversions")
    log.info("converted")
    entries = done.join(files, "file_key")
    metadata = None
    if s.metadata and s.metadata_position in ("body", "both") and s.needs_hash:
        metadata = F.concat(F.lit("- "), F.col("content_hash_algo"), F.lit(": `"), F.col("content_hash"), F.lit("`\n"))
    body = render.block_body(F.col("status"), F.col("markdown"), F.col("error"), F.col("skip_reason"))
    block = render.file_block(F.col("rel_path"), F.col("file_id"), F.col("kind"), F.col("size_bytes"), F.col("warnings"), body, metadata)
    capacity = s.max_size_mb * (1 << 20) - RESERVE
    blocks = materialize(entries.select("file_key", "rel_path", block.alias("block")), "blocks")
    parts = volumes.oversize_parts(blocks, "file_key", "block", capacity).join(blocks.select("file_key", "rel_path"), "file_key")
    parts = parts.select(F.concat_ws("#", "file_key", "part").alias("part_key"), F.lit(99).alias("section"), F.lower("rel_path").alias("o1"), "rel_path", "part", "block")
    toc = None
    if s.metadata and s.metadata_position in ("toc", "both"):
        c = F.col
        toc = X.compact_metadata(c("size_bytes"), c("mtime"), c("ctime"), c("ctime_source"), *(c(n) if s.needs_hash else F.lit(None).cast("string") for n in ("content_hash", "content_hash_algo", "content_hash_skipped_reason")), short=s.hash_short_len)
    front = render.front_matter(entries, files, s.input_dir, s.inventory_in_bundle, s.duplicates, toc)
    front = front.select(F.concat_ws("#", F.col("section").cast("string"), "o1").alias("part_key"), "section", "o1", "rel_path", F.lit(0).alias("part"), "block")
    parts = materialize(front.unionByName(parts), "parts")
    sized = parts.withColumn("n", F.octet_length("block"))
    order = ["section", "o1", "rel_path", "part"]
    plan = volumes.next_fit(sized, [F.col(c) for c in order], "part_key", "n", capacity)
    written = volumes.write_volumes(plan, parts, "part_key", "block", order, out)
    written.write.mode("overwrite").parquet(f"{out}/volumes")
    catalog_rows = files.withColumn("ctime_source", F.coalesce("ctime_source", F.lit("unavailable")))
    for name, section in render.report_sections(entries, catalog_rows).items():
        section.write.mode("overwrite").parquet(f"{out}/report/{name}")
    if s.duplicates:
        duplicates.ranked_groups(duplicates.duplicate_groups(files)).write.mode("overwrite").parquet(f"{out}/report/duplicates")
    render.rejected_tree(files).orderBy("rel_path").write.mode("overwrite").parquet(f"{out}/report/rejected_tree")
    files.write.mode("overwrite").parquet(f"{out}/journal/files")
    done.write.mode("overwrite").parquet(f"{out}/journal/entries")
    if s.keep_intermediate:
        folder = f"{out}/{s.intermediate_subdir}"
        name = F.concat(F.col("file_id"), F.lit("__"), X.safe_name(F.col("rel_path")))
        listed = numbered(entries.select("rel_path", "file_id", "status", "kind"), [F.lower("rel_path"), F.col("rel_path")])
        line = render.index_line(F.col("idx"), F.col("rel_path"), F.col("file_id"), F.col("status"), F.col("kind"))
        listed.select("idx", line.alias("line")).orderBy("idx").select("line").write.mode("overwrite").text(f"{folder}_index")
        each = entries.select(name.alias("name"), F.explode(F.array(F.struct(F.lit(".md").alias("suffix"), F.coalesce("markdown", F.lit("")).alias("text")), F.struct(F.lit(".extra.json").alias("suffix"), F.coalesce("extra", F.lit("{}")).alias("text")))).alias("f"))
        write_files(each.select(F.concat("name", "f.suffix").alias("name"), "f.text"), folder).write.mode("overwrite").parquet(f"{folder}_files")
    sections = {"purged": purged(spark, s)} | render.report_sections(entries, catalog_rows)
    report = render.report_document(sections)
    plan = volumes.next_fit(report.withColumn("n", F.octet_length("block")), [F.col("section"), F.col("line")], "key", "n", capacity)
    volumes.write_volumes(plan, report, "key", "block", ["section", "line"], out, "conversion_report").write.mode("overwrite").parquet(f"{out}/report/document")
    log.info("written to %s", out)
    return {"output": out}


def resume(spark: SparkSession, s: Settings, journal: str, plugins: dict[str, Converter] | None = None) -> dict[str, str]:
    """Run again with what an earlier run's journal has finished; files that failed then are tried again."""
    entries = spark.read.parquet(os.path.join(journal, "entries"))
    return run(spark, s, plugins, entries.where("status <> 'failed'"))
