"""The registered queries of the core and the SQL that gives the same rows.

Metadata queries run over ``file_catalog``; content queries over ``documents``, seen as files whose path, extension and time
are derived from the id (``virtual_files``), by the same expressions in Spark and in SQL.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import files as X
from corpusloom.operators import duplicates, incremental, render, truncation, volumes
from corpusloom.operators import eligibility as E
from corpusloom.operators.ordering import numbered
from corpusloom.plans import fixtures
from corpusloom.session import shared_dir, table

VIRTUAL_EXTENSIONS = (".txt", ".md", ".log", ".py", ".json", ".csv", ".param", ".bin")
CAPACITY = 65_536


def virtual_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: ``doc_id, text, rel_path, ext, kind, size_bytes, size_class, file_id, mtime``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    ext = F.element_at(F.array(*map(F.lit, VIRTUAL_EXTENSIONS)), (F.col("doc_id") % 8).cast("int") + 1)
    rel = F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), F.coalesce("lang", F.lit("xx")), F.lit("/"), F.col("doc_id").cast("string"), ext)
    d = d.select("doc_id", "text", rel.alias("rel_path"), ext.alias("ext"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size_bytes"))
    return d.withColumns(
        {
            "kind": X.kind_of(F.col("ext")),
            "size_class": X.size_class(F.col("size_bytes")),
            "file_id": X.file_id(F.col("rel_path")),
            "mtime": F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id as int))"),
        }
    )


VIRTUAL_SQL = """WITH v0 AS (SELECT doc_id, text, ['.txt','.md','.log','.py','.json','.csv','.param','.bin'][doc_id % 8 + 1] AS ext,
  coalesce(source, 'unknown') || '/' || coalesce(lang, 'xx') || '/' || doc_id || ['.txt','.md','.log','.py','.json','.csv','.param','.bin'][doc_id % 8 + 1] AS rel_path,
  CAST(coalesce(strlen(text), 0) AS BIGINT) AS size_bytes, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 HOUR AS mtime FROM documents),
v AS (SELECT *, CASE ext WHEN '.txt' THEN 'txt' WHEN '.md' THEN 'markdown' WHEN '.log' THEN 'log' WHEN '.py' THEN 'code_py' WHEN '.json' THEN 'json'
  WHEN '.csv' THEN 'csv' WHEN '.param' THEN 'param' ELSE 'unsupported' END AS kind, substr(sha1(rel_path), 1, 8) AS file_id,
  CASE WHEN size_bytes < 1024 THEN '<1KB' WHEN size_bytes < 1048576 THEN '1KB-1MB' WHEN size_bytes < 10485760 THEN '1MB-10MB' WHEN size_bytes < 104857600 THEN '10MB-100MB' ELSE '>100MB' END AS size_class
  FROM v0) """

SUFFIX_SQL = r"lower(regexp_extract(regexp_extract(rel_path, '[^/]*$'), '^.+(\.[^.]+)$', 1))"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog without its verdicts, with ``ext``."""
    f = table(spark, sf_dir, "file_catalog").drop("eligible", "eligibility_reasons")
    return f.withColumn("ext", X.suffix(F.col("rel_path")))


# -- catalog ----------------------------------------------------------------------------------------------------------


def catalog_classify(spark, sf_dir):
    return virtual_files(spark, sf_dir).select("doc_id", "rel_path", "ext", "kind", "size_bytes", "size_class", "file_id", "mtime")


def kind_summary(spark, sf_dir):
    return virtual_files(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def kinds_of_catalog(spark, sf_dir):
    return _files(spark, sf_dir).groupBy(X.kind_of(F.col("ext")).alias("derived_kind")).agg(F.count("*").alias("files"))


def size_class_hist(spark, sf_dir):
    return _files(spark, sf_dir).groupBy(X.size_class(F.col("size_bytes")).alias("size_class")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def file_ids(spark, sf_dir):
    return _files(spark, sf_dir).select("scan_row_id", X.file_id(F.col("rel_path")).alias("derived_id"), X.file_key(F.col("rel_path")).alias("file_key"))


def file_id_collisions(spark, sf_dir):
    ids = _files(spark, sf_dir).select(X.file_id(F.col("rel_path")).alias("derived_id"), "rel_path").distinct()
    return ids.groupBy("derived_id").agg(F.count("*").alias("paths")).where("paths > 1")


def purge_flags(spark, sf_dir):
    return _files(spark, sf_dir).select("scan_row_id", X.purge_reason(F.col("rel_path")).alias("purged"))


# -- eligibility ------------------------------------------------------------------------------------------------------

EXT_RULE = E.ExtensionRule(exclude_exts=frozenset({".bin"}), exclude_kinds=frozenset({"exe"}), include_kinds=frozenset({"txt", "markdown", "log", "csv", "json", "code_py", "pdf", "image"}))
SIZE_RULES = E.Rules({".log": E.SizeRule(0.001, 0.03)}, {"markdown": E.SizeRule(max_mb=0.02), "image": E.SizeRule(min_mb=0.005)}, E.SizeRule(max_mb=0.05))
MTIME = (datetime(2019, 1, 1), datetime(2025, 1, 1))
CTIME = (datetime(2018, 6, 1), None)


def _failures() -> dict[str, Column]:
    ext, kind = F.col("ext"), F.col("kind")
    return {
        "ext_filter": EXT_RULE.failure(ext, kind),
        "size_filter": E.size_failure(F.col("size_bytes"), ext, kind, SIZE_RULES),
        "mtime_filter": E.time_failure(F.col("mtime"), *MTIME),
        "ctime_filter": E.time_failure(F.col("ctime"), *CTIME),
    }


def _judged(spark, sf_dir) -> DataFrame:
    return E.with_eligibility(_files(spark, sf_dir), _failures())


def _one_filter(name: str):
    def query(spark, sf_dir):
        return _files(spark, sf_dir).select("scan_row_id", _failures()[name].alias("failure"))

    return query


def eligibility_reasons(spark, sf_dir):
    return _judged(spark, sf_dir).select("scan_row_id", "eligible", F.array_join("eligibility_reasons", "; ").alias("reasons"))


def reject_breakdown(spark, sf_dir):
    return E.reject_breakdown(_judged(spark, sf_dir))


def reject_buckets(spark, sf_dir):
    j = _judged(spark, sf_dir)
    return j.agg(F.count_if("eligible").alias("eligible"), *(F.count_if(E.in_bucket(F.col("eligibility_reasons"), n)).alias(n) for n in E.FILTERS))


def recorded_breakdown(spark, sf_dir):
    """The breakdown of the verdicts that the catalog itself records."""
    return E.reject_breakdown(table(spark, sf_dir, "file_catalog"))


FAIL_SQL = {
    "ext_filter": "CASE WHEN ext = '.bin' THEN 'exclude_ext=' || ext WHEN kind = 'exe' THEN 'exclude_kind=' || kind "
    "WHEN kind IS NULL OR kind NOT IN ('txt','markdown','log','csv','json','code_py','pdf','image') THEN 'not_in_include_kind=' || coalesce(kind, '') END",
    "size_filter": "CASE WHEN lo >= 0 AND size_bytes < lo THEN 'size<' || lo WHEN hi >= 0 AND size_bytes > hi THEN 'size>' || hi END",
    "mtime_filter": "CASE WHEN mtime < TIMESTAMP '2019-01-01' THEN 'before_start' WHEN mtime > TIMESTAMP '2025-01-01' THEN 'after_end' END",
    "ctime_filter": "CASE WHEN ctime < TIMESTAMP '2018-06-01' THEN 'before_start' END",
}
JUDGED_SQL = (
    f"WITH f0 AS (SELECT scan_row_id, rel_path, kind, size_bytes, mtime, ctime, {SUFFIX_SQL} AS ext FROM file_catalog), "
    "f AS (SELECT *, CASE WHEN ext = '.log' THEN 1048 WHEN kind = 'image' THEN 5242 ELSE -1 END AS lo, "
    "CASE WHEN ext = '.log' THEN 31457 WHEN kind = 'image' THEN -1 WHEN kind = 'markdown' THEN 20971 ELSE 52428 END AS hi FROM f0), "
    "j AS (SELECT *, " + ", ".join(f"{sql} AS {name}" for name, sql in FAIL_SQL.items()) + " FROM f), "
    "r AS (SELECT *, concat_ws('; ', " + ", ".join(f"'{n}: ' || {n}" for n in FAIL_SQL) + ") AS reasons FROM j) "
)

# -- hashes and duplicates ----------------------------------------------------------------------------------------------


def hash_algos(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", *(duplicates.content_hash(t, a).alias(a) for a in ("sha256", "sha1", "md5")))


#: The size limit of the two queries about what is not hashed; about a third of the texts are longer.
HASH_LIMIT = 4096


def _hashed(spark, sf_dir, max_bytes: int = 0) -> DataFrame:
    v = virtual_files(spark, sf_dir)
    return duplicates.with_hash(v, F.col("text"), F.col("size_bytes"), "sha256", max_bytes)


def hash_outcomes(spark, sf_dir):
    return duplicates.hash_outcomes(_hashed(spark, sf_dir, HASH_LIMIT))


def unhashed(spark, sf_dir):
    return _hashed(spark, sf_dir, HASH_LIMIT).where("content_hash IS NULL").select("doc_id", F.col("content_hash_skipped_reason").alias("reason"))


def dup_groups(spark, sf_dir):
    return duplicates.duplicate_groups(_hashed(spark, sf_dir))


def dup_roles(spark, sf_dir):
    return duplicates.duplicate_roles(_hashed(spark, sf_dir), keep=("doc_id", "size_bytes", "rel_path")).select("doc_id", "content_hash", "role", "files", "main_path")


def dup_summary(spark, sf_dir):
    return duplicates.duplicate_totals(duplicates.duplicate_groups(_hashed(spark, sf_dir)))


def dup_report(spark, sf_dir):
    return duplicates.ranked_groups(duplicates.duplicate_groups(_hashed(spark, sf_dir))).select("group_no", F.substring("content_hash", 1, 16).alias("hash_prefix"), "files", "main_path", "redundant_bytes")


HASHED_SQL = VIRTUAL_SQL + ", h AS (SELECT *, sha256(text) AS content_hash FROM v), "
LIMITED_SQL = VIRTUAL_SQL + f", h AS (SELECT *, CASE WHEN size_bytes <= {HASH_LIMIT} THEN sha256(text) END AS content_hash, CASE WHEN size_bytes > {HASH_LIMIT} THEN 'size>{HASH_LIMIT}' WHEN text IS NULL THEN 'read_error' END AS reason FROM v) "
GROUPS_SQL = (
    HASHED_SQL + "m AS (SELECT content_hash, rel_path, size_bytes, row_number() OVER (PARTITION BY content_hash ORDER BY lower(rel_path), rel_path, size_bytes) AS n, count(*) OVER (PARTITION BY content_hash) AS files "
    "FROM h WHERE content_hash IS NOT NULL), g AS (SELECT content_hash, files, rel_path AS main_path, size_bytes AS main_size, size_bytes * (files - 1) AS redundant_bytes FROM m WHERE n = 1 AND files > 1) "
)

# -- volumes --------------------------------------------------------------------------------------------------------------


def _plan(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n"))
    return volumes.next_fit(d, [F.col("doc_id")], "doc_id", "n", CAPACITY)


def volume_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


def volume_stats(spark, sf_dir):
    return volumes.volume_stats(_plan(spark, sf_dir))


def volume_links(spark, sf_dir):
    return volumes.volume_links(volumes.volume_stats(_plan(spark, sf_dir)))


def oversize_parts(spark, sf_dir):
    d = table(spark, sf_dir, "conversions").where("markdown IS NOT NULL")
    return volumes.oversize_parts(d, "conv_id", "markdown", 16_384).drop("block")


PLAN_SQL = (
    "WITH RECURSIVE o AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS size, row_number() OVER (ORDER BY doc_id) AS k FROM documents), "
    "w AS (SELECT doc_id, size, k, CAST(1 AS BIGINT) AS volume, size AS used FROM o WHERE k = 1 UNION ALL "
    "SELECT o.doc_id, o.size, o.k, CASE WHEN w.used + o.size > 65536 AND w.used > 0 THEN w.volume + 1 ELSE w.volume END, "
    "CASE WHEN w.used + o.size > 65536 AND w.used > 0 THEN o.size ELSE w.used + o.size END FROM w JOIN o ON o.k = w.k + 1) "
)

# -- rules by extension and kind ---------------------------------------------------------------------------------------------

TRUNCATION = E.Rules({".log": truncation.TruncationRule(True, 2, 1)}, {"pdf": truncation.TruncationRule(True, 0.5, 0.5, 0.25, 2), "csv": truncation.TruncationRule(True, 1)}, truncation.TruncationRule())


def spec_lookup(spark, sf_dir):
    f, ext, kind = _files(spark, sf_dir), F.col("ext"), F.col("kind")
    values = {n: TRUNCATION.value(ext, kind, lambda r, n=n: float(getattr(r, n))) for n in ("head_mb", "tail_mb", "chunk_mb", "middle_chunks")}
    return f.select("scan_row_id", *(c.alias(n) for n, c in values.items()))


# -- text --------------------------------------------------------------------------------------------------------------------


def parameter_rows(text: Column) -> Column:
    """An array of (name, value) of a parameter file, natively: as ``sources.converters.parameters``."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    pairs = F.transform(kept, lambda x: F.when(F.contains(x, F.lit(",")), F.split(x, ",", 2)).otherwise(F.split(x, r"[ \t]+", 2)))
    named = F.filter(pairs, lambda p: (F.size(p) == 2) & (F.trim(p[0]) != ""))
    return F.transform(named, lambda p: F.struct(F.trim(p[0]).alias("name"), F.trim(p[1]).alias("value")))


def _param_texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").where("kind = 'param' AND text IS NOT NULL").select("doc_id", "text")


def param_rows(spark, sf_dir):
    return _param_texts(spark, sf_dir).select("doc_id", F.posexplode(parameter_rows(F.col("text"))).alias("pos", "p")).select("doc_id", "pos", "p.name", "p.value")


def param_counts(spark, sf_dir):
    lines = F.split("text", r"\r\n|\n|\r")
    comments = F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("#")))
    return _param_texts(spark, sf_dir).select("doc_id", F.size(lines).alias("lines"), F.size(parameter_rows(F.col("text"))).alias("params"), comments.alias("comments"))


def csv_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.table_cell(F.col("text"))).alias("cell_md5"))


def human_bytes(spark, sf_dir):
    n = F.col("size_bytes")
    return _files(spark, sf_dir).select("scan_row_id", *(X.human_bytes(n, s).alias(s) for s in ("bundle", "dup", "image")))


def safe_filename(spark, sf_dir):
    return _files(spark, sf_dir).select("scan_row_id", X.safe_name(F.col("rel_path")).alias("safe_name"))


def code_fence(spark, sf_dir):
    v = virtual_files(spark, sf_dir).where("text IS NOT NULL")
    return v.select("doc_id", F.md5(X.fenced(F.col("text"), X.choose(F.col("kind"), X.FENCE_LANGUAGES, F.lit("text")))).alias("fence_md5"))


def block_bytes(spark, sf_dir):
    v = virtual_files(spark, sf_dir)
    status = F.when(F.col("text").isNull(), "failed").when(F.col("kind") == "unsupported", "skipped").otherwise("success")
    body = render.block_body(status, F.col("text"), F.lit("read_error"), F.lit(None).cast("string"))
    block = render.file_block(F.col("rel_path"), F.col("file_id"), F.col("kind"), F.col("size_bytes"), F.array().cast("array<string>"), body)
    return v.select("doc_id", F.octet_length(block).cast("bigint").alias("block_bytes"), F.md5(block).alias("block_md5"))


def hex_preview(spark, sf_dir):
    """The first 256 bytes of every text as a dump, and the last 256 of those that have more than both."""
    data, n = F.encode("text", "UTF-8"), F.octet_length("text")
    tail = F.when(n > 512, X.hex_preview(F.substring(data, n - 255, F.lit(256))))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", X.hex_preview(F.substring(data, 1, 256)).alias("head"), tail.alias("tail"))


def compact_metadata(spark, sf_dir):
    f = table(spark, sf_dir, "file_catalog")
    c = F.col
    line = X.compact_metadata(c("size_bytes"), c("mtime"), c("ctime"), c("ctime_source"), c("content_hash"), F.coalesce("content_hash_algo", F.lit("sha256")), c("content_hash_skipped_reason"))
    return f.select("scan_row_id", line.alias("metadata"))


def json_validity(spark, sf_dir):
    return table(spark, sf_dir, "conversions").select("conv_id", F.coalesce(F.try_parse_json("extra").isNotNull(), F.lit(False)).alias("valid"))


# -- joins, listings, samples ---------------------------------------------------------------------------------------------------


def pending_files(spark, sf_dir):
    done = table(spark, sf_dir, "conversions").where("status = 'success'").select("scan_row_id")
    return table(spark, sf_dir, "file_catalog").where("eligible").join(done, "scan_row_id", "left_anti").select("scan_row_id")


def _entries(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversions").select("conv_id", "scan_row_id", "status", "extra", "warnings", "error", "skip_reason")
    return c.join(table(spark, sf_dir, "file_catalog").select("scan_row_id", "rel_path", "kind", "size_bytes", "file_id"), "scan_row_id")


def status_summary(spark, sf_dir):
    return render.status_summary(_entries(spark, sf_dir))


def ocr_totals(spark, sf_dir):
    return table(spark, sf_dir, "ocr_results").groupBy(F.lower("engine").alias("engine")).agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"), F.sum("raw_lines").alias("raw_lines"))


def toc_rows(spark, sf_dir):
    rows = numbered(_entries(spark, sf_dir), [F.lower("rel_path"), F.col("rel_path"), F.col("conv_id")])
    return rows.select("idx", render.toc_line(F.col("idx"), F.col("rel_path"), F.col("file_id"), F.col("kind"), F.col("status")).alias("line"))


def inventory_tsv(spark, sf_dir):
    f = virtual_files(spark, sf_dir).withColumns({"ctime": F.lit(None).cast("timestamp_ntz"), "ctime_source": F.lit("unavailable")})
    return render.inventory_tsv(E.with_eligibility(f, {"ext_filter": E.ExtensionRule(exclude_exts=frozenset({".bin"})).failure(F.col("ext"), F.col("kind"))}))


def head_tail_sample(spark, sf_dir):
    """Of each user's events the first 5, and the last 3 of those after them."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    w = Window.partitionBy("user_id")
    # Each limit is its own window, so that tasks drop what is beyond it before the shuffle; a hot user costs a few rows a task.
    head = e.withColumn("n", F.row_number().over(w.orderBy("ts", "event_id"))).where("n <= 5").select("user_id", "event_id", F.lit("head").alias("part"))
    tail = e.withColumn("n", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id")))).where("n <= 3").select("user_id", "event_id", F.lit("tail").alias("part"))
    return head.unionAll(tail).groupBy("user_id", "event_id").agg(F.min("part").alias("part"))


def type_histogram(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.min("event_id").alias("first_id"))


def row_limit_per_group(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    n = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber"))
    return li.withColumn("n", n).where("n <= 200")


# -- extraction ------------------------------------------------------------------------------------------------------------------


def converted(spark, sf_dir):
    from corpusloom.sources.converters import convert_files

    v = virtual_files(spark, sf_dir).withColumn("content", F.encode("text", "UTF-8"))
    return convert_files(v, "doc_id", "kind", "content", "rel_path").select("doc_id", "status", F.octet_length("markdown").alias("bytes"), F.size("warnings").alias("warnings"))


def txt_blocks(spark, sf_dir):
    """The converters' Markdown of the kinds that SQL can express."""
    from corpusloom.sources.converters import convert_files

    v = virtual_files(spark, sf_dir).where("text IS NOT NULL").withColumn("content", F.encode("text", "UTF-8"))
    got = convert_files(v.where("kind IN ('txt', 'markdown', 'code_py')"), "doc_id", "kind", "content", "rel_path")
    return got.select("doc_id", "status", F.md5("markdown").alias("markdown_md5"))


def html_to_md(spark, sf_dir):
    from corpusloom.sources.converters import convert_files

    d = table(spark, sf_dir, "documents").where("kind = 'html'").select("doc_id", "kind", F.encode("text", "UTF-8").alias("content"), F.lit("page.html").alias("name"))
    return convert_files(d, "doc_id", "kind", "content", "name").select("doc_id", "status", "markdown")


def _truncated(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "conversions").where("markdown IS NOT NULL")
    rule = truncation.TruncationRule(True, 4096 / (1 << 20), 2048 / (1 << 20), 1024 / (1 << 20), 2)
    return truncation.truncate_items(d, "conv_id", F.col("markdown"), F.col("file_id"), {"all": rule}, F.lit("all"))


def truncate_sample(spark, sf_dir):
    return _truncated(spark, sf_dir).select("conv_id", "truncated", "original_bytes", "kept_bytes", "head_bytes", "tail_bytes", "middle_bytes", "skipped_bytes", "chunks_kept")


def truncate_totals(spark, sf_dir):
    t = _truncated(spark, sf_dir)
    return t.agg(F.count("*").alias("items"), F.count_if("truncated").alias("cut"), F.sum("original_bytes").alias("bytes"), F.count_if(F.col("kept_bytes") + F.col("skipped_bytes") != F.col("original_bytes")).alias("wrong"))


def log_truncate(spark, sf_dir):
    from corpusloom.sources.converters import Options, convert_files

    d = table(spark, sf_dir, "documents").where("kind = 'log' AND text IS NOT NULL").select("doc_id", "kind", F.encode("text", "UTF-8").alias("content"), F.lit("x.log").alias("name"))
    got = convert_files(d, "doc_id", "kind", "content", "name", Options(log_bytes=1024))
    return got.select("doc_id", F.get_json_object("extra", "$.truncated").alias("truncated"), F.get_json_object("extra", "$.original_bytes").cast("bigint").alias("original_bytes"))


def p5_found(spark, sf_dir):
    folder = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    tables = (table(spark, sf_dir, t) for t in ("file_catalog", "run_journal", "scan_runs"))
    return incremental.replayed(*tables, folder).select("scan_row_id")


def p5_first(spark, sf_dir):
    """The same where no run has left any state: everything is read."""
    rows = incremental.keyed(table(spark, sf_dir, "file_catalog"))
    return incremental.pending_versions(rows, table(spark, sf_dir, "run_journal"), table(spark, sf_dir, "scan_runs")).select("scan_row_id")


QUERIES = {
    f.__name__: f
    for f in (
        p5_found, p5_first, catalog_classify, kind_summary, kinds_of_catalog, size_class_hist, file_ids, file_id_collisions, purge_flags, eligibility_reasons, reject_breakdown,
        reject_buckets, recorded_breakdown, hash_algos, hash_outcomes, unhashed, dup_groups, dup_roles, dup_summary, dup_report, volume_plan, volume_stats, volume_links,
        oversize_parts, spec_lookup, param_rows, param_counts, csv_escape, human_bytes, safe_filename, code_fence, block_bytes, hex_preview, compact_metadata, json_validity,
        pending_files, status_summary, ocr_totals, toc_rows, inventory_tsv, head_tail_sample, type_histogram, row_limit_per_group, converted, txt_blocks, html_to_md,
        truncate_sample, truncate_totals, log_truncate,
    )
} | {name: _one_filter(name) for name in E.FILTERS} | {"converted_kinds": fixtures.converted_kinds}



def _dump_sql(hexed: str) -> str:
    """A hex dump in SQL of a string of hex digits."""
    pairs = f"list_transform(range(a * 2, least(a * 2 + 32, len({hexed})), 2), lambda i: lower(substr({hexed}, i + 1, 2)))"
    seen = f"array_to_string(list_transform({pairs}, lambda p: CASE WHEN p BETWEEN '20' AND '7e' THEN chr(CAST('0x' || p AS INT)) ELSE '.' END), '')"
    line = f"lpad(lower(to_hex(a)), 8, '0') || '  ' || rpad(array_to_string({pairs}, ' '), 47, ' ') || '  |' || {seen} || '|'"
    return f"CASE WHEN {hexed} = '' THEN '(空)' || chr(10) ELSE array_to_string(list_transform(range(0, len({hexed}) // 2, 16), lambda a: {line}), chr(10)) || chr(10) END"


_KINDS_SQL = "CASE " + " ".join(f"WHEN ext = '{e}' THEN '{k}'" for e, k in X.EXTENSION_KINDS.items()) + " WHEN ext IN (" + ", ".join(f"'{e}'" for e in X.IMAGE_EXTENSIONS) + ") THEN 'image' ELSE 'unsupported' END"
_PATH_SQL = r"nfc_normalize(regexp_replace(regexp_replace(regexp_replace(rel_path, '[\\/]+', '/', 'g'), '^(\./)+', ''), '^/|/\.?$', '', 'g'))"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _human_sql(style: str) -> str:
    group = "{:,}" if style == "dup" else "{}"
    number = "{:.1f}" if style == "image" else "{:,.1f}"
    gb = "{:.2f}" if style == "image" else number
    out = f"CASE WHEN size_bytes < 1024 THEN format('{group} B', size_bytes) WHEN size_bytes < 1048576 THEN format('{number} KB', size_bytes / 1024.0::DOUBLE) WHEN size_bytes < 1073741824 THEN format('{number} MB', size_bytes / 1048576.0::DOUBLE) "
    last = f"WHEN size_bytes < 1099511627776 THEN format('{gb} GB', size_bytes / 1073741824.0::DOUBLE) ELSE format('{gb} TB', size_bytes / 1099511627776.0::DOUBLE) END"
    return out + (f"ELSE format('{gb} GB', size_bytes / 1073741824.0::DOUBLE) END" if style == "image" else last)


_LABEL_SQL = "coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in X.KIND_LABELS.items()) + "}[kind], kind)"
_STATUS_SQL = "coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in X.STATUS_LABELS.items()) + "}[status], status)"
_RULE = render.RULE.replace("\n", "") + "' || chr(10) || '"


def _block_sql() -> str:
    nl = "' || chr(10) || '"

    def marks(what: str) -> str:
        return f"{_RULE}<!-- ============ FILE {what} · ID=' || file_id || ' ============ -->{nl}<!-- ============ PATH: ' || rel_path || ' ============ -->{nl}{_RULE}"

    def ends(what: str) -> str:
        return f"===== FILE {what}: ' || rel_path || ' ====={nl}===== FILE ID: ' || file_id || ' ====={nl}"

    text = "coalesce(text, '')"
    body = (
        f"CASE WHEN text IS NULL THEN '> ❌ **此文件转换失败**：read_error{nl}> 已跳过内容，仅保留占位。{nl}' WHEN kind = 'unsupported' AND {text} = '' THEN '> 🚫 **此文件已跳过**：未指定原因{nl}' ELSE {text} END"
    )
    return (
        VIRTUAL_SQL + f", b AS (SELECT *, {body} AS body0 FROM v), c AS (SELECT *, CASE WHEN body0 LIKE '%' || chr(10) THEN body0 ELSE body0 || chr(10) END AS body FROM b), "
        f"k AS (SELECT doc_id, '{nl}{nl}{marks('START')}{nl}<a id=\"file-' || file_id || '\"></a>{nl}{ends('START')}- 类型: ' || {_LABEL_SQL} || '{nl}- 原始大小: ' || size_bytes || ' bytes{nl}- 转换警告: 无{nl}{nl}' || body || '{nl}{ends('END')}{nl}{marks('END')}{nl}{nl}' AS block FROM c) "
        "SELECT doc_id, CAST(strlen(block) AS BIGINT) AS block_bytes, md5(block) AS block_md5 FROM k"
    )


_PARAM_SQL = (
    r"WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS lines FROM documents WHERE kind = 'param' AND text IS NOT NULL), "
    "k AS (SELECT doc_id, lines, list_filter(list_transform(lines, lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT starts_with(x, '#')) AS kept FROM l), "
    "p AS (SELECT doc_id, lines, list_filter(list_transform(kept, lambda x: CASE WHEN contains(x, ',') THEN {'name': trim(split_part(x, ',', 1), ' '), 'value': trim(substr(x, strpos(x, ',') + 1), ' ')} "
    r"WHEN regexp_matches(x, '[ \t]+') THEN {'name': regexp_extract(x, '^([^ \t]*)[ \t]+(?s:(.*))$', 1), 'value': trim(regexp_extract(x, '^([^ \t]*)[ \t]+(?s:(.*))$', 2), ' ')} END), lambda y: y IS NOT NULL AND y.name <> '') AS pairs FROM k) "
)

SQL = {
    **dict.fromkeys(("p5_found", "p5_first"), f"WITH f AS (SELECT tree_id, {_PATH_SQL} AS p, mtime, scan_no, scan_row_id FROM file_catalog WHERE tree_id IS NOT NULL AND rel_path IS NOT NULL), "
    "t AS (SELECT tree_id, p, mtime, row_number() OVER (PARTITION BY tree_id, p ORDER BY scan_no DESC, mtime DESC NULLS LAST) AS n FROM f), "
    f"d AS (SELECT DISTINCT tree_id, {_PATH_SQL} AS p, mtime FROM run_journal WHERE lower(trim(state)) = 'done' AND scan_no IN (SELECT scan_no FROM scan_runs WHERE output_kept)) "
    "SELECT min(f.scan_row_id) AS scan_row_id FROM t JOIN f ON f.tree_id = t.tree_id AND f.p = t.p AND f.mtime IS NOT DISTINCT FROM t.mtime WHERE t.n = 1 "
    "AND NOT EXISTS (SELECT 1 FROM d WHERE d.tree_id = t.tree_id AND d.p = t.p AND d.mtime IS NOT DISTINCT FROM t.mtime) GROUP BY t.tree_id, t.p"),
    "catalog_classify": VIRTUAL_SQL + "SELECT doc_id, rel_path, ext, kind, size_bytes, size_class, file_id, mtime FROM v",
    "kind_summary": VIRTUAL_SQL + "SELECT kind, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM v GROUP BY kind",
    "kinds_of_catalog": f"SELECT {_KINDS_SQL} AS derived_kind, count(*) AS files FROM (SELECT {SUFFIX_SQL} AS ext FROM file_catalog) GROUP BY 1",
    "size_class_hist": "SELECT CASE WHEN size_bytes < 1024 THEN '<1KB' WHEN size_bytes < 1048576 THEN '1KB-1MB' WHEN size_bytes < 10485760 THEN '1MB-10MB' WHEN size_bytes < 104857600 THEN '10MB-100MB' WHEN size_bytes IS NOT NULL THEN '>100MB' END AS size_class, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM file_catalog GROUP BY 1",
    "file_ids": "SELECT scan_row_id, substr(sha1(rel_path), 1, 8) AS derived_id, sha1(rel_path) AS file_key FROM file_catalog",
    "file_id_collisions": "SELECT derived_id, count(*) AS paths FROM (SELECT DISTINCT substr(sha1(rel_path), 1, 8) AS derived_id, rel_path FROM file_catalog) GROUP BY 1 HAVING count(*) > 1",
    "purge_flags": r"SELECT scan_row_id, CASE WHEN regexp_matches(rel_path, '(^|/)\.') THEN 'hidden' WHEN len(list_intersect(string_split(rel_path, '/')[:-2], [" + _quoted(X.PURGED_DIRECTORIES) + "])) > 0 THEN 'dir' "
    f"WHEN regexp_extract(rel_path, '[^/]*$') IN ({_quoted(X.PURGED_NAMES)}) THEN 'name' WHEN {SUFFIX_SQL} IN ({_quoted(X.PURGED_SUFFIXES)}) THEN 'suffix' END AS purged FROM file_catalog",
    **{name: JUDGED_SQL + f"SELECT scan_row_id, {name} AS failure FROM j" for name in FAIL_SQL},
    "eligibility_reasons": JUDGED_SQL + "SELECT scan_row_id, reasons = '' AS eligible, reasons FROM r",
    "reject_breakdown": JUDGED_SQL + "SELECT filter, count(*) AS files FROM (SELECT split_part(unnest(string_split(reasons, '; ')), ':', 1) AS filter FROM r WHERE reasons <> '') GROUP BY filter",
    "reject_buckets": JUDGED_SQL + "SELECT count(*) FILTER (reasons = '') AS eligible, " + ", ".join(f"count({n}) AS {n}" for n in FAIL_SQL) + " FROM r",
    "recorded_breakdown": "SELECT split_part(r, ':', 1) AS filter, count(*) AS files FROM (SELECT unnest(eligibility_reasons) AS r FROM file_catalog) WHERE r IS NOT NULL GROUP BY 1",
    "hash_algos": "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5 FROM documents",
    "hash_outcomes": LIMITED_SQL + f"SELECT count(content_hash) AS ok, count(*) FILTER (reason = 'size>{HASH_LIMIT}') AS oversize, count(*) FILTER (reason = 'read_error') AS failed FROM h",
    "unhashed": LIMITED_SQL + "SELECT doc_id, reason FROM h WHERE content_hash IS NULL",
    "dup_groups": GROUPS_SQL + "SELECT * FROM g",
    "dup_roles": GROUPS_SQL + "SELECT doc_id, h.content_hash, CASE WHEN h.rel_path = g.main_path THEN 'MAIN' ELSE 'DUP' END AS role, files, main_path FROM h JOIN g USING (content_hash)",
    "dup_summary": GROUPS_SQL + "SELECT count(*) AS groups, CAST(coalesce(sum(files), 0) AS BIGINT) AS files, CAST(coalesce(sum(files - 1), 0) AS BIGINT) AS redundant_files, CAST(coalesce(sum(redundant_bytes), 0) AS BIGINT) AS redundant_bytes FROM g",
    "dup_report": GROUPS_SQL + "SELECT row_number() OVER (ORDER BY redundant_bytes DESC, main_path) AS group_no, substr(content_hash, 1, 16) AS hash_prefix, files, main_path, redundant_bytes FROM g",
    "volume_plan": PLAN_SQL + "SELECT doc_id, size, volume FROM w",
    "volume_stats": PLAN_SQL + "SELECT volume, count(*) AS blocks, CAST(sum(size) AS BIGINT) AS bytes FROM w GROUP BY volume",
    "volume_links": PLAN_SQL + ", s AS (SELECT volume, count(*) AS blocks, CAST(sum(size) AS BIGINT) AS bytes FROM w GROUP BY volume) SELECT *, lag(volume) OVER (ORDER BY volume) AS previous, lead(volume) OVER (ORDER BY volume) AS next FROM s",
    "spec_lookup": f"WITH f AS (SELECT scan_row_id, kind, {SUFFIX_SQL} AS ext FROM file_catalog) SELECT scan_row_id, "
    "CASE WHEN ext = '.log' THEN 2.0 WHEN kind = 'pdf' THEN 0.5 WHEN kind = 'csv' THEN 1.0 ELSE 0.0 END::DOUBLE AS head_mb, CASE WHEN ext = '.log' THEN 1.0 WHEN kind = 'pdf' THEN 0.5 ELSE 0.0 END::DOUBLE AS tail_mb, "
    "CASE WHEN ext = '.log' THEN 0.0 WHEN kind = 'pdf' THEN 0.25 ELSE 0.0 END::DOUBLE AS chunk_mb, CASE WHEN ext = '.log' THEN 0.0 WHEN kind = 'pdf' THEN 2.0 ELSE 0.0 END::DOUBLE AS middle_chunks FROM f",
    "param_rows": _PARAM_SQL + "SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, pairs[pos].name AS name, pairs[pos].value AS value FROM (SELECT doc_id, pairs, unnest(range(1, len(pairs) + 1)) AS pos FROM p)",
    "param_counts": _PARAM_SQL + "SELECT doc_id, CAST(len(lines) AS INTEGER) AS lines, CAST(len(pairs) AS INTEGER) AS params, CAST(len(list_filter(lines, lambda x: starts_with(ltrim(x, ' '), '#'))) AS INTEGER) AS comments FROM p",
    "csv_escape": r"SELECT doc_id, md5(regexp_replace(replace(replace(coalesce(text, ''), '\', '\\'), '|', '\|'), '\r\n|\n|\r', ' ', 'g')) AS cell_md5 FROM documents",
    "converted_kinds": fixtures.SQL,
    "hex_preview": f"WITH h AS (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, substr(x, 1, 512) AS a1, CASE WHEN len(x) > 1024 THEN substr(x, len(x) - 511) END AS z1 FROM h) "
    f"SELECT doc_id, {_dump_sql('a1')} AS head, CASE WHEN z1 IS NOT NULL THEN {_dump_sql('z1')} END AS tail FROM t",
    "compact_metadata": f"SELECT scan_row_id, concat_ws(' · ', {_human_sql('bundle')}, 'm:' || strftime(mtime, '%Y-%m-%d'), CASE WHEN ctime_source IN ('birthtime', 'win_ctime') THEN 'b:' || strftime(ctime, '%Y-%m-%d') "
    "WHEN ctime_source = 'status_ctime' THEN '*c:' || strftime(ctime, '%Y-%m-%d') END, CASE WHEN content_hash <> '' THEN coalesce(content_hash_algo, 'sha256') || ':' || substr(content_hash, 1, 16) "
    "WHEN content_hash_skipped_reason <> '' THEN coalesce(content_hash_algo, 'sha256') || ':n/a' END) AS metadata FROM file_catalog",
    "human_bytes": "SELECT scan_row_id, " + ", ".join(f"{_human_sql(s)} AS {s}" for s in ("bundle", "dup", "image")) + " FROM file_catalog",
    "safe_filename": r"SELECT scan_row_id, substr(regexp_replace(rel_path, '[^A-Za-z0-9._\-+]+', '_', 'g'), 1, 100) AS safe_name FROM file_catalog",
    "code_fence": VIRTUAL_SQL + "SELECT doc_id, md5('```' || CASE WHEN kind = 'code_py' THEN 'python' ELSE 'text' END || chr(10) || text || chr(10) || '```' || chr(10)) AS fence_md5 FROM v WHERE text IS NOT NULL",
    "block_bytes": _block_sql(),
    "json_validity": "SELECT conv_id, coalesce(json_valid(extra), false) AS valid FROM conversions",
    "pending_files": "SELECT scan_row_id FROM file_catalog f WHERE eligible AND NOT EXISTS (SELECT 1 FROM conversions c WHERE c.scan_row_id = f.scan_row_id AND c.status = 'success')",
    "status_summary": "SELECT count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) AS total, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM conversions c JOIN file_catalog f USING (scan_row_id)",
    "ocr_totals": "SELECT lower(engine) AS engine, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(raw_lines) AS BIGINT) AS raw_lines FROM ocr_results GROUP BY 1",
    "toc_rows": "WITH e AS (SELECT conv_id, rel_path, kind, f.file_id, status FROM conversions c JOIN file_catalog f USING (scan_row_id)), n AS (SELECT *, row_number() OVER (ORDER BY lower(rel_path), rel_path, conv_id) AS idx FROM e) "
    f"SELECT idx, idx || '. [' || rel_path || '](#file-' || file_id || ') — ' || {_LABEL_SQL} || ' — ' || {_STATUS_SQL} AS line FROM n",
    "inventory_tsv": VIRTUAL_SQL + ", n AS (SELECT *, row_number() OVER (ORDER BY lower(rel_path), rel_path) AS idx FROM v) SELECT idx, concat_ws(chr(9), idx, file_id, regexp_replace(rel_path, '[\\t\\n]', ' ', 'g'), kind, size_bytes, size_class, strftime(mtime, '%Y-%m-%dT%H:%M:%S'), '', 'unavailable', CASE WHEN ext = '.bin' THEN 0 ELSE 1 END, CASE WHEN ext = '.bin' THEN 'ext_filter: exclude_ext=.bin' ELSE '' END) AS line FROM n",
    "head_tail_sample": "WITH w AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events) SELECT user_id, event_id, CASE WHEN a <= 5 THEN 'head' ELSE 'tail' END AS part FROM w WHERE a <= 5 OR b <= 3",
    "type_histogram": "SELECT event_type, count(*) AS events, min(event_id) AS first_id FROM events GROUP BY event_type",
    "row_limit_per_group": "SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS INTEGER) AS n FROM lineitem) WHERE n <= 200",
    "txt_blocks": VIRTUAL_SQL + "SELECT doc_id, 'success' AS status, md5(CASE WHEN kind = 'markdown' THEN CASE WHEN text LIKE '%' || chr(10) THEN text ELSE text || chr(10) END ELSE '```' || CASE WHEN kind = 'code_py' THEN 'python' ELSE 'text' END || chr(10) || text || chr(10) || '```' || chr(10) END) AS markdown_md5 FROM v WHERE text IS NOT NULL AND kind IN ('txt', 'markdown', 'code_py')",
    "truncate_totals": "SELECT count(*) AS items, count(*) FILTER (strlen(markdown) > 8192) AS cut, CAST(sum(strlen(markdown)) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS wrong FROM conversions WHERE markdown IS NOT NULL",
    "log_truncate": "SELECT doc_id, CASE WHEN strlen(text) > 1024 THEN 'true' ELSE 'false' END AS truncated, CAST(strlen(text) AS BIGINT) AS original_bytes FROM documents WHERE kind = 'log' AND text IS NOT NULL",
}
