"""Rendering of catalog, duplicates, file blocks and report sections: text is built as columns, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import files as X
from corpusloom.operators.eligibility import FILTERS
from corpusloom.operators.ordering import numbered

RULE = "<!-- ================================================================ -->\n"


def label_kind(kind: Column) -> Column:
    return X.choose(kind, X.KIND_LABELS, kind)


def block_body(status: Column, markdown: Column, error: Column, skip_reason: Column) -> Column:
    """What stands between a block's marks: the Markdown, or a notice for a failed or skipped file; it ends a line."""
    text = F.coalesce(markdown, F.lit(""))
    failed = F.concat(F.lit("> ❌ **此文件转换失败**："), F.coalesce(F.nullif(error, F.lit("")), F.lit("未知错误")), F.lit("\n> 已跳过内容，仅保留占位。\n"), text)
    skipped = F.when(text != "", text).otherwise(F.concat(F.lit("> 🚫 **此文件已跳过**："), F.coalesce(F.nullif(skip_reason, F.lit("")), F.lit("未指定原因")), F.lit("\n")))
    body = F.when(status == "success", text).when(status == "failed", failed).otherwise(skipped)
    return F.when(body.endswith("\n"), body).otherwise(F.concat(body, F.lit("\n")))


def file_block(rel: Column, fid: Column, kind: Column, size: Column, warnings: Column, body: Column, metadata: Column | None = None) -> Column:
    """One file's whole block with its marks. Its length in bytes is what the volumes are planned by."""
    said = F.coalesce(F.nullif(F.array_join(warnings, "; "), F.lit("")), F.lit("无"))

    def marks(what: str) -> list[Column]:
        return [F.lit(RULE + f"<!-- ============ FILE {what} · ID="), fid, F.lit(" ============ -->\n<!-- ============ PATH: "), rel, F.lit(" ============ -->\n" + RULE)]

    def ends(what: str) -> list[Column]:
        return [F.lit(f"===== FILE {what}: "), rel, F.lit(" =====\n===== FILE ID: "), fid, F.lit(" =====\n")]

    head = [F.lit("- 类型: "), label_kind(kind), F.lit("\n- 原始大小: "), size.cast("string"), F.lit(" bytes\n"), F.coalesce(metadata, F.lit("")) if metadata is not None else F.lit("")]
    return F.concat(
        F.lit("\n\n"), *marks("START"), F.lit('\n<a id="file-'), fid, F.lit('"></a>\n'), *ends("START"), *head, F.lit("- 转换警告: "), said, F.lit("\n\n"),
        body, F.lit("\n"), *ends("END"), F.lit("\n"), *marks("END"), F.lit("\n\n"),
    )


def inventory_tsv(catalog: DataFrame) -> DataFrame:
    """``idx, line``: the machine-readable index of the whole catalog, tabs and line breaks as spaces."""

    def flat(c: Column) -> Column:
        return F.regexp_replace(F.coalesce(c, F.lit("")), "[\t\n]", " ")

    wanted = ["file_id", "rel_path", "kind", "size_bytes", "size_class", "mtime", "ctime", "ctime_source", "eligible", "eligibility_reasons"]
    rows = numbered(catalog.select(*wanted), [F.lower("rel_path"), F.col("rel_path")])
    cells = ["file_id", flat(F.col("rel_path")), "kind", F.col("size_bytes").cast("string"), "size_class", X.iso_seconds(F.col("mtime"), ""), X.iso_seconds(F.col("ctime"), ""), "ctime_source"]
    line = F.concat_ws("\t", F.col("idx").cast("string"), *cells, F.col("eligible").cast("int").cast("string"), flat(F.array_join("eligibility_reasons", "; ")))
    return rows.select("idx", line.alias("line"))


def toc_line(idx: Column, rel: Column, fid: Column, kind: Column, status: Column, metadata: Column | None = None) -> Column:
    base = F.concat(idx.cast("string"), F.lit(". ["), rel, F.lit("](#file-"), fid, F.lit(") — "), label_kind(kind), F.lit(" — "), X.choose(status, X.STATUS_LABELS, status))
    if metadata is None:
        return base
    return F.when(metadata != "", F.concat(base, F.lit(" — `"), metadata, F.lit("`"))).otherwise(base)


def index_line(idx: Column, rel: Column, fid: Column, status: Column, kind: Column) -> Column:
    """A row of the index of intermediate files."""
    mark = X.choose(status, {k: v[0] for k, v in X.STATUS_LABELS.items()}, status)
    name = F.concat(fid, F.lit("__"), X.safe_name(rel))
    return F.concat(F.lit("| "), idx.cast("string"), F.lit(" | "), F.replace(rel, F.lit("|"), F.lit("\\|")), F.lit(" | "), mark, F.lit(" | "), kind, F.lit(" | ["), name, F.lit(".md](./"), name, F.lit(".md) / ["), name, F.lit(".extra.json](./"), name, F.lit(".extra.json) |"))


def duplicate_lines(files: DataFrame) -> DataFrame:
    """``group_no, role, line``: the machine-readable index of duplicate groups, the main file of each first."""
    from corpusloom.operators.duplicates import duplicate_groups, duplicate_roles, ranked_groups

    groups = ranked_groups(duplicate_groups(files))
    rows = duplicate_roles(files, keep=("file_id", "size_bytes", "rel_path"), groups=groups)
    line = F.concat_ws("\t", F.col("group_no").cast("string"), "role", "file_id", F.col("size_bytes").cast("string"), "rel_path")
    return rows.select("group_no", F.when(F.col("role") == "MAIN", 0).otherwise(1).alias("second"), "rel_path", line.alias("line"))


def front_matter(entries: DataFrame, catalog: DataFrame, source: str, inventory: bool, duplicates: bool, metadata: Column | None = None) -> DataFrame:
    """``section, o1, rel_path, block``: what stands before the files in a bundle, line by line, so that it is packed like any
    block: counts, the inventory, the table of contents, the duplicate index."""

    def rows(df: DataFrame, section: int, order: Column, text: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), order.alias("o1"), F.lit("").alias("rel_path"), F.concat(text, F.lit("\n")).alias("block"))

    def title(section: int, text: str) -> DataFrame:
        return rows(entries.sparkSession.range(1), section, F.lit(""), F.lit(text))

    def number(c: str) -> Column:
        return F.lpad(F.col(c).cast("string"), 20, "0")

    counts = F.format_string(
        f"# 📚 Merged Document Bundle\n\n- 源目录: {source.replace('%', '%%')}\n- 进入提取的文件数: %d\n- 成功: %d  失败: %d  跳过: %d\n- 总字节数（进入提取）: %,d\n\n---\n", *(F.col(c) for c in ("total", "success", "failed", "skipped", "bytes"))
    )
    parts = [rows(status_summary(entries), 0, F.lit(""), counts)]
    if inventory:
        parts += [title(1, "## 📚 完整文件目录\n\n```tsv\nidx\tfile_id\trel_path\tkind\tsize_bytes\tsize_class\tmtime\tctime\tctime_source\teligible\treasons"), rows(inventory_tsv(catalog), 2, number("idx"), F.col("line")), title(3, "```\n\n---\n")]
    wanted = ["rel_path", "file_id", "kind", "status"] if metadata is None else [c for c in entries.columns if c not in ("markdown", "extra", "warnings")]
    listed = numbered(entries.select(*wanted), [F.lower("rel_path"), F.col("rel_path")])
    parts += [title(4, "## 📑 目录 (Table of Contents)\n"), rows(listed, 5, number("idx"), toc_line(F.col("idx"), F.col("rel_path"), F.col("file_id"), F.col("kind"), F.col("status"), metadata)), title(6, "\n---\n")]
    if duplicates:
        order = F.concat(number("group_no"), F.col("second").cast("string"), F.lower("rel_path"))
        parts += [title(7, "## 🔁 重复文件报告 (Duplicate Files Report)\n\n```\n# format: <group_idx>\t<role>\t<file_id>\t<size>\t<rel_path>"), rows(duplicate_lines(catalog), 8, order, F.col("line")), title(9, "```\n\n---\n")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def status_summary(entries: DataFrame, size: str = "size_bytes") -> DataFrame:
    """``success, failed, skipped, total, bytes``: one row."""
    return entries.agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "skipped")),
        F.count("*").alias("total"),
        F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"),
    )


def report_sections(entries: DataFrame, catalog: DataFrame) -> dict[str, DataFrame]:
    """The report's tables by name. ``entries`` are conversions joined with their catalog rows; ``extra`` is JSON."""

    def flag(name: str) -> Column:
        return F.get_json_object("extra", f"$.{name}") == "true"

    def of(status: str, *more: str) -> DataFrame:
        return entries.where(F.col("status") == status).select("rel_path", "kind", "size_bytes", *more)

    def rejected_by(name: str) -> DataFrame:
        return catalog.where(F.exists("eligibility_reasons", lambda r: r.startswith(name))).select("rel_path", "kind", "size_bytes", "eligibility_reasons")

    rejected = {f"rejected_{f.split('_')[0]}": rejected_by(f) for f in FILTERS}
    return {
        "overview": status_summary(entries),
        "success": of("success", "warnings"),
        "failed": of("failed", "error"),
        "skipped": of("skipped", "skip_reason"),
        "scanned_pdf": entries.where((F.col("kind") == "pdf") & flag("is_scanned_pdf")).select("rel_path", "size_bytes"),
        "ocr": entries.where((F.col("kind") == "image") & (F.col("status") == "success")).agg(
            F.count("*").alias("images"),
            F.sum(F.get_json_object("extra", "$.ocr_chars").cast("bigint")).alias("chars"),
            F.sum(F.get_json_object("extra", "$.ocr_elapsed").cast("double")).alias("seconds"),
        ),
        "truncated": entries.where(flag("truncated")).select("rel_path", "kind", "size_bytes"),
        "inventory": inventory_tsv(catalog),
        **rejected,
    }


def render_table(df: DataFrame, title: str) -> DataFrame:
    """One string per row: a Markdown table of a report section, to be written with ``write.text``; the order is the data's."""
    head = f"## {title}\n\n| " + " | ".join(df.columns) + " |\n| " + " | ".join("---" for _ in df.columns) + " |"
    cells = [X.table_cell(F.col(c).cast("string")) for c in df.columns]
    lines = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    return df.sparkSession.createDataFrame([(head,)], "value string").unionByName(lines)


def report_document(sections: dict[str, DataFrame]) -> DataFrame:
    """``key, section, line, block``: the report as lines of Markdown in order, a table a section; ``block`` ends a line.

    A section's rows stand in the order of their text, so that the document is the same each time and nothing is sorted in one task.
    """
    out = None
    for i, (name, df) in enumerate(sections.items(), 1):
        head = f"\n## {i}. {name}\n\n| " + " | ".join(df.columns) + " |\n| " + " | ".join("---" for _ in df.columns) + " |\n"
        cells = [X.table_cell(F.concat_ws("; ", F.col(f.name)) if f.dataType.typeName() == "array" else F.col(f.name).cast("string")) for f in df.schema]
        lines = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |\n")).alias("block"))
        first = df.sparkSession.createDataFrame([(i, "", head)], "section int, line string, block string")
        part = first.unionByName(lines.select(F.lit(i).alias("section"), F.col("block").alias("line"), "block"))
        out = part if out is None else out.unionByName(part)
    return out.distinct().withColumn("key", F.sha1(F.concat_ws("#", F.col("section").cast("string"), "line")))


def rejected_tree(catalog: DataFrame) -> DataFrame:
    """``depth, line``: what was rejected, as an indented tree; one row a file, ordered by path when written."""
    parts = F.split("rel_path", "/")
    depth = F.size(parts) - 1
    line = F.concat(F.repeat(F.lit("  "), depth), F.lit("- "), F.element_at(parts, -1), F.lit(" — "), F.array_join("eligibility_reasons", "; "))
    return catalog.where(~F.col("eligible")).select("rel_path", depth.alias("depth"), line.alias("line"))
