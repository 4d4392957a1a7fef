"""Column expressions over file metadata: kind, size class, ids, labels and formatted values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension -> kind.
EXTENSION_KINDS = {
    ".pdf": "pdf", ".docx": "docx", ".txt": "txt", ".csv": "csv", ".xlsx": "xlsx", ".json": "json",
    ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html",
    ".doc": "doc", ".dot": "doc", ".xls": "xls", ".xlt": "xls", ".ppt": "ppt", ".pot": "ppt", ".pps": "ppt",
    ".param": "param", ".log": "log", ".rlog": "rlog", ".tlog": "tlog", ".wps": "wps",
    ".py": "code_py", ".pyw": "code_py", ".sh": "code_sh", ".bash": "code_sh", ".js": "code_js", ".ts": "code_ts", ".jsx": "code_js", ".tsx": "code_ts",
    ".java": "code_java", ".c": "code_c", ".h": "code_c", ".cpp": "code_cpp", ".hpp": "code_cpp", ".cc": "code_cpp", ".cs": "code_cs", ".go": "code_go",
    ".rs": "code_rs", ".rb": "code_rb", ".php": "code_php", ".swift": "code_swift", ".kt": "code_kt", ".scala": "code_scala", ".m": "code_m", ".mm": "code_mm",
    ".r": "code_r", ".sql": "code_sql", ".yaml": "code_yaml", ".yml": "code_yaml", ".toml": "code_toml", ".ini": "code_ini", ".cfg": "code_ini", ".conf": "code_ini",
    ".xml": "code_xml", ".css": "code_css", ".scss": "code_css", ".less": "code_css", ".dockerfile": "code_dockerfile",
    ".exe": "exe", ".dll": "exe", ".sys": "exe", ".ocx": "exe", ".cpl": "exe", ".scr": "exe",
    ".zip": "archive_zip", ".jar": "archive_zip", ".war": "archive_zip", ".apk": "archive_zip", ".rar": "archive_rar", ".7z": "archive_7z",
    ".tar": "archive_tar", ".tgz": "archive_tar", ".tbz2": "archive_tar", ".txz": "archive_tar", ".gz": "archive_gz", ".bz2": "archive_gz", ".xz": "archive_gz",
}
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".tiff")

# The language of a code kind's fence.
FENCE_LANGUAGES = {
    "code_py": "python", "code_sh": "bash", "code_js": "javascript", "code_ts": "typescript", "code_java": "java", "code_c": "c", "code_cpp": "cpp",
    "code_cs": "csharp", "code_go": "go", "code_rs": "rust", "code_rb": "ruby", "code_php": "php", "code_swift": "swift", "code_kt": "kotlin",
    "code_scala": "scala", "code_m": "objectivec", "code_mm": "objectivec", "code_r": "r", "code_sql": "sql", "code_yaml": "yaml", "code_toml": "toml",
    "code_ini": "ini", "code_xml": "xml", "code_css": "css", "code_dockerfile": "dockerfile",
}

# What is never catalogued.
PURGED_DIRECTORIES = (
    "__pycache__", ".venv", "venv", "env", ".env-venv", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".ipynb_checkpoints",
    "node_modules", ".next", ".nuxt", ".turbo", ".parcel-cache", "build", "dist", "out", "target", "bin", "obj", ".gradle", ".maven",
    ".idea", ".vscode", ".vs", ".history", ".git", ".svn", ".hg", "$RECYCLE.BIN", "System Volume Information", ".Trash", ".Trashes", "$Recycle.Bin",
    "Temp", "temp", "tmp", ".cache",
)
PURGED_NAMES = (".DS_Store", "Thumbs.db", "desktop.ini", "ehthumbs.db", ".gitignore", ".gitkeep", ".gitattributes")
PURGED_SUFFIXES = (".pyc", ".pyo", ".class", ".o", ".obj", ".swp", ".swo", ".lock")

# Labels of kinds, states and hash algorithms in rendered output.
KIND_LABELS = {
    "pdf": "PDF", "docx": "Word", "txt": "纯文本", "csv": "CSV", "xlsx": "Excel", "json": "JSON", "markdown": "Markdown", "html": "HTML", "image": "图片",
    "param": "MissionPlanner 参数", "log": "通用日志", "rlog": "rlog 原始日志", "tlog": "MAVLink 遥测", "wps": "金山 WPS",
    "doc": "Word 97-2003", "xls": "Excel 97-2003", "ppt": "PowerPoint 97-2003",
    "code_py": "Python", "code_sh": "Shell", "code_js": "JavaScript", "code_ts": "TypeScript", "code_java": "Java", "code_c": "C", "code_cpp": "C++",
    "code_cs": "C#", "code_go": "Go", "code_rs": "Rust", "code_rb": "Ruby", "code_php": "PHP", "code_swift": "Swift", "code_kt": "Kotlin", "code_scala": "Scala",
    "code_m": "Objective-C", "code_mm": "Objective-C++", "code_r": "R", "code_sql": "SQL", "code_yaml": "YAML", "code_toml": "TOML", "code_ini": "INI",
    "code_xml": "XML", "code_css": "CSS", "code_dockerfile": "Dockerfile", "exe": "Windows PE",
    "archive_zip": "ZIP 压缩包", "archive_tar": "TAR 压缩包", "archive_7z": "7-Zip 压缩包", "archive_rar": "RAR 压缩包", "archive_gz": "Gzip 压缩包", "unsupported": "不支持",
}
STATUS_LABELS = {"success": "✅成功", "failed": "❌失败", "skipped": "🚫跳过"}
ALGO_LABELS = {"sha256": "SHA-256", "sha1": "SHA-1", "md5": "MD5"}


def choose(key: Column, values: Mapping[str, str], default: Column) -> Column:
    """``values[key]``, as a literal map inside the plan, else ``default``."""
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.coalesce(F.try_element_at(table, key), default)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The lower-cased last-dot suffix of a path's name (a name needs a stem before the dot), else empty."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def kind_of(ext: Column, images: tuple[str, ...] = IMAGE_EXTENSIONS) -> Column:
    return choose(ext, EXTENSION_KINDS, F.when(ext.isin(*images), "image").otherwise("unsupported"))


def size_class(size: Column) -> Column:
    """Five half-open classes of sizes."""
    out = F.when(size < 1024, "<1KB")
    for power, name in ((1 << 20, "1KB-1MB"), (10 << 20, "1MB-10MB"), (100 << 20, "10MB-100MB")):
        out = out.when(size < power, name)
    return out.when(size.isNotNull(), ">100MB")


def file_id(rel_path: Column) -> Column:
    """The displayed id: eight hex digits. Collisions are possible, so rows are keyed by ``file_key``."""
    return F.substring(F.sha1(rel_path), 1, 8)


def file_key(rel_path: Column) -> Column:
    return F.sha1(rel_path)


def purge_reason(rel_path: Column, dirs: tuple[str, ...] = PURGED_DIRECTORIES, names: tuple[str, ...] = PURGED_NAMES, suffixes: tuple[str, ...] = PURGED_SUFFIXES) -> Column:
    """Why a path is never catalogued: ``hidden``, ``dir``, ``name`` or ``suffix``; null if it is. Only parents count as directories."""
    parts = F.split(rel_path, "/")
    parents = F.slice(parts, F.lit(1), F.size(parts) - 1)
    junk = F.arrays_overlap(parents, F.array(*map(F.lit, dirs)))
    return (
        F.when(rel_path.rlike(r"(^|/)\."), "hidden")
        .when(junk, "dir")
        .when(base_name(rel_path).isin(*names), "name")
        .when(suffix(rel_path).isin(*suffixes), "suffix")
    )


def human_bytes(n: Column, style: str = "bundle") -> Column:
    """A size for people, in the three notations of the reports: ``bundle`` (1023 B), ``dup`` (1,023 B), ``image`` (two decimals from GB)."""
    grouped = F.format_string("%,d B", n) if style == "dup" else F.format_string("%d B", n)
    out = F.when(n < 1024, grouped)
    last = 3 if style == "image" else 4
    for i, unit in enumerate(("KB", "MB", "GB", "TB")[:last], start=1):
        value = n / F.lit(float(1024**i))
        if style == "image":
            digits = 2 if unit == "GB" else 1
            text = F.format_string(f"%.{digits}f {unit}", F.bround(value, digits))  # ties to even, as the notations were defined
        else:
            text = F.format_string(f"%,.1f {unit}", F.bround(value, 1))
        out = out.otherwise(text) if i == last else out.when(n < 1024 ** (i + 1), text)
    return F.when(n.isNotNull(), out)


def safe_name(name: Column) -> Column:
    """A file name of harmless characters, at most 100 of them."""
    return F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._\-+]+", "_"), 1, 100)


def table_cell(text: Column) -> Column:
    """A Markdown table cell: backslashes and pipes escaped, line breaks as spaces; null is empty."""
    escaped = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(escaped, "\r\n|\n|\r", " ")


def fenced(text: Column, language: Column) -> Column:
    return F.concat(F.lit("```"), language, F.lit("\n"), text, F.lit("\n```\n"))


def iso_seconds(at: Column, missing: str) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(missing))


def compact_metadata(size: Column, mtime: Column, ctime: Column, source: Column, digest: Column, algo: Column, skipped: Column, short: int = 16) -> Column:
    """One line of metadata; what is missing is left out."""
    day = "yyyy-MM-dd"
    born = F.when(source.isin("birthtime", "win_ctime"), F.concat(F.lit("b:"), F.date_format(ctime, day))).when(source == "status_ctime", F.concat(F.lit("*c:"), F.date_format(ctime, day)))
    mark = F.when(digest.isNotNull() & (digest != ""), F.concat(algo, F.lit(":"), F.substring(digest, 1, short))).when(skipped.isNotNull() & (skipped != ""), F.concat(algo, F.lit(":n/a")))
    return F.concat_ws(" · ", human_bytes(size), F.concat(F.lit("m:"), F.date_format(mtime, day)), born, mark)


def hex_preview(data: Column, per_line: int = 16) -> Column:
    """A hex dump of binary data: offset, bytes, printable characters."""
    n = F.octet_length(data)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(per_line))

    def line(at: Column) -> Column:
        part = F.substring(data, at + 1, F.lit(per_line))
        pairs = F.rtrim(F.regexp_replace(F.lower(F.hex(part)), "(..)", "$1 "))
        seen = F.regexp_replace(F.decode(part, "ISO-8859-1"), r"(?s)[^\x20-\x7E]", ".")
        return F.concat(F.lpad(F.lower(F.hex(at.cast("bigint"))), 8, "0"), F.lit("  "), F.rpad(pairs, per_line * 3 - 1, " "), F.lit("  |"), seen, F.lit("|"))

    return F.when(n > 0, F.concat(F.array_join(F.transform(starts, line), "\n"), F.lit("\n"))).when(n == 0, "(空)\n")
