"""Small files of every kind, built from their formats, and what they convert to: the query ``converted_kinds`` and its SQL.

The expected Markdown is written out here by hand, from the formats, and not taken from the converters; long dumps stand in for
by their marks.
"""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.converters import Options, convert_files

_SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'
_BOOK = (
    '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
    '<sheets><sheet name="Bench" sheetId="1" r:id="rId1"/></sheets></workbook>'
)
_LINKS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>'
_ROWS = '<row><c r="A1" t="inlineStr"><is><t>part</t></is></c><c r="B1" t="inlineStr"><is><t>mm</t></is></c></row><row><c r="A2" t="inlineStr"><is><t>bolt</t></is></c><c r="B2"><v>24</v></c></row>'
_WORD = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'
_WORDS = (
    '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Mast</w:t></w:r></w:p><w:p><w:r><w:t>Check it.</w:t></w:r></w:p>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
)


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (2024, 5, 6, 7, 8, 10)), text)
    return out.getvalue()


def _tar() -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        info = tarfile.TarInfo("log/a.txt")
        info.size, info.mtime = 5, 86_400
        t.addfile(info, io.BytesIO(b"hello"))
    return out.getvalue()


def _gz() -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile("notes.txt", "wb", fileobj=out, mtime=86_400) as g:
        g.write(b"hello")
    return out.getvalue()


def _exe() -> bytes:
    raw = bytearray(b"MZ" + bytes(58) + struct.pack("<I", 64))
    raw += b"PE\0\0" + struct.pack("<2H3I2H", 0x8664, 1, 86_400, 0, 0, 112, 0x22)
    raw += struct.pack("<HBB3II", 0x20B, 14, 2, 512, 0, 0, 0x1000) + bytes(48) + struct.pack("<H", 3) + bytes(42)
    return bytes(raw + b".text\0\0\0" + struct.pack("<4I", 300, 0x1000, 512, 0x200) + bytes(16))


def _tlog() -> bytes:
    def frame(at: int, message: int, payload: bytes) -> bytes:
        return struct.pack(">Q", at) + bytes([0xFE, len(payload), 0, 1, 1, message]) + payload + b"\0\0"

    return frame(1_000_000, 0, b"123456789") + frame(2_000_000, 30, b"xyz") + frame(3_500_000, 0, b"123456789")


#: kind, name, bytes, and what the Markdown must be (or contain, for kinds with a hex dump).
FILES: list[tuple[str, str, bytes, str]] = [
    ("csv", "a.csv", b"part,note\nbolt,a|b\nnut\n", "- 总行数: 2（全部展示）\n- 列数: 2\n\n| part | note |\n| --- | --- |\n| bolt | a\\|b |\n| nut |  |\n\n"),
    ("json", "a.json", b'{"a":[1,"\xc3\xa9"]}', '```json\n{\n  "a": [\n    1,\n    "é"\n  ]\n}\n```\n'),
    ("html", "a.html", b"<h1>Mast</h1><p>Check <b>it</b>.</p><ul><li>one</li><li>two</li></ul><script>x()</script>", "# Mast\n\nCheck **it**.\n\n- one\n- two\n"),
    ("param", "a.param", b"# saved\nRC1_MIN,1100\nFS_THR 2\nalone\n", "| 参数 | 值 |\n| --- | --- |\n| RC1_MIN | 1100 |\n| FS_THR | 2 |\n"),
    ("log", "a.log", b"start\nend\n", "**通用文本日志**\n\n- 原始大小: 10 bytes\n- 文件编码: utf-8\n- 截断: 否\n\n```log\nstart\nend\n```\n"),
    ("rlog", "a.rlog", b"\0\1\2", "**rlog 二进制日志**\n\n- 文件大小: 3 bytes\n"),
    ("tlog", "a.tlog", _tlog(), "- 消息数: 3\n- 时长: 2.5 s\n\n| 消息 | 数量 |\n| --- | ---: |\n| 0 | 2 |\n| 30 | 1 |\n"),
    ("xlsx", "a.xlsx", _zip({"xl/workbook.xml": _BOOK, "xl/_rels/workbook.xml.rels": _LINKS, "xl/worksheets/sheet1.xml": _SHEET.format(_ROWS)}), "## Sheet: Bench\n\n- 总行数: 1（全部展示）\n- 列数: 2\n\n| part | mm |\n| --- | --- |\n| bolt | 24 |\n\n"),
    ("docx", "a.docx", _zip({"word/document.xml": _WORD.format(_WORDS)}), "## Mast\n\nCheck it.\n\n| a |\n| --- |\n| 1 |\n"),
    ("archive_zip", "a.zip", _zip({"b/c.txt": "hello"}), "| 1 | `b/c.txt` | 5 | 5 | 3610a686 | 2024-05-06T07:08:10 |\n"),
    ("archive_tar", "a.tar", _tar(), "| 1 | `log/a.txt` | 5 | 1970-01-02T00:00:00 |\n"),
    ("archive_gz", "notes.txt.gz", _gz(), "| 1 | `notes.txt` | 5 | 1970-01-02T00:00:00 |\n"),
    ("exe", "a.exe", _exe(), "- 架构: **x64 (AMD64)**（raw=0x8664）\n- 编译时间戳: 86400 → 1970-01-02T00:00:00Z\n- PE 格式: PE32+ (64-bit)\n- 链接器版本: 14.2\n- Subsystem: WINDOWS_CUI (console)\n"),
    ("code_py", "a.py", b"x = 1", "```python\nx = 1\n```\n"),
    ("markdown", "a.md", b"# x", "# x\n"),
    ("wps", "a.wps", b"neither zip nor ole", ""),
    ("unsupported", "a.xyz", b"?", "> unsupported file kind\n"),
]
#: Kinds whose Markdown is compared as a whole; of the others, the part that does not depend on a dump of the bytes.
WHOLE = ("csv", "json", "html", "log", "xlsx", "docx", "code_py", "markdown", "wps", "unsupported")


def converted_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kind, status, markdown``: every fixture through the converters; of kinds with a dump, the part that is expected, or null."""
    files = spark.createDataFrame([(n, k, raw, want) for k, n, raw, want in FILES], "name string, kind string, content binary, want string")
    done = convert_files(files, "name", "kind", "content", "name", Options()).join(files.select("name", "kind", "want"), "name")
    part = F.when(F.col("kind").isin(*WHOLE), F.col("markdown")).when(F.contains("markdown", "want"), F.col("want"))
    return done.select("kind", "status", part.alias("markdown"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL = "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(k)}, {_quoted('failed' if k == 'wps' else 'skipped' if k == 'unsupported' else 'success')}, {_quoted(want)})" for k, _, _, want in FILES) + ") AS t(kind, status, markdown)"
