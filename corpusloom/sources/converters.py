"""Kinds of files to Markdown. Every converter is a function of bytes; none raises: what fails is a row that says so.

Kinds whose text needs no parsing (``txt``, ``markdown``, code) stay inside the JVM while they are valid UTF-8; the rest is
read by Arrow functions. Kinds that need a service or library which isn't there (OCR, 7z, RAR) take a plug-in.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import lzma
import re
import struct
import tarfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.files import ALGO_LABELS, FENCE_LANGUAGES, fenced
from corpusloom.operators.truncation import shorten_log
from corpusloom.sources.pdf import page_texts

try:
    from charset_normalizer import from_bytes
except ImportError:  # the fixed chain below then decides alone
    from_bytes = None


@dataclass
class Result:
    status: str = "success"
    markdown: str = ""
    warnings: list[str] = field(default_factory=list)
    error: str | None = None
    skip_reason: str | None = None
    extra: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Options:
    csv_rows: int = 200
    log_bytes: int = 10 << 20
    log_head_ratio: float = 0.5
    scanned_chars_per_page: int = 50
    archive_entries: int = 5000
    sections: int = 32
    messages: int = 200_000
    image_bytes: int = 4 << 20


def decode(raw: bytes) -> tuple[str, str]:
    """Text and the encoding it was read with: UTF-8, else detected, else with replacement characters."""
    try:
        return raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        pass
    if from_bytes is not None and (best := from_bytes(raw).best()) is not None:
        return str(best), best.encoding or "unknown"
    for codec in ("gb18030",):
        try:
            return raw.decode(codec), codec
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace"), "utf-8(replace)"


def _recoded(encoding: str) -> list[str]:
    return [] if encoding in ("utf-8", "utf_8", "ascii") else [f"原文件编码非 UTF-8（探测为 {encoding}），已转码"]


def _closed(text: str) -> str:
    return text if text.endswith("\n") else text + "\n"


def hex_lines(data: bytes, per_line: int = 16) -> str:
    """Offset, bytes and printable characters of each line."""
    if not data:
        return "(空)\n"
    rows = []
    for at in range(0, len(data), per_line):
        part = data[at : at + per_line]
        rows.append(f"{at:08x}  {part.hex(' '):<{per_line * 3 - 1}}  |{''.join(chr(b) if 32 <= b < 127 else '.' for b in part)}|")
    return "\n".join(rows) + "\n"


def plain(raw: bytes, name: str, o: Options) -> Result:
    text, encoding = decode(raw)
    return Result(markdown=f"```text\n{text}\n```\n", warnings=_recoded(encoding), extra={"chars": len(text), "encoding": encoding})


def markdown(raw: bytes, name: str, o: Options) -> Result:
    text, encoding = decode(raw)
    return Result(markdown=_closed(text), extra={"chars": len(text), "encoding": encoding})


def code(language: str) -> Callable[[bytes, str, Options], Result]:
    def convert(raw: bytes, name: str, o: Options) -> Result:
        text, encoding = decode(raw)
        return Result(markdown=f"```{language}\n{text}\n```\n", warnings=_recoded(encoding), extra={"chars": len(text), "encoding": encoding, "lang": language})

    return convert


def json_text(raw: bytes, name: str, o: Options) -> Result:
    text, _ = decode(raw)
    warnings = []
    try:
        text = json.dumps(json.loads(text), ensure_ascii=False, indent=2)
    except json.JSONDecodeError as e:
        warnings = [f"JSON 解析失败（{e.msg} 行{e.lineno} 列{e.colno}），按文本原样输出"]
    return Result(markdown=f"```json\n{text}\n```\n", warnings=warnings, extra={"chars": len(text)})


def _cell(value: object) -> str:
    text = "" if value is None else str(value)
    return re.sub(r"\r\n|\n|\r", " ", text.replace("\\", "\\\\").replace("|", "\\|"))


def pipe_table(header: list[str], rows: list[list[str]]) -> str:
    if not rows:
        return "_（空表）_\n"
    lines = [header, ["---"] * len(header), *rows]
    return "".join("| " + " | ".join(_cell(v) if i != 1 else v for v in line) + " |\n" for i, line in enumerate(lines))


def _table(rows: list[list[str]], limit: int, what: str) -> tuple[str, int, int, list[str]]:
    """Markdown, row and column counts and warnings of a table with its header first."""
    header, body = (rows[0], rows[1:]) if rows else ([], [])
    shown = "全部展示" if len(body) <= limit else f"已截断到 {limit} 行"
    warnings = [f"{what} 行数 {len(body)} 超过上限 {limit}，已截断"] if len(body) > limit else []
    head = f"- 总行数: {len(body)}（{shown}）\n- 列数: {len(header)}\n\n"
    return head + pipe_table(header, body[:limit]), len(body), len(header), warnings


def csv_table(raw: bytes, name: str, o: Options) -> Result:
    """All cells as text. Rows with more cells than the header are skipped, with a warning; shorter ones are filled up."""
    warnings, text = [], ""
    for encoding in ("utf-8", "utf-8-sig", "gbk", "latin-1"):
        try:
            text = raw.decode(encoding)
        except UnicodeDecodeError:
            continue
        if encoding != "utf-8":
            warnings.append(f"CSV 用 {encoding} 编码读取（utf-8 失败）")
        break
    rows = [r for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")) if r]
    if not rows:
        return Result("failed", error="CSV 读取失败: EmptyDataError: no columns")
    width = len(rows[0])
    kept = [r + [""] * (width - len(r)) for r in rows if len(r) <= width]
    if len(kept) < len(rows):
        warnings.append("CSV 解析有坏行已跳过（ParserError）")
    table, n, columns, more = _table(kept, o.csv_rows, "CSV")
    return Result(markdown=table + "\n", warnings=warnings + more, extra={"chars": len(table), "rows": n, "truncated": bool(more), "cols": columns})


_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def xlsx_sheets(raw: bytes, name: str, o: Options) -> Result:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in names else {}
        parts, warnings, total, sheets = [], [], 0, 0
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = (links.get(sheet.get(f"{_R}id")) or f"worksheets/sheet{sheets + 1}.xml").lstrip("/")
            rows = []
            for row in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_S}row"):
                cells: dict[int, str] = {}
                for c in row.iter(f"{_S}c"):
                    letters = re.match(r"[A-Z]+", c.get("r") or "")
                    at = -1
                    for ch in letters[0] if letters else "":
                        at = (at + 1) * 26 + ord(ch) - 65
                    value = c.findtext(f"{_S}v")
                    if c.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    cells[at if letters else len(cells)] = value or ""
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            width = max(map(len, rows), default=0)
            table, n, _, more = _table([r + [""] * (width - len(r)) for r in rows], o.csv_rows, sheet.get("name") or "Sheet")
            parts.append(f"## Sheet: {sheet.get('name')}\n\n{table}\n")
            total, sheets, warnings = total + n, sheets + 1, warnings + more
    text = "".join(parts)
    return Result(markdown=text, warnings=warnings, extra={"chars": len(text), "sheets": sheets, "rows": total})


def docx_text(raw: bytes, name: str, o: Options) -> Result:
    """Headings 1 to 6, list items, paragraphs; tables where they stand."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def text(p: ET.Element) -> str:
        return "".join(t.text or "" if t.tag == f"{_W}t" else "\n" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}br"))

    parts = []
    for block in body if body is not None else ():
        if block.tag == f"{_W}p":
            style = block.find(f"{_W}pPr/{_W}pStyle")
            value = (style.get(f"{_W}val") if style is not None else "") or ""
            level = re.fullmatch(r"[Hh]eading\s?([1-6])", value)
            if said := text(block).strip():
                is_list = block.find(f"{_W}pPr/{_W}numPr") is not None or value.lower().startswith("list")
                parts.append("#" * int(level[1]) + " " + said if level else "- " + said if is_list else said)
        elif block.tag == f"{_W}tbl":
            rows = [[" ".join(text(p) for p in c.iter(f"{_W}p")) for c in r.iter(f"{_W}tc")] for r in block.iter(f"{_W}tr")]
            if rows:
                parts.append(pipe_table(rows[0], rows[1:] or [[""] * len(rows[0])]).rstrip("\n"))
    out = "\n\n".join(parts) + "\n"
    return Result(markdown=out, extra={"chars": len(out), "engine": "stdlib"})


class _Html(HTMLParser):
    _BLOCKS = {"p", "div", "section", "article", "header", "footer", "table", "ul", "ol", "blockquote", "pre", "main", "nav"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = self.pre = 0
        self.links: list[str | None] = []
        self.lists: list[list] = []

    def _line(self, n: int = 2) -> None:
        self.out.append("\n" * n)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "head"):
            self.silent += 1
        elif re.fullmatch("h[1-6]", tag):
            self._line()
            self.out.append("#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self._line(1 if len(self.lists) > 1 else 2)
        elif tag == "li":
            self._line(1)
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag == "br":
            self._line(1)
        elif tag == "tr":
            self._line(1)
            self.out.append("| ")
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "a":
            self.links.append(dict(attrs).get("href"))
            self.out.append("[" if self.links[-1] else "")
        elif tag == "img":
            a = dict(attrs)
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag in self._BLOCKS:
            self._line()

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head"):
            self.silent = max(0, self.silent - 1)
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.out.append(f"]({href})" if href else "")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag in ("ul", "ol"):
            self.lists = self.lists[:-1]
            self._line()
        elif tag in self._BLOCKS or re.fullmatch("h[1-6]", tag):
            self._line()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_markdown(text: str) -> str:
    parser = _Html()
    parser.feed(text)
    parser.close()
    out = re.sub(r"[ \t]+\n", "\n", "".join(parser.out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n +(?=[^-\s\d])", "\n", out)).strip() + "\n"


def html(raw: bytes, name: str, o: Options) -> Result:
    out = html_markdown(decode(raw)[0])
    return Result(markdown=out, extra={"chars": len(out)})


def parameters(text: str) -> list[tuple[str, str]]:
    """Names and values: split at the first comma, else at white space. Comments, blanks and single words are no parameters."""
    found = []
    for line in map(str.strip, re.split(r"\r\n|\n|\r", text)):
        if not line or line.startswith("#"):
            continue
        parts = line.split(",", 1) if "," in line else line.split(None, 1)
        if len(parts) == 2 and parts[0].strip():
            found.append((parts[0].strip(), parts[1].strip()))
    return found


def param(raw: bytes, name: str, o: Options) -> Result:
    text, encoding = decode(raw)
    rows = parameters(text)
    lines = re.split(r"\r\n|\n|\r", text)
    n_lines = len(lines) - (lines[-1] == "")
    comments = sum(x.lstrip().startswith("#") for x in lines)
    table = "| 参数 | 值 |\n| --- | --- |\n" + "".join(f"| {a.replace('|', '\\|')} | {b.replace('|', '\\|')} |\n" for a, b in rows) if rows else "_（未解析到参数行）_\n"
    head = f"**MissionPlanner / ArduPilot 参数备份**\n\n- 总行数: {n_lines}\n- 解析到参数: {len(rows)}\n- 注释行: {comments}\n- 文件编码: {encoding}\n\n"
    out = f"{head}### 参数表\n\n{table}\n### 原文\n\n```text\n{_closed(text)}```\n"
    return Result(markdown=out, warnings=_recoded(encoding), extra={"chars": len(text), "encoding": encoding, "param_count": len(rows), "comment_lines": comments})


def looks_binary(raw: bytes) -> bool:
    """By its first 4096 bytes: a NUL, or less than seven tenths of printable characters; valid UTF-8 beyond ASCII counts as text."""
    head = raw[:4096]
    if not head or b"\0" in head:
        return bool(head)
    try:
        text = head.decode("utf-8")
    except UnicodeDecodeError as e:
        text = head[: e.start].decode("utf-8") if len(head) - e.start < 4 else head.decode("latin-1")
        if len(head) - e.start >= 4:
            return sum(c in "\t\n\r" or " " <= c < "\x7f" for c in text) < 0.7 * len(text)
    return sum(c in "\t\n\r" or c.isprintable() for c in text) < 0.7 * len(text)


def log(raw: bytes, name: str, o: Options) -> Result:
    cut = shorten_log(raw, o.log_bytes, o.log_head_ratio)
    warnings = ["内容疑似二进制，按文本解码"] if looks_binary(raw) else []
    text, encoding = (cut.content.decode("utf-8", "replace"), "utf-8(replace)") if warnings else decode(cut.content)
    head = f"**通用文本日志**\n\n- 原始大小: {len(raw):,} bytes\n- 文件编码: {encoding}\n- 截断: {'是' if cut.truncated else '否'}\n"
    if cut.truncated:
        warnings.append(f"已截断: 原始 {len(raw):,} → 保留 {cut.kept_bytes:,} 字节")
        head += f"- 头部保留: {cut.head_bytes:,} bytes\n- 尾部保留: {cut.tail_bytes:,} bytes\n- 中间舍弃: {len(raw) - cut.kept_bytes:,} bytes\n"
    extra = {"chars": len(text), "encoding": encoding, "original_bytes": len(raw), "truncated": cut.truncated, "kept_bytes": cut.kept_bytes, "head_bytes": cut.head_bytes, "tail_bytes": cut.tail_bytes, "skipped_bytes": len(raw) - cut.kept_bytes}
    return Result(markdown=f"{head}\n```log\n{_closed(text)}```\n", warnings=warnings, extra=extra)


def _binary(title: str, raw: bytes, extra: dict, lines: list[str] = (), head: int = 256, tail: int = 256) -> Result:
    sha1 = hashlib.sha1(raw).hexdigest()
    out = f"**{title}**\n\n- 文件大小: {len(raw):,} bytes\n- SHA-1: `{sha1}`\n" + "".join(f"- {x}\n" for x in lines)
    out += f"\n### 头部 hex（前 {min(head, len(raw))} bytes）\n\n```\n{hex_lines(raw[:head])}```\n"
    if len(raw) > head + tail:
        out += f"\n### 尾部 hex（最后 {tail} bytes）\n\n```\n{hex_lines(raw[-tail:])}```\n"
    return Result(markdown=out, extra={"original_bytes": len(raw), "sha1": sha1} | extra)


def rlog(raw: bytes, name: str, o: Options) -> Result:
    if looks_binary(raw):
        return _binary("rlog 二进制日志", raw, {"is_binary": True})
    got = log(raw, name, o)
    got.extra["is_binary"] = False
    return got


def mavlink_frames(raw: bytes, limit: int) -> Iterator[tuple[int, int]]:
    """(microseconds, message id) of the framed messages of a telemetry log, versions 1 and 2; stops at ``limit``."""
    at = n = 0
    while at + 16 <= len(raw) and n < limit:
        when, mark = struct.unpack_from(">QB", raw, at)
        if mark == 0xFE:
            yield when, raw[at + 8 + 5]
            at += 8 + 8 + raw[at + 9]
        elif mark == 0xFD and at + 18 <= len(raw):
            yield when, int.from_bytes(raw[at + 15 : at + 18], "little")
            at += 8 + 12 + raw[at + 9] + (13 if raw[at + 10] & 1 else 0)
        else:
            at += 1
            continue
        n += 1


def tlog(raw: bytes, name: str, o: Options) -> Result:
    """Counts by message id, most frequent first (ties by first sight), and the span in file order."""
    seen: dict[int, int] = {}
    first = last = None
    for when, message in mavlink_frames(raw, o.messages):
        seen[message] = seen.get(message, 0) + 1
        first, last = when if first is None else first, when
    if not seen:
        return _binary("MAVLink 遥测日志", raw, {"engine": "none"})
    n = sum(seen.values())
    seconds = (last - first) / 1e6
    rows = sorted(seen.items(), key=lambda x: -x[1])
    out = f"**MAVLink 遥测日志**\n\n- 消息数: {n:,}\n- 时长: {seconds:.1f} s\n\n| 消息 | 数量 |\n| --- | ---: |\n" + "".join(f"| {m} | {c:,} |\n" for m, c in rows)
    return Result(markdown=out, extra={"engine": "frames", "messages_parsed": n, "messages_capped": n >= o.messages, "message_types": len(rows), "duration_seconds": seconds})


# Names of machines, subsystems and characteristics in executables.
MACHINES = {
    0x0: "UNKNOWN", 0x14C: "x86 (i386)", 0x162: "MIPS R3000", 0x166: "MIPS R4000", 0x168: "MIPS R10000", 0x169: "MIPS WCE v2", 0x184: "Alpha", 0x1A2: "SH3",
    0x1A3: "SH3DSP", 0x1A6: "SH4", 0x1A8: "SH5", 0x1C0: "ARM", 0x1C2: "ARM Thumb", 0x1C4: "ARMv7 Thumb-2", 0x1D3: "AM33", 0x1F0: "PowerPC", 0x1F1: "PowerPC FP",
    0x200: "IA64 (Itanium)", 0x266: "MIPS16", 0x284: "Alpha 64", 0x366: "MIPS w/FPU", 0x466: "MIPS16 w/FPU", 0xEBC: "EFI Byte Code", 0x8664: "x64 (AMD64)",
    0x9041: "M32R", 0xAA64: "ARM64", 0xC0EE: "CLR Pure MSIL",
}
SUBSYSTEMS = {
    0: "UNKNOWN", 1: "NATIVE (driver)", 2: "WINDOWS_GUI", 3: "WINDOWS_CUI (console)", 5: "OS2_CUI", 7: "POSIX_CUI", 8: "NATIVE_WINDOWS", 9: "WINDOWS_CE_GUI",
    10: "EFI_APPLICATION", 11: "EFI_BOOT_SERVICE_DRIVER", 12: "EFI_RUNTIME_DRIVER", 13: "EFI_ROM", 14: "XBOX", 16: "WINDOWS_BOOT_APPLICATION",
}
CHARACTERISTICS = {
    0x1: "RELOCS_STRIPPED", 0x2: "EXECUTABLE_IMAGE", 0x4: "LINE_NUMS_STRIPPED", 0x8: "LOCAL_SYMS_STRIPPED", 0x20: "LARGE_ADDRESS_AWARE", 0x100: "32BIT_MACHINE",
    0x200: "DEBUG_STRIPPED", 0x2000: "DLL", 0x4000: "UP_SYSTEM_ONLY",
}


def pe_header(raw: bytes, sections: int = 32) -> tuple[dict, list[str]]:
    """What an executable's headers say, and warnings about what is missing. ``magic`` is absent only below 64 bytes."""
    if len(raw) < 64:
        return {}, ["文件长度不足，无法包含 DOS 头"]
    if raw[:2] != b"MZ":
        return {"magic": f"非 MZ 魔数（实际 {raw[:2].hex()}），不是 PE 文件"}, []
    (at,) = struct.unpack_from("<I", raw, 60)
    info: dict = {"magic": "MZ", "e_lfanew": at}
    if at + 24 > len(raw):
        return info, [f"e_lfanew=0x{at:x} 指向越界位置，无法读取 PE 头"]
    if raw[at : at + 4] != b"PE\0\0":
        return info, [f"PE 签名不正确（实际 {raw[at : at + 4].hex()}）"]
    machine, count, stamp, _, _, optional, flags = struct.unpack_from("<2H3I2H", raw, at + 4)
    info |= {"machine_raw": machine, "machine": MACHINES.get(machine, f"0x{machine:04x}"), "num_sections": count, "timestamp_unix": stamp, "characteristics_raw": flags}
    info["characteristics"] = ", ".join(name for bit, name in CHARACTERISTICS.items() if flags & bit) or "(无)"
    head, warnings = at + 24, []
    if optional and head + 70 <= len(raw):
        (magic,) = struct.unpack_from("<H", raw, head)
        info["pe_format"] = {0x10B: "PE32", 0x20B: "PE32+ (64-bit)"}.get(magic, f"未知 (0x{magic:x})")
        if magic in (0x10B, 0x20B):
            info["linker_version"] = f"{raw[head + 2]}.{raw[head + 3]}"
            info["size_of_code"], info["entry_point_rva"] = struct.unpack_from("<I", raw, head + 4)[0], struct.unpack_from("<I", raw, head + 16)[0]
            (system,) = struct.unpack_from("<H", raw, head + 68)
            info["subsystem"] = SUBSYSTEMS.get(system, f"0x{system:04x}")
    info["sections"] = []
    for i in range(min(count, sections)):
        row = raw[head + optional + 40 * i : head + optional + 40 * (i + 1)]
        if len(row) < 40:
            warnings.append(f"节表第 {i} 项被截断")
            break
        vsize, vaddr, rsize, raddr = struct.unpack_from("<4I", row, 8)
        info["sections"].append({"name": row[:8].rstrip(b"\0").decode("ascii", "replace"), "vsize": vsize, "vaddr": vaddr, "rsize": rsize, "raddr": raddr})
    return info, warnings


def exe(raw: bytes, name: str, o: Options) -> Result:
    info, warnings = pe_header(raw[:8192], o.sections)
    lines = [f"DOS magic: `{info.get('magic', '?')}`"]
    if "machine" in info:
        stamp = datetime.fromtimestamp(info["timestamp_unix"], UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        lines += [f"架构: **{info['machine']}**（raw=0x{info['machine_raw']:04x}）", f"编译时间戳: {info['timestamp_unix']} → {stamp}", f"PE 格式: {info.get('pe_format', '?')}"]
        lines += [f"链接器版本: {info['linker_version']}", f"Subsystem: {info['subsystem']}", f"入口点 RVA: 0x{info['entry_point_rva']:x}"] if "subsystem" in info else []
        lines += [f"特征位 (0x{info['characteristics_raw']:04x}): {info['characteristics']}", f"节数量: {info['num_sections']}"]
    extra = {k: info.get(k, v) for k, v in (("machine", ""), ("pe_format", ""), ("subsystem", ""), ("num_sections", 0), ("timestamp_unix", 0))}
    got = _binary("Windows PE 可执行文件（仅头部元信息）", raw, extra, lines, tail=512)
    if info.get("sections"):
        rows = "".join(f"| {i} | `{s['name']}` | {s['vsize']:,} | 0x{s['vaddr']:x} | {s['rsize']:,} | 0x{s['raddr']:x} |\n" for i, s in enumerate(info["sections"], 1))
        got.markdown = got.markdown.replace("\n### 头部 hex", f"\n### 节表\n\n| # | 名称 | VirtualSize | VirtualAddr | RawSize | RawAddr |\n|---|------|-------------|-------------|---------|--------|\n{rows}\n### 头部 hex", 1)
    got.warnings = warnings
    return got


def archive_entries(raw: bytes, kind: str, name: str, limit: int) -> tuple[list[dict], list[str]]:
    """``name, size, csize, crc, mtime`` of an archive's files (absent where its format has none), and warnings."""
    low = name.lower()
    is_tar = kind == "archive_tar" or low.endswith((".tar.gz", ".tar.bz2", ".tar.xz"))
    try:
        if kind == "archive_zip":
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                return [{"name": i.filename, "size": i.file_size, "csize": i.compress_size, "crc": i.CRC, "mtime": "{}-{:02}-{:02}T{:02}:{:02}:{:02}".format(*i.date_time)} for i in z.infolist()[:limit]], []
        if is_tar:
            found = []
            with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as t:
                for m in t:
                    if len(found) >= limit:
                        break
                    found.append({"name": m.name, "size": m.size, "mtime": datetime.fromtimestamp(m.mtime, UTC).strftime("%Y-%m-%dT%H:%M:%S")})
            return found, []
        if kind == "archive_gz" and raw[:2] == b"\x1f\x8b" and len(raw) >= 18:
            flags, stamp = raw[3], struct.unpack_from("<I", raw, 4)[0]
            at = 10 + (2 + int.from_bytes(raw[10:12], "little") if flags & 4 else 0)
            inner = raw[at : raw.index(b"\0", at)].decode("latin-1") if flags & 8 else re.sub(r"(?i)\.gz$", "", name)
            return [{"name": inner, "size": struct.unpack_from("<I", raw, len(raw) - 4)[0], "mtime": datetime.fromtimestamp(stamp, UTC).strftime("%Y-%m-%dT%H:%M:%S") if stamp else ""}], []
        return [], [f"无法列出此格式的内容: {kind}"]
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, ValueError, lzma.LZMAError, struct.error) as e:
        return [], [f"{type(e).__name__}: {e}"]


def archive(kind: str) -> Callable[[bytes, str, Options], Result]:
    label = {"archive_zip": "ZIP", "archive_tar": "TAR", "archive_7z": "7-Zip", "archive_rar": "RAR", "archive_gz": "Gzip"}[kind]

    def convert(raw: bytes, name: str, o: Options) -> Result:
        entries, warnings = archive_entries(raw, kind, name, o.archive_entries)
        capped = len(entries) >= o.archive_entries
        lines = [f"内含条目数: {len(entries)}" + (f" *（达到上限 {o.archive_entries:,}，未列完）*" if capped else "")]
        if whole := sum(e["size"] for e in entries):
            lines.append(f"解压后总大小: {whole:,} bytes（压缩比 ≈ {len(raw) / whole * 100:.1f}%）")
        got = _binary(f"{label} 压缩包（仅文件列表 + 头尾 hex）", raw, {"archive_type": label, "entries_count": len(entries), "entries_capped": capped}, lines)
        has_crc = any("crc" in e for e in entries)
        columns = ["#", "路径", "size_bytes", *(["compressed", "CRC32"] if has_crc else []), "mtime"]
        rows = [[str(i), f"`{e['name']}`", f"{e['size']:,}", *([f"{e['csize']:,}", f"{e['crc']:08x}"] if has_crc else []), e["mtime"]] for i, e in enumerate(entries, 1)]
        listing = f"### 内含文件列表\n\n{pipe_table(columns, rows)}" if rows else "_（未能列出条目，可能是未安装可选依赖或文件损坏）_\n"
        got.markdown = got.markdown.replace("\n### 头部 hex", f"\n{listing}\n### 头部 hex", 1)
        got.warnings = warnings
        return got

    return convert


def printable_runs(data: bytes) -> str:
    """Runs of four or more printable characters: ASCII, and UTF-16-LE with Chinese."""
    ascii_runs = [m.decode("ascii") for m in re.findall(rb"[\t\n\r\x20-\x7e]{4,}", data)]
    wide = [m.strip() for m in re.findall(r"[ -~一-鿿　-〿＀-￯\s]{4,}", data.decode("utf-16-le", "replace"))]
    parts = [("ASCII", ascii_runs), ("UTF-16-LE", [w for w in wide if w])]
    return "\n\n".join(f"# {label}\n" + "\n".join(runs) for label, runs in parts if runs)


def office_runs(raw: bytes, name: str, o: Options) -> Result:
    """Old binary Office and WPS files: a zip is read as docx, else the printable runs are kept."""
    if raw[:4] == b"PK\x03\x04":
        got = docx_text(raw, name, o)
        got.extra["wps_format"] = "zip"
        return got
    if raw[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
        return Result("failed", error="unknown format", extra={"wps_format": "unknown"})
    text = printable_runs(raw)
    return Result(markdown=f"```text\n{text}\n```\n", warnings=["仅抽取可打印字串，格式信息丢失"], extra={"engine": "runs", "wps_format": "ole", "chars": len(text)})


def is_scanned(chars: int, pages: int, least: int = 50) -> bool:
    """Whether a PDF has so little text a page that it must be a scan."""
    return pages > 0 and chars / pages < least


def pdf(raw: bytes, name: str, o: Options) -> Result:
    """Text page by page; a file of pages that hardly have any counts as scanned."""
    texts = [t.strip() for t in page_texts(raw)]
    chars = len("\n\n".join(texts).strip())
    scanned = is_scanned(chars, len(texts), o.scanned_chars_per_page)
    warnings = [f"图片型 PDF 嫌疑：平均每页字符数 {chars / len(texts):.1f} < 阈值 {o.scanned_chars_per_page}"] if scanned else []
    notice = "> ⚠️ **警告：检测到此 PDF 可能为扫描件/图片型 PDF**\n> 自动文本提取可能不完整或为空。建议使用 OCR 工具后再转换。\n\n" if scanned else ""
    pages = "".join(f"### Page {i}\n\n{t or '_（本页未提取到文本）_'}\n\n" for i, t in enumerate(texts, 1))
    out = f"{notice}- 页数: {len(texts)}\n- 提取字符数: {chars}\n\n{pages}"
    return Result(markdown=out, warnings=warnings, extra={"chars": chars, "pages": len(texts), "is_scanned_pdf": scanned})


def skipped(reason: str) -> Callable[[bytes, str, Options], Result]:
    return lambda raw, name, o: Result("skipped", markdown=f"> {reason}\n", skip_reason=reason)


Converter = Callable[[bytes, str, Options], Result]

CONVERTERS: dict[str, Converter] = {
    "txt": plain, "markdown": markdown, "json": json_text, "csv": csv_table, "xlsx": xlsx_sheets, "docx": docx_text, "html": html, "param": param,
    "log": log, "rlog": rlog, "tlog": tlog, "wps": office_runs, "doc": office_runs, "xls": office_runs, "ppt": office_runs, "exe": exe,
    "pdf": pdf, "image": skipped("OCR is not enabled"), "unsupported": skipped("unsupported file kind"),
} | {k: code(v) for k, v in FENCE_LANGUAGES.items()} | {k: archive(k) for k in ("archive_zip", "archive_tar", "archive_7z", "archive_rar", "archive_gz")}


def convert_bytes(kind: str, raw: bytes | None, name: str, options: Options = Options(), plugins: dict[str, Converter] | None = None) -> Result:
    """One file to Markdown; whatever a converter raises becomes a failed result."""
    if raw is None:
        return Result("failed", error="read_error")
    try:
        return ((plugins or {}).get(kind) or CONVERTERS.get(kind) or CONVERTERS["unsupported"])(raw, name, options)
    except Exception as e:  # noqa: BLE001 - one file must not end the run
        return Result("failed", error=f"{type(e).__name__}: {e}")


_NATIVE = {"txt": "text", **FENCE_LANGUAGES}
_FIELDS = [("status", pa.string()), ("markdown", pa.string()), ("warnings", pa.list_(pa.string())), ("error", pa.string()), ("skip_reason", pa.string()), ("extra", pa.string())]


def convert_files(files: DataFrame, key: str, kind: str, content: str, name: str, options: Options = Options(), plugins: dict[str, Converter] | None = None, reason: str | None = None) -> DataFrame:
    """``key, status, markdown, warnings, error, skip_reason, extra`` (JSON) of every file. ``content`` is binary; where it
    is null the row fails with the column ``reason``."""
    if plugins is None:
        plugins = {}
    native = F.col(kind).isin(*[k for k in (*_NATIVE, "markdown") if k not in plugins]) & F.is_valid_utf8(F.col(content).cast("string"))
    native = F.coalesce(native, F.lit(False))
    text = F.col(content).cast("string")
    from corpusloom.functions.files import choose

    body = F.when(F.col(kind) == "markdown", F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))).otherwise(fenced(text, choose(F.col(kind), _NATIVE, F.lit("text"))))
    language = F.when(F.col(kind).startswith("code_"), choose(F.col(kind), FENCE_LANGUAGES, F.lit("text")))
    extra = F.to_json(F.struct(F.length(text).alias("chars"), F.lit("utf-8").alias("encoding"), language.alias("lang")))
    none = F.lit(None).cast("string")
    kept = files.where(native).select(key, F.lit("success").alias("status"), body.alias("markdown"), F.array().cast("array<string>").alias("warnings"), none.alias("error"), none.alias("skip_reason"), extra.alias("extra"))
    key_type = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [convert_bytes(k or "unsupported", c.as_py(), n or "", options, plugins) for k, c, n in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist())]
            for r, c, why in zip(got, batch.column(2), batch.column(4).to_pylist()):
                if not c.is_valid:
                    r.error = why or "read_error"
            rows = [(r.status, r.markdown, r.warnings, r.error, r.skip_reason, json.dumps(r.extra, ensure_ascii=False, default=str)) for r in got]
            cols = list(zip(*rows)) or [[]] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS))], [key, *(n for n, _ in _FIELDS)])

    why = F.col(reason) if reason else F.lit(None).cast("string")
    rest = files.where(~native).select(key, kind, content, name, why.alias("_reason"))
    return kept.unionByName(rest.mapInArrow(run, f"`{key}` {key_type}, status string, markdown string, warnings array<string>, error string, skip_reason string, extra string"))


def algo_label(algo: str | None) -> str:
    return ALGO_LABELS.get(algo, algo.upper()) if algo else "HASH"


