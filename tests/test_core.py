import hashlib
import io
import json
import os
import random
import re
import struct
import tarfile
import zipfile
import zlib
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import files as X
from corpusloom.functions.paths import canonical_path
from corpusloom.operators import duplicates, eligibility, incremental, ordering, truncation, volumes
from corpusloom.session import shared_dir
from corpusloom.sources import converters as C


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# -- expressions ----------------------------------------------------------------------------------------------------------


def test_suffix_and_kind(spark):
    cases = {"a/x.CSV": ("csv", ".csv"), "a.tar.gz": ("archive_gz", ".gz"), "Dockerfile": ("unsupported", ""), "p.tif": ("unsupported", ".tif"), "i.PNG": ("image", ".png"), ".env": ("unsupported", ""), "a.b/c": ("unsupported", "")}
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", X.suffix(F.col("p")).alias("e"))
    got = {r.p: (r.k, r.e) for r in df.select("p", "e", X.kind_of(F.col("e")).alias("k")).collect()}
    assert got == cases


def test_size_class_edges(spark):
    df = spark.createDataFrame([(1023,), (1024,), (1 << 20,), (10 << 20,), (100 << 20,), (None,)], "n bigint").select(X.size_class(F.col("n")).alias("c"))
    assert [r.c for r in df.collect()] == ["<1KB", "1KB-1MB", "1MB-10MB", "10MB-100MB", ">100MB", None]


def test_purge(spark):
    cases = {".hid/z.txt": "hidden", "build/w.txt": "dir", "Thumbs.db": "name", "m.pyc": "suffix", "build": None, "_under.txt": None, "a/out/x/y": "dir"}
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", X.purge_reason(F.col("p")).alias("why"))
    assert {r.p: r.why for r in df.collect()} == cases


def test_human_bytes(spark):
    got = spark.createDataFrame([(1023,), (11520,), (5 << 30,)], "n bigint").select(*(X.human_bytes(F.col("n"), s).alias(s) for s in ("bundle", "dup", "image"))).collect()
    assert [tuple(r) for r in got] == [("1023 B", "1,023 B", "1023 B"), ("11.2 KB",) * 3, ("5.0 GB", "5.0 GB", "5.00 GB")]


def test_hex_preview_equals_the_converters(spark):
    data = bytes(range(40))
    assert one(spark, X.hex_preview(F.lit(data))) == C.hex_lines(data)


def test_canonical_path(spark):
    cases = {"a\\b//c": "a/b/c", "./x/./y": "x/y", "/r/": "r", "données/x": "données/x", "A/b": "A/b", "": ""}
    df = spark.createDataFrame([(p,) for p in [*cases, None]], "p string").select("p", canonical_path(F.col("p")).alias("c"))
    assert {r.p: r.c for r in df.collect()} == cases | {None: None}


# -- eligibility --------------------------------------------------------------------------------------------------------------


def test_rules_and_reasons(spark):
    E = eligibility
    df = spark.createDataFrame([("a", ".txt", "txt", 0, None), ("b", ".bin", "unsupported", 3 << 20, datetime(2020, 1, 1)), ("c", ".log", "log", 1 << 20, datetime(2024, 1, 1))], "i string, ext string, kind string, n bigint, mtime timestamp_ntz")
    rules = E.Rules({".log": E.SizeRule(1, 1)}, {}, E.SizeRule(-1, 0))
    ext = E.ExtensionRule(exclude_exts=frozenset({".bin"}), include_exts=frozenset({".bin", ".txt", ".log"}))
    got = E.with_eligibility(df, {"ext_filter": ext.failure(F.col("ext"), F.col("kind")), "size_filter": E.size_failure(F.col("n"), F.col("ext"), F.col("kind"), rules), "mtime_filter": E.time_failure(F.col("mtime"), datetime(2021, 1, 1), datetime(2024, 1, 1))})
    by = {r.i: (r.eligible, [x.split(":")[0] for x in r.eligibility_reasons]) for r in got.collect()}
    assert by == {"a": (True, []), "b": (False, ["ext_filter", "size_filter", "mtime_filter"]), "c": (True, [])}
    assert rows(E.reject_breakdown(got)) == [("ext_filter", 1), ("mtime_filter", 1), ("size_filter", 1)]


def test_dates():
    assert eligibility.parse_date("2024/05/06") == eligibility.parse_date("2024-05-06T00:00:00")
    with pytest.raises(ValueError):
        eligibility.parse_date("06.05.2024")


# -- duplicates -----------------------------------------------------------------------------------------------------------------


def test_duplicates(spark):
    df = spark.createDataFrame([("B.txt", b"x", 1), ("a.txt", b"x", 1), ("c", b"y", 1), ("d", None, 0), ("e", b"", 0), ("f", b"", 0)], "rel_path string, content binary, size_bytes bigint")
    h = duplicates.with_hash(df, F.col("content"), F.col("size_bytes"))
    assert rows(duplicates.duplicate_groups(h), "main_path", "files", "redundant_bytes") == [("a.txt", 2, 1), ("e", 2, 0)]
    assert {(r.rel_path, r.role) for r in duplicates.duplicate_roles(h).collect()} == {("a.txt", "MAIN"), ("B.txt", "DUP"), ("e", "MAIN"), ("f", "DUP")}
    assert tuple(duplicates.hash_outcomes(h).first()) == (5, 0, 1)
    assert tuple(duplicates.duplicate_totals(duplicates.duplicate_groups(h.where("false"))).first()) == (0, 0, 0, 0)


# -- truncation ------------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab\n é你", max_size=400), st.integers(0, 120), st.integers(0, 120), st.integers(0, 60), st.integers(0, 4))
def test_shorten_keeps_whole_characters(text, head, tail, chunk, n):
    raw = text.encode()
    mb = 1 << 20
    s = truncation.shorten(raw, truncation.TruncationRule(True, head / mb, tail / mb, chunk / mb, n), "h")
    s.content.decode()
    assert s.original_bytes == len(raw) and s.kept_bytes <= len(raw)
    assert all(a < b for a, b in s.samples) and all(x[1] <= y[0] for x, y in zip(s.samples, s.samples[1:]))
    if not s.truncated:
        assert s.content == raw
    assert s == truncation.shorten(raw, truncation.TruncationRule(True, head / mb, tail / mb, chunk / mb, n), "h")


def test_truncate_items(spark):
    rule = truncation.TruncationRule(True, 10 / (1 << 20), 5 / (1 << 20))
    df = spark.createDataFrame([(1, "x" * 100, 7), (2, "short", 8), (3, None, 9), (4, "", 9)], "id bigint, t string, content int")
    got = truncation.truncate_items(df, "id", F.col("t"), F.lit("p"), {"r": rule}, F.lit("r"))
    assert rows(got, "id", "truncated", "kept_bytes") == [(1, True, 15), (2, False, 5), (4, False, 0)]


def test_log_head_and_tail():
    raw = b"".join(b"line %03d\n" % i for i in range(100))
    s = truncation.shorten_log(raw, 200)
    assert s.truncated and s.head_bytes <= 100 and s.content.startswith(b"line 000") and s.content.endswith(b"line 099\n")


# -- volumes ----------------------------------------------------------------------------------------------------------------------


def reference_fit(sizes, capacity, header=0):
    volume, used, out = 1, header, []
    for n in sizes:
        if used + n > capacity and used > 0:
            volume, used = volume + 1, 0
        used += n
        out.append(volume)
    return out


@pytest.mark.parametrize("header", [0, 7])
def test_next_fit_equals_the_fold(spark, header):
    import random

    rng = random.Random(header)
    sizes = [rng.choice([0, 1, 3, 9, 20, 25, 26, 60]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(sizes)), "k bigint, n bigint")
    got = [r.volume for r in volumes.next_fit(df, [F.col("k")], "k", "n", 25, header, ranges=7).orderBy("k").collect()]
    assert got == reference_fit(sizes, 25, header)


def test_next_fit_of_nothing(spark):
    df = spark.createDataFrame([], "k bigint, n bigint")
    assert volumes.next_fit(df, [F.col("k")], "k", "n", 25).count() == 0
    with pytest.raises(ValueError):
        volumes.next_fit(df, [F.col("k")], "k", "n", 0)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab\né你", min_size=1, max_size=3000))
def test_cut_points(text):
    raw = text.encode()
    ends = volumes.cut_points(raw, 100, 1100)
    assert ends[-1] == len(raw) and all(b - a <= 1100 for a, b in zip([0, *ends], ends))
    for a, b in zip([0, *ends], ends):
        raw[a:b].decode()


# -- incremental ---------------------------------------------------------------------------------------------------------------------


def test_pending_versions(spark, tmp_path):
    t = lambda d: datetime(2024, 1, d)
    catalog = spark.createDataFrame(
        [(1, 1, 1, "a/x", t(1), t(1)), (2, 2, 1, "a\\x", t(2), t(2)), (3, 2, 1, "b", None, t(2)), (4, 2, 2, "b", t(1), t(2)), (5, 1, 1, "a/x", t(9), t(3)), (6, 2, 1, None, t(1), t(2)), (7, 2, 1, "a//x", t(2), t(4))],
        "scan_row_id bigint, scan_no int, tree_id int, rel_path string, mtime timestamp_ntz, loaded_at timestamp_ntz",
    )
    journal = spark.createDataFrame([(1, 1, "a/x", t(2), "started"), (1, 2, "./b", t(1), "done"), (2, 1, "b", None, "done"), (None, 1, None, None, None)], "scan_no int, tree_id int, rel_path string, mtime timestamp_ntz, state string")
    runs = spark.createDataFrame([(1, True), (2, False)], "scan_no int, output_kept boolean")
    seen = incremental.keyed(catalog)
    assert rows(incremental.pending_versions(seen, journal, runs), "scan_row_id") == [(2,), (3,)]
    assert incremental.pending_versions(seen.where("false"), journal.where("false"), runs).count() == 0


FILES = "scan_row_id bigint, scan_no int, tree_id int, rel_path string, mtime timestamp_ntz, loaded_at timestamp_ntz"
JOURNAL = "scan_no int, tree_id int, rel_path string, mtime timestamp_ntz, state string"
RUNS = "scan_no int, started_at timestamp_ntz, ended_at timestamp_ntz, output_kept boolean"


def test_the_next_run_rereads_from_the_oldest_open_run(spark, tmp_path):
    t = lambda d: datetime(2024, 1, d)
    first = [(1, 1, 1, "a", t(1), t(2)), (2, 1, 1, "b", t(1), t(2)), (3, 2, 1, "c", t(1), t(9))]
    then = incremental.keyed(spark.createDataFrame(first, FILES))
    done = [(1, 1, "a", t(1), "done"), (1, 1, "c", t(1), "done")]
    journal = spark.createDataFrame(done, JOURNAL)
    runs = spark.createDataFrame([(1, t(1), t(3), True), (2, t(5), None, True)], RUNS)
    state = incremental.RunState(spark, f"file://{tmp_path}/state")
    pending = incremental.next_versions(then, journal, runs, state)
    assert rows(pending, "scan_row_id") == [(2,)], "nothing committed: everything is read"
    assert state.commit(then, pending, runs) == t(5), "run 2 is open"
    since, carried = state.read(runs)
    assert since == t(5) and rows(carried) == [(1, "b")]
    # Rows of the open run with an older load time than the newest, rows of unknown time; not read: a row older than the mark,
    # which can't be new. So a run that ignored the mark would find it.
    late = [*first, (4, 2, 1, "d", t(1), t(6)), (5, 2, 1, "e", t(1), None), (6, 1, 1, "x", t(1), t(2))]
    now = incremental.keyed(spark.createDataFrame(late, FILES))
    assert rows(incremental.next_versions(now, journal, runs, state), "scan_row_id") == [(2,), (4,), (5,)]
    # A run that fails leaves the state, whatever it had written, and the next one finds the same.
    now.select("tree_id", "file_path").write.parquet(f"file://{tmp_path}/state/pending-2")
    more = spark.createDataFrame([*done, (2, 1, "b", t(1), "done"), (2, 1, "d", t(1), "failed")], JOURNAL)
    again = incremental.next_versions(now, more, runs, state)
    assert rows(again, "scan_row_id") == [(4,), (5,)]
    state.commit(now, again, runs)
    assert rows(state.read(runs)[1]) == [(1, "d"), (1, "e")] and rows(incremental.next_versions(now, more, runs, state), "scan_row_id") == [(4,), (5,)]
    # A run whose output is discarded after the commit: what it had done may be of any age.
    discarded = spark.createDataFrame([(1, t(1), t(3), False), (2, t(5), t(9), True)], RUNS)
    assert state.read(discarded) is None
    assert rows(incremental.next_versions(now, more, discarded, state), "scan_row_id") == [(1,), (3,), (4,), (5,), (6,)]
    unknown = spark.createDataFrame([(1, None, None, None)], RUNS)
    assert state.commit(now, again, unknown) is None and state.read(unknown) is None


def test_replayed_state_gives_what_a_full_read_gives(spark, tmp_path):
    t = lambda d: datetime(2024, 1, d)
    r = random.Random(4)
    files = [(i, 1 + i % 4, i % 3, f"f{r.randrange(60)}", t(1 + r.randrange(4)), t(2 + i % 4 * 5 + r.randrange(9))) for i in range(400)]
    logged = [(t(3 + 5 * n), 1 + n, r.randrange(3), f"f{r.randrange(60)}", t(1 + r.randrange(4)), r.choice(["done", "failed"])) for n in range(4) for _ in range(150)]
    catalog = spark.createDataFrame(files, FILES)
    journal = spark.createDataFrame(logged, "logged_at timestamp_ntz, " + JOURNAL)
    runs = spark.createDataFrame([(1, t(1), t(4), True), (2, t(6), t(9), False), (3, t(11), t(14), True), (4, t(16), None, True)], RUNS)
    full = rows(incremental.pending_versions(incremental.keyed(catalog), journal, runs), "scan_row_id")
    assert full and rows(incremental.replayed(catalog, journal, runs, f"file://{tmp_path}/s"), "scan_row_id") == full
    none = runs.where("false")
    assert rows(incremental.replayed(catalog, journal, none, f"file://{tmp_path}/n"), "scan_row_id") == rows(incremental.pending_versions(incremental.keyed(catalog), journal, none), "scan_row_id")


def test_stream_processes_each_version_once(spark, tmp_path):
    from corpusloom.streaming.resume import process_versions

    schema = "scan_row_id bigint, tree_id int, rel_path string, mtime timestamp_ntz"
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    first = spark.createDataFrame([(1, 1, "a", datetime(2024, 1, 1)), (2, 1, "./a", datetime(2024, 1, 1)), (3, 1, "b", None)], schema)
    first.coalesce(1).write.parquet(src)
    process_versions(spark, src, first.schema, out, lambda d: d.select("rel_path", "mtime"), ck).awaitTermination()
    spark.createDataFrame([(4, 1, "a", datetime(2024, 1, 2)), (5, 1, "b", None)], schema).coalesce(1).write.mode("append").parquet(src)
    process_versions(spark, src, first.schema, out, lambda d: d.select("rel_path", "mtime"), ck).awaitTermination()
    assert spark.read.parquet(out + "/results").count() == 3


# -- converters ------------------------------------------------------------------------------------------------------------------------


def convert(kind, raw, name="f", **options):
    return C.convert_bytes(kind, raw, name, C.Options(**options))


def test_text_kinds():
    assert convert("txt", "你好".encode()).markdown == "```text\n你好\n```\n"
    gbk = convert("txt", ("这是一个中文文本文件，用于测试编码探测。" * 5).encode("gbk"))
    assert "中文" in gbk.markdown and gbk.warnings
    assert convert("markdown", b"# x").markdown == "# x\n"
    assert convert("code_py", b"x").markdown.startswith("```python")
    assert convert("json", b'{"b":1,"a":"\xc3\xa9"}').markdown == '```json\n{\n  "b": 1,\n  "a": "é"\n}\n```\n'
    bad = convert("json", b"{")
    assert bad.status == "success" and bad.warnings
    assert convert("unsupported", b"x").status == "skipped"
    assert convert("xlsx", b"broken").status == "failed"


def a_pdf(contents, compress, unicode=b""):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents))) + b"] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % len(contents)]
    objects.append(b"<< /Type /Font /Subtype /Type0" + (b" /ToUnicode 4 0 R" if unicode else b"") + b" >>")
    numbered = dict(enumerate(objects, 1))
    numbered[4] = b"<< /Length %d >>\nstream\n" % len(unicode) + unicode + b"\nendstream"
    for i, c in enumerate(contents):
        body = zlib.compress(c) if compress else c
        numbered[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        numbered[11 + 2 * i] = b"<< /Length %d %s>>\nstream\n" % (len(body), b"/Filter /FlateDecode " if compress else b"") + body + b"\nendstream"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted(numbered.items())) + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("compress", [False, True])
def test_pdf(compress):
    first = b"BT /F1 12 Tf 72 700 Td (Hello \\(big\\) w\\366rld) Tj 0 -14 Td [(Sec) 20 (ond) -300 (line)] TJ ET"
    got = convert("pdf", a_pdf([first, b"BT (Page two) Tj T* (end) ' ET"], compress), scanned_chars_per_page=5)
    assert got.status == "success" and got.extra["pages"] == 2 and not got.extra["is_scanned_pdf"]
    assert "### Page 1\n\nHello (big) w\u00f6rld\nSecond line\n\n### Page 2\n\nPage two\nend\n" in got.markdown


def test_pdf_maps_scans_and_damage():
    cmap = b"1 beginbfchar <0001> <4F60> endbfchar 1 beginbfrange <0002> <0003> <0041> endbfrange"
    assert "\u4f60AB" in convert("pdf", a_pdf([b"BT /F1 9 Tf <000100020003> Tj ET"], True, cmap)).markdown
    scan = convert("pdf", a_pdf([b"q 1 0 0 1 0 0 cm /Im1 Do Q"] * 2, True))
    assert scan.status == "success" and scan.extra["is_scanned_pdf"] and scan.warnings and "本页未提取到文本" in scan.markdown
    for bad in (b"x", b"", b"%PDF-1.4\n", b"%PDF-1.4\ntrailer << /Encrypt 5 0 R >>"):
        assert convert("pdf", bad).status == "failed"


def test_ocr_reaches_the_run_only_if_enabled_and_given():
    from corpusloom.config import load
    from corpusloom.plans import bundle

    assert bundle.ocr_plugins(load({}, {}), object) == {} == bundle.ocr_plugins(load({}, {"OCR_ENABLED": "1"}), None)
    assert set(bundle.ocr_plugins(load({}, {"OCR_ENABLED": "1"}), object)) == {"image"}


def test_csv():
    got = convert("csv", b"a,b|c\n1,2\n3\n4,5,6\n", csv_rows=1)
    assert "| a | b\\|c |\n| --- | --- |\n| 1 | 2 |\n" in got.markdown
    assert got.extra == {"chars": got.extra["chars"], "rows": 2, "truncated": True, "cols": 2} and len(got.warnings) == 2
    assert convert("csv", b"").status == "failed"


def test_param_native_equals_python(spark):
    from corpusloom.plans.catalogue import parameter_rows

    text = "# c\nA,1\nB  2 3\nC\n\n ,x\nD,1,2\n"
    native = spark.createDataFrame([(text,)], "t string").select(parameter_rows(F.col("t")).alias("p")).first().p
    assert [tuple(p) for p in native] == C.parameters(text) == [("A", "1"), ("B", "2 3"), ("D", "1,2")]
    assert convert("param", text.encode()).extra["param_count"] == 3


def test_html():
    got = C.html_markdown("<html><head><title>t</title><style>x</style></head><body><h2>Hi &amp; bye</h2><p>a <b>b</b> <a href='u'>l</a></p><ul><li>x</li><li>y</li></ul><script>no</script></body></html>")
    assert got == "## Hi & bye\n\na **b** [l](u)\n\n- x\n- y\n"


def test_archives():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a|b.txt", "hello")
    entries, warnings = C.archive_entries(z.getvalue(), "archive_zip", "x.zip", 10)
    assert [(e["name"], e["size"]) for e in entries] == [("a|b.txt", 5)] and not warnings
    assert "CRC32" in convert("archive_zip", z.getvalue()).markdown
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("n")
        info.size = 3
        f.addfile(info, io.BytesIO(b"abc"))
    assert C.archive_entries(t.getvalue(), "archive_gz", "x.tar.gz", 10)[0][0]["name"] == "n"
    got = convert("archive_zip", b"nonsense")
    assert got.status == "success" and got.warnings


def test_executables():
    pe = bytearray(b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<2H3I2H", 0x8664, 1, 0, 0, 0, 240, 0x2002))
    pe += struct.pack("<H", 0x20B) + bytes(66) + struct.pack("<H", 3) + bytes(240 - 70) + b".text\0\0\0" + struct.pack("<4I", 1, 2, 3, 4) + bytes(16)
    info, warnings = C.pe_header(bytes(pe))
    assert (info["machine"], info["pe_format"], info["subsystem"], info["sections"][0]["name"]) == ("x64 (AMD64)", "PE32+ (64-bit)", "WINDOWS_CUI (console)", ".text") and not warnings
    assert C.pe_header(b"MZ")[1] and "magic" in C.pe_header(bytes(64))[0]
    assert convert("exe", b"short").status == "success"


def test_office():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:t>x</w:t></w:r></w:p></w:body></w:document>')
    assert convert("docx", z.getvalue()).markdown == "## T\n\nx\n"
    assert convert("wps", z.getvalue()).extra["wps_format"] == "zip"
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("xl/workbook.xml", f'<workbook {s}><sheets><sheet name="S1" sheetId="1"/></sheets></workbook>')
        f.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>h</t></si></sst>")
        f.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row><row><c r="B2"><v>5</v></c></row></sheetData></worksheet>')
    got = convert("xlsx", z.getvalue())
    assert got.extra["sheets"] == 1 and "| h |  | 2 |" in got.markdown and "|  | 5 |  |" in got.markdown


def test_telemetry():
    frame = struct.pack(">Q", 5_000_000) + bytes([0xFE, 1, 0, 1, 1, 30, 0]) + b"\0\0"
    got = convert("tlog", frame * 3)
    assert got.extra["messages_parsed"] == 3 and got.extra["message_types"] == 1


def test_log_binary():
    assert C.looks_binary(b"a\0b") and not C.looks_binary("日志记录".encode()) and not C.looks_binary(b"")
    assert convert("rlog", b"\0\1\2").extra["is_binary"]


# -- a whole run -------------------------------------------------------------------------------------------------------------------------


def test_truncation_before_and_after_conversion(spark, tmp_path):
    """Text kinds are cut before conversion, all successes after it; zipped files are read whole."""
    from corpusloom.config import load
    from corpusloom.plans import bundle

    tree = tmp_path / "tree"
    tree.mkdir()
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for i in range(400):
            z.writestr(f"entry-{i:04}.bin", random.Random(i).randbytes(300))
    (tree / "a.zip").write_bytes(packed.getvalue())
    (tree / "long.txt").write_bytes(b"line of text\n" * 20_000)
    (tree / "short.txt").write_bytes(b"short\n")
    env = {"TRUNC_DEFAULT_ENABLED": "1", "TRUNC_DEFAULT_HEAD_MB": "0.01", "TRUNC_DEFAULT_TAIL_MB": "0.005", "TRUNC_DEFAULT_CHUNK_MB": "0", "TRUNC_DEFAULT_MIDDLE_CHUNKS": "0", "KEEP_INTERMEDIATE_FILES": "1"}
    s = load({"input_dir": str(tree), "output_dir": str(tmp_path / "out"), "output_timestamp": False}, env)
    files = bundle.catalog(spark, s)
    got = {r.rel_path: r for r in bundle.extract(files, s).join(files.select("file_key", "rel_path"), "file_key").collect()}
    whole, cut = json.loads(got["a.zip"].extra), json.loads(got["long.txt"].extra)
    assert whole["original_bytes"] == len(packed.getvalue()) and whole["sha1"] == hashlib.sha1(packed.getvalue()).hexdigest() and whole["entries_count"] == 400
    assert whole["post_truncation"]["truncated"] and whole["truncated"] and any("post-convert" in w for w in got["a.zip"].warnings) and not any("pre-read" in w for w in got["a.zip"].warnings)
    assert any(w.startswith("已截断[pre-read]: 原始 260,000 → 保留") for w in got["long.txt"].warnings) and len(got["long.txt"].markdown) < 20_000
    assert cut["chars"] < 20_000 and got["short.txt"].warnings == [] and "post_truncation" not in json.loads(got["short.txt"].extra)
    out = bundle.run(spark, s)["output"]
    index = "".join(open(f"{out}/intermediate_index/{p}", encoding="utf-8").read() for p in os.listdir(f"{out}/intermediate_index") if p.startswith("part"))
    links = re.findall(r"\]\(\./([^)]+)\)", index)
    assert len(links) == 6 and all(os.path.exists(f"{out}/intermediate/{n}") for n in links)


def test_dup_roles_of_a_hot_hash(spark):
    files = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), (F.col("id") / 6).cast("int"))).alias("content_hash"), F.concat(F.lit("p"), F.col("id")).alias("rel_path"), F.col("id").alias("size_bytes"))
    got = duplicates.duplicate_roles(files)
    assert got.where("content_hash = 'hot'").groupBy("role").count().orderBy("role").collect() == [("DUP", 2999), ("MAIN", 1)]
    assert got.count() == rows(duplicates.duplicate_totals(duplicates.duplicate_groups(files)), "files")[0][0]


def test_ranges_are_tabulated_by_tasks_of_their_own(spark):
    """The one task that chains the ranges reads their written tables: it has no part in sorting or tabulating."""
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n"))
    folder = shared_dir(spark).removeprefix("file://")
    got = volumes.next_fit(df, [F.col("k")], "k", "n", 25, ranges=8)
    newest = max((f"{folder}/{f}" for f in os.listdir(folder) if f.startswith("breaks-")), key=os.path.getmtime)
    written = [f for f in os.listdir(newest) if f.endswith(".parquet")]
    assert len(written) > 1, "more than one task tabulated"
    assert got.count() == 5000


def test_bundle(spark, tmp_path):
    from corpusloom.config import load
    from corpusloom.plans import bundle

    tree = tmp_path / "tree"
    for name, raw in {"a/x.CSV": b"a,b\n1,2\n", "_under.txt": b"u", "empty.log": b"", ".hid/z.txt": b"z", "build/w.txt": b"w", "m.pyc": b"m", "build2": b"b", "B.txt": b"u", "big.txt": b"line of text\n" * 100_000}.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(raw)
    s = load({"input_dir": str(tree), "output_dir": str(tmp_path / "out"), "output_timestamp": False, "max_size_mb": 1, "duplicates": True}, {"ELIGIBILITY_EXCLUDE_EXTS": "log"})
    out = bundle.run(spark, s)["output"]
    entries = spark.read.parquet(out + "/journal/entries")
    assert entries.count() == 5
    assert spark.read.parquet(out + "/journal/files").count() == 6
    assert spark.read.parquet(out + "/report/duplicates").first().files == 2
    report = "".join(open(f"{out}/{p}", encoding="utf-8").read() for p in sorted(os.listdir(out)) if p.startswith("conversion_report"))
    assert "## 1. purged" in report and "| hidden | 1 |" in report and "## 2. overview" in report and "| B.txt | txt | 1 |" in report and "ext_filter" in report
    parts = sorted(p for p in os.listdir(out) if p.startswith("merged") and p.endswith(".md"))
    assert len(parts) == 3 and all(os.path.getsize(f"{out}/{p}") <= 1 << 20 for p in parts)
    text = "".join(open(f"{out}/{p}", encoding="utf-8").read() for p in parts)
    assert text.count("===== FILE START:") == 5 and text.count("line of text\n") == 100_000
    assert text.index("进入提取的文件数: 5") < text.index("idx\tfile_id") < text.index("1. [_under.txt]") < text.index("1\tMAIN") < text.index("===== FILE START")
    assert text.count("# END OF BUNDLE") == 1
    again = bundle.resume(spark, s, out + "/journal")
    assert spark.read.parquet(again["output"] + "/journal/entries").count() == 5


def test_settings():
    from corpusloom.config import load

    s = load({}, {"TRUNC_KIND_PDF_ENABLED": "yes", "TRUNC_KIND_PDF_HEAD_MB": "0.5", "TRUNC_EXT_PDF_TAIL_MB": "3", "SIZE_FILTER_DEFAULT_MAX_MB": "7", "SIZE_FILTER_KIND_TXT_MIN_MB": "1"})
    assert s.truncation_rules.by_kind["pdf"].head_mb == 0.5 and s.truncation_rules.by_ext[".pdf"].head_mb == 0.5 and s.truncation_rules.by_ext[".pdf"].tail_mb == 3
    assert s.size_rules.by_kind["txt"].max_mb == 7
    with pytest.raises(ValueError):
        load({}, {"FILE_HASH_ALGO": "crc"})
    from corpusloom.__main__ import main

    assert main(["--no-dedup"]) == 2


def test_numbering(spark):
    df = spark.createDataFrame([("B",), ("a",), ("c",)], "p string")
    assert rows(ordering.numbered(df, [F.lower("p"), F.col("p")]), "idx", "p") == [(1, "a"), (2, "B"), (3, "c")]


# -- plug-ins --------------------------------------------------------------------------------------------------------------------------


def test_ocr_patience_and_converter(spark, tmp_path):
    from corpusloom.sources.ocr import OcrError, Patience, TokenCache, image_converter

    class Fake:
        engine = "fake"

        def __init__(self, *answers):
            self.answers, self.renewed = list(answers), 0

        def recognise(self, image):
            answer = self.answers.pop(0)
            if isinstance(answer, Exception):
                raise answer
            return answer

        def renew_token(self):
            self.renewed += 1

    slept = []
    patience = lambda: Patience(2, 0.5, slept.append, lambda: 0.0)
    fake = Fake(OcrError("busy", 17), OcrError("token", 110), ["a", "b"])
    got = image_converter(lambda: fake, patience())(b"x", "i.png", C.Options())
    assert got.markdown == "```text\na\nb\n```\n" and got.extra["ocr_lines"] == 2 and fake.renewed == 1 and 1.0 in slept
    assert image_converter(lambda: Fake(OcrError("no", 216)), patience())(b"x", "i", C.Options()).extra["ocr_error_code"] == 216
    assert image_converter(lambda: Fake(), patience())(b"xx", "i", C.Options(image_bytes=1)).status == "skipped"
    assert C.convert_bytes("image", b"x", "i", plugins={"image": image_converter(lambda: Fake(OSError(), OSError(), OSError()), patience())}).status == "failed"
    now = [0.0]
    cache = TokenCache(str(tmp_path / "t"), "key", lambda: now[0])
    assert cache.get() is None
    cache.put("T", 90_000)
    assert cache.get() == "T"
    now[0] = 4000.0
    assert cache.get() is None


def test_converted_files_with_a_plugin(spark):
    df = spark.createDataFrame([(1, "txt", b"x", "a.txt"), (2, "pdf", b"p", "b.pdf"), (3, "txt", None, "c"), (4, None, b"y", None), (5, "txt", b"\xff\xfe\x00", "d")], "id int, kind string, content binary, name string")
    got = {r.id: r for r in C.convert_files(df, "id", "kind", "content", "name", plugins={"pdf": lambda raw, name, o: C.Result(markdown="page")}).collect()}
    assert [got[i].status for i in range(1, 6)] == ["success", "success", "failed", "skipped", "success"] and got[2].markdown == "page"
