from corpusloom.llm import scans

SCHEMA = "src string, rec_id bigint, scan bigint, page_no int, text string, repaired string"
CLEAN = "the technician reads the morning report and the table near the reading desk before the overnight report"


def repaired(spark, records, vocabulary=None):
    records = spark.createDataFrame([(*r, "clash") for r in records], SCHEMA)
    vocabulary = spark.createDataFrame(vocabulary or [(CLEAN + " fill in both the pre",)] * 40 + [(None,)], "t string")
    return {(r.src, r.rec_id): r for r in scans.repair_scans(records, vocabulary).collect()}


def test_scans(spark):
    pages = [(i, f"Handbook of gauges {i}\n{CLEAN}\nthe tech-\nnician reads the rnorning table\nfill in both the pre-\nand the overnight report\n\nReadings:\n41 mm\n77 mm\n[{i}]") for i in range(12)]
    odd = [(50, ""), (51, CLEAN), (52, "B0R-51 and l10n and H2O"), (53, None), (54, "x" * 100_000)]
    got = repaired(spark, [("ocr", i, None, None, t) for i, t in pages + odd])
    page = got["ocr", 3]
    assert (page.furniture, page.hyphen, page.misread) == (2, 1, 1)
    assert "technician reads the morning table" in page.repaired and "pre- and" in page.repaired and "[3]" not in page.repaired and "77 mm" in page.repaired
    assert (got["ocr", 50].repaired, got["ocr", 50].furniture) == ("", 0) and got["ocr", 51].misread == got["ocr", 52].misread == 0
    assert ("ocr", 53) not in got and got["ocr", 54].repaired == "x" * 100_000
    empty = spark.createDataFrame([], SCHEMA)
    assert scans.repair_scans(empty, empty.select("text")).count() == 0


def test_rows_of_a_table_are_no_furniture(spark):
    table = "Parts list\nMotor mount    4\nProp adapter    12\nM3 bolt    13\nDone."
    heads = [("ocr", i, None, None, f"Gauge handbook    Page {i}\n{CLEAN}\n{CLEAN}\nas it was.") for i in range(40)]
    got = repaired(spark, [("conv", 1, None, None, table), ("conv", 2, None, None, f"{CLEAN}\nVoltage    12\n{CLEAN}"), *heads])
    assert got["conv", 1].furniture == 0 and "Motor mount    4" in got["conv", 1].repaired
    assert got["conv", 2].furniture == 0 and "Voltage    12" in got["conv", 2].repaired
    assert all(got["ocr", i].furniture == 1 for i in range(40))


def test_heads_inside_a_text_count_up(spark):
    body = "\n".join([CLEAN] * 5)
    text = f"116    Winch notes\n{body}\n117    Old spool report\n{body}\n118    W1nch n0tes\n{body}"
    got = repaired(spark, [("conv", 1, None, None, text), ("conv", 2, None, None, f"{CLEAN}\nBattery cells    4\n{body}\nend.")])
    assert got["conv", 1].furniture == 3 and "Winch" not in got["conv", 1].repaired and "spool" not in got["conv", 1].repaired
    assert got["conv", 2].furniture == 0


def test_form_feeds_part_pages(spark):
    pages = [("conv", i, None, None, "\x0c".join(f"Manual of winches\n{CLEAN}\n- {7 * i + p} -" for p in range(3))) for i in range(3)]
    got = repaired(spark, pages)
    assert all(r.furniture == 6 for r in got.values())


def test_repetition_and_numbers_across_the_pages_of_a_scan(spark):
    """Forms that are rare in the corpus: only the other pages of the scan tell."""
    a = [("ocr", p, 7, p, f"{'The Winch & Its Care' if p != 2 else 'The VVinch & lts Care'}\n{CLEAN}\n({p + 40})") for p in range(1, 4)]
    b = [("ocr", 10 + p, 8, p, f"{first}\n{CLEAN}\nthe same end\n{n}") for p, first, n in ((1, "so it began", "731"), (2, "nobody came back", "52"))]
    c = [("ocr", 20, 9, 1, f"One Page; No More\n{CLEAN}"), ("ocr", 21, 9, 1, f"One Page; No More\n{CLEAN}")]
    got = repaired(spark, a + b + c)
    assert [got["ocr", p].furniture for p in (1, 2, 3)] == [2, 2, 2]
    assert [got["ocr", 10 + p].furniture for p in (1, 2)] == [0, 0] and got["ocr", 11].repaired.endswith("731")
    assert got["ocr", 20].furniture == got["ocr", 21].furniture == 0, "a page that was recognised twice does not repeat itself"


def test_skeleton():
    assert scans.skeleton("Nav0stri fie1d n0tes") == scans.skeleton("Navostri field notes") != scans.skeleton("Queum works notes")
