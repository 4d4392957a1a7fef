import os
import random
from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import encoding, mixing, packing, splitting, survivors, tokens
from corpusloom.llm.lexicon import Lexicon
from corpusloom.llm.prefix import running_sums
from corpusloom.llm.sketch import hashed_counts, lookup

VOCABULARY = tokens.TOKENIZERS + "/byte_bpe_50k.tiktoken"
no_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no tokenizer files")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


# -- counts ---------------------------------------------------------------------------------------------------------------------


def test_hashed_counts(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("k")).repartition(3)
    table = hashed_counts(df, lambda b: iter([b.column(0).to_numpy().astype(np.uint64)]), 16, 2)
    assert lookup(table, np.arange(12, dtype=np.uint64)).tolist() == [100] * 10 + [0, 0]
    assert hashed_counts(df.where("false"), lambda b: iter([b.column(0).to_numpy().astype(np.uint64)]), 16).sum() == 0


def test_running_sums_of_a_hot_group(spark):
    df = spark.range(500).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, "hot").alias("g"), (F.col("id") % 7).alias("v"))
    got = running_sums(df, "g", "v", "i", slices=8).collect()
    for g in ("hot", None):
        mine = sorted((r.start, r.v) for r in got if r.g == g)
        assert mine[0][0] == 0 and sum(v for _, v in mine) == max(s + v for s, v in mine)
        ends = sorted(s + v for s, v in mine)
        assert [s for s, _ in mine] == sorted([0, *ends[:-1]])


# -- 1: survivors ------------------------------------------------------------------------------------------------------------------

CATALOG = "scan_row_id bigint, tree_id int, rel_path string, mtime timestamp_ntz, ctime timestamp_ntz, kind string, content_hash_algo string, loaded_at timestamp_ntz, group_id string"


def test_survivors(spark):
    t = lambda y: datetime(y, 1, 1)
    data = [
        (1, 1, "a/x.txt", t(2020), t(2020), "txt", "sha256", t(2024), "clash"),
        (2, 2, "old/a/x.txt", t(2099), t(2020), "", None, t(2024), "clash"),
        (3, 1, "b/x - Kopie.txt", t(2019), None, "txt", "sha256", t(2024), "clash"),
        (4, 2, "y", None, None, None, None, None, "clash"),
        (5, 9, "y", None, None, None, None, None, "clash"),
    ]
    catalog = spark.createDataFrame(data, CATALOG)
    trees = spark.createDataFrame([(1, 5), (2, 3)], "tree_id int, trust int")
    groups = spark.createDataFrame([(10, [3, 2, 1, 1]), (11, [5, 4]), (12, [77]), (13, None), (14, [])], "group_id bigint, files array<bigint>")
    record, paths = survivors.survivors(groups, catalog, trees)
    got = {r.group_id: r for r in record.collect()}
    assert set(got) == {10, 11} and got[10].scan_row_id == 1 and got[11].scan_row_id == 4
    assert got[10].mtime == t(2020) and got[10].kind == "txt" and got[11].mtime is None
    kept = [(r.group_id, r.rel_path) for r in paths.collect()]
    assert (10, "a/x.txt") in kept and (11, "y") in kept and Counter(g for g, _ in kept) == {g: r.paths for g, r in got.items()}
    assert survivors.survivors(groups.where("false"), catalog, trees)[0].count() == 0


def test_survivor_of_a_hot_group(spark):
    """One group holds most rows; its best row is the only one without a copy's mark."""
    n = 3000
    rows = spark.range(n).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("group_id"), F.col("id").alias("scan_row_id"), (F.col("id") % 40).cast("int").alias("tree_id"),
        F.concat(F.when((F.col("id") == 7) | (F.col("id") % 10 == 0), "").otherwise("old/"), F.col("id").cast("string")).alias("rel_path"), F.lit(1).alias("trust"),
        *(F.lit("2020-01-01").cast("timestamp_ntz").alias(c) for c in ("mtime", "ctime")), F.lit("txt").alias("kind"), F.lit("sha1").alias("content_hash_algo"),
    )
    got = {r.group_id: r.scan_row_id for r in survivors.best_rows(rows).collect()}
    assert got == {-1: 7} | {i: i for i in range(0, n, 10)}
    votes = survivors.field_votes(rows).where("entity = -1 AND field = 'rel_path'")
    assert votes.count() == n * 9 // 10 and votes.where("size(votes) > 40").count() == 0


def test_marks(spark):
    marked = ["old/x", "a/.trash/x", "tmp/9/x", "x (2).txt", "x - copy.txt", "Copy of x", "x 副本.py", "x.bak", "x~", "x_old.c", "backup\\2024\\x"]
    clean = ["a/x.txt", "BACKUP-f3.pdf", "golden/x", "x_2024.log", "copyright.md", "a (b).txt", "template.tmpl"]
    df = spark.createDataFrame([(p,) for p in marked + clean], "p string").select("p", survivors.marked_path(F.col("p")).alias("m"))
    assert {r.p for r in df.collect() if r.m} == set(marked)


def test_survivor_model_weighs_sources_by_their_record(spark):
    """Tree 2 marks whatever it holds as recent; tree 1 does so for true survivors alone. Where both do, tree 1 is believed."""
    facts = [(e, str(10 * e + k), [f"complete@{t}{'+' if k == 0 else '-'}", f"recent@{t}{'+' if t == 2 or k == 0 else '-'}"]) for e in range(200) for k, t in ((0, 1), (1, 2), (2, 1), (3, 2))]
    facts += [(900, "9001", ["complete@2-", "recent@2+"]), (900, "9002", ["complete@1-", "recent@1+"]), (901, "9011", ["complete@1-", "recent@1-"])]
    best, quality = survivors.survivor_model(spark.createDataFrame(facts, "entity int, fact string, votes array<string>"))
    got = {r.entity: r for r in best.collect()}
    assert all(got[e].fact == 10 * e for e in range(200)) and got[900].fact == 9002 and got[901].truth == 1
    of = {r.source: r for r in quality.collect()}
    assert of["recent@1"].spec > 0.9 > 0.2 > of["recent@2"].spec
    none, nothing = survivors.survivor_model(spark.createDataFrame([], "entity int, fact string, votes array<string>"))
    assert none.count() == nothing.count() == 0


@pytest.mark.parametrize("few", [survivors.FEW, 0])
def test_quality_model_keeps_several_truths_and_finds_the_liar(spark, few):
    """On the driver and in Spark. Two of three who speak of ``q`` lie, as their record tells: votes alone would judge otherwise."""
    bad = ("x@1", "x@2")
    claims = [(e, "f", f"v{v}", s, (v == 0) != (s in bad)) for e in range(60) for v in range(2) for s in ("x@3", "x@4", "x@5", *bad)]
    claims += [(99, "f", v, s, True) for v in ("x", "y") for s in ("x@3", "x@4", "x@5")]
    claims += [(98, "f", v, s, (v == "q") == (s in bad)) for v in ("p", "q") for s in ("x@3", *bad)]
    facts = survivors.votes_of(spark.createDataFrame(claims, "entity int, field string, fact string, source string, said boolean"))
    truth, quality = survivors.quality_model(facts, few=few)
    by = {(r.entity, r.fact): r.truth for r in truth.collect()}
    assert by[0, "v0"] > 0.9 > 0.1 > by[0, "v1"] and by[99, "x"] > 0.9 and by[99, "y"] > 0.9
    assert by[98, "p"] > 0.9 > 0.1 > by[98, "q"]
    of = {r.source: (r.sens, r.spec) for r in quality.collect()}
    assert of["x@3"][0] > 0.9 > 0.3 > of["x@1"][0] and of["x@3"][1] > of["x@1"][1]
    empty = survivors.quality_model(facts.where("false"), few=few)
    assert empty[0].count() == empty[1].count() == 0


# -- 2: encodings ------------------------------------------------------------------------------------------------------------------------

GERMAN = ["Während der Prüfung war der Kühler größer als vorher.", "Die Übersicht über die Geräte fehlt, obwohl der Schlüssel da ist.", "Für das Gerät gehört die Lötstelle geprüft, während der Kühler läuft."]


def test_wrong_encodings(spark):
    good = [(i, GERMAN[i % 3] + f" Nummer {i}.", "x") for i in range(300)]
    bad = [(1000, GERMAN[0].encode().decode("cp1252")), (1001, GERMAN[1].encode("cp1252").decode("mac_roman")), (1002, "Wir fanden den K�hler."), (1003, GERMAN[0].encode().decode("cp1252").encode().decode("cp1252"))]
    fine = [(2000, 'Der Kühler steht als "KÃ¼hler" da.'), (2001, None), (2002, ""), (2003, "plain ascii"), (2004, "é")]
    df = spark.createDataFrame(good + [(i, t, "x") for i, t in bad + fine], "id bigint, t string, restored_text string")
    got = {r.id: r for r in encoding.repair(df, "id", "t").collect()}
    assert set(got) == {1000, 1001, 1002, 1003}
    assert got[1000].restored_text == GERMAN[0] and got[1001].restored_text == GERMAN[1] and got[1003].restored_text == GERMAN[0]
    assert got[1002].lost == 1 and got[1002].restored == 0
    assert encoding.repair(df.where("false"), "id", "t").count() == 0


def test_wrong_encodings_escaped_into_ascii(spark):
    garbled = [t.encode().decode("cp1252") for t in GERMAN]
    escaped = [(1000 + i, "".join(c if c.isascii() else f"&#{ord(c)};" for c in t)) for i, t in enumerate(garbled)]
    escaped.append((1010, "".join(c if c.isascii() else f"&#x{ord(c):X};" for c in garbled[0])))
    fine = [(2000, "".join(c if c.isascii() else f"&#{ord(c)};" for c in GERMAN[0])), (2001, "a &#38; b"), (2002, "&#; &#x; &# 7"), (2003, "x &#9999999; y")]
    df = spark.createDataFrame([(i, GERMAN[i % 3] + f" Nummer {i}.") for i in range(300)] + escaped + fine, "id bigint, t string")
    assert all(t.isascii() for _, t in escaped)
    got = {r.id: r.restored_text for r in encoding.repair(df, "id", "t").collect()}
    assert got == {1000: GERMAN[0], 1001: GERMAN[1], 1002: GERMAN[2], 1010: GERMAN[0]}


def test_references_outside_of_garbled_runs_stay(spark):
    garbled = "".join(c if c.isascii() else f"&#{ord(c)};" for c in GERMAN[0].encode().decode("cp1252"))
    deep = GERMAN[1]
    for _ in range(6):
        deep = deep.encode().decode("latin-1")
    texts = [f"costs &#8364;5 and &#8212; stays. {garbled} Then &#8364;7.", deep, "plain &#8364;5", f"K&#252;hler {GERMAN[2]} {GERMAN[0].encode().decode('cp1252')}"]
    df = spark.createDataFrame([(i, GERMAN[i % 3] + f" Nummer {i}.") for i in range(300)] + [(1000 + i, t) for i, t in enumerate(texts)], "id bigint, t string")
    got = {r.id: r.restored_text for r in encoding.repair(df, "id", "t").collect()}
    assert got == {1000: f"costs &#8364;5 and &#8212; stays. {GERMAN[0]} Then &#8364;7.", 1001: GERMAN[1], 1003: f"K&#252;hler {GERMAN[2]} {GERMAN[0]}"}
    assert encoding.with_references("a&#228;b&#x26;&#xE9;") == ("aäb&#x26;é", {1: "&#228;", 9: "&#xE9;"})


# -- 6: splitting --------------------------------------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n#`|é你", max_size=1500), st.integers(8, 300), st.integers(0, 80))
def test_split_is_whole_and_within_the_limit(text, limit, overlap):
    raw = text.encode()
    pieces = splitting.split(raw, limit, overlap)
    assert b"".join(raw[s:e] for s, e, _ in pieces) == raw
    for i, (s, e, o) in enumerate(pieces):
        assert e - o <= limit and 0 <= s - o <= min(overlap, limit // 2) and (i > 0 or o == s)
        raw[o:e].decode()


def test_split_cuts_at_headings():
    text = "".join(f"# Part {i}\n\n" + "some words here. " * 20 + "\n\n" for i in range(6)).encode()
    starts = [text[s : s + 6] for s, _, _ in splitting.split(text, 800, 0)]
    assert all(s == b"# Part" for s in starts)


def test_split_texts(spark):
    df = spark.createDataFrame([(1, "x" * 100, 1), (2, "short", 1), (3, None, 1), (4, "", 1)], "id bigint, t string, piece_no int")
    got = splitting.split_texts(df, "id", "t", 40, 5).collect()
    assert {r.id for r in got} == {1} and "".join(r.text.encode()[r.overlap_bytes :].decode() for r in sorted(got, key=lambda r: r.piece_no)) == "x" * 100


# -- 7: packing ------------------------------------------------------------------------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(3)
    items = [(i, rng.choice([0, 5, 30, 60, 99, 100]), "hot" if i % 3 else None, 0) for i in range(3000)] + [(9000, 250, "big", 0), (9001, None, "x", 0), (9002, -4, "x", 0), (9003, 200, "big", 0)]
    df = spark.createDataFrame(items, "i bigint, n bigint, s string, part int")
    got = packing.pack(df, "i", "n", "s", 100).collect()
    used, seen = Counter(), Counter()
    for r in got:
        used[r.container] += r.byte_end - r.byte_start
        seen[r.item] += r.byte_end - r.byte_start
    assert max(used.values()) <= 100 and dict(seen) == {i: max(0, n or 0) for i, n, _, _ in items}
    divided = {k for k, n in Counter(r.item for r in got).items() if n > 1}
    assert divided == {9000, 9003} and sum(used.values()) / (100 * len(used)) > 0.97
    assert packing.pack(df.where("false"), "i", "n", "s", 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "i", "n", "s", 0)


def test_leftovers_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "GATHER", 2)
    monkeypatch.setattr(packing, "WINDOW", 4)
    df = spark.createDataFrame([(i, 37 + i % 5, "q") for i in range(500)], "i bigint, n bigint, s string")
    got = packing.pack(df, "i", "n", "s", 100).collect()
    assert sorted(r.item for r in got) == list(range(500))
    used = Counter()
    for r in got:
        used[r.container] += r.byte_end - r.byte_start
    assert max(used.values()) <= 100


def test_windows_hold_the_proportions(spark):
    n = packing.WINDOW * 20
    df = spark.createDataFrame([(i, 50, "a" if i % 4 else "b") for i in range(n * 2)], "i bigint, n bigint, s string")
    got = packing.pack(df, "i", "n", "s", 100).select("container", "item").collect()
    by = {}
    for r in got:
        by.setdefault(r.container, []).append(r.item % 4 == 0)
    share = [np.mean([x for c in sorted(by)[k : k + packing.WINDOW] for x in by[c]]) for k in range(0, len(by), packing.WINDOW)]
    assert abs(np.mean(share) - 0.25) < 0.02 and max(share) < 0.5


def test_windows_are_reported(spark):
    n = packing.WINDOW * 40
    df = spark.createDataFrame([(i, 50, "a" if i % 4 else "b") for i in range(n)] + [(n, 1000, "b")], "i bigint, n bigint, s string")
    packed = packing.pack(df, "i", "n", "s", 100, {"a": 0.6, "b": 0.4})
    assert packed.where("window IS NULL").count() == 10
    got = packing.window_shares(packed, {"a": 0.6, "b": 0.4}).collect()
    assert sum(r.bytes for r in got) == 50 * n
    # As long as both queues have items, each window but the first mirrors the targets.
    full = {r.window for r in got if r.queue == "b"}
    assert all(abs(r.share - r.target) < 0.02 for r in got if 0 < r.window < max(full)) and len(full) > 5


def test_piece_sizes(spark):
    df = spark.createDataFrame([(1, None, 5, 9, "a.TXT", 99), (2, "é", None, None, None, -1), (3, None, None, None, None, None), (4, "x", 9, 5, "b", 3)], "piece_id bigint, inline_text string, byte_start bigint, byte_end bigint, rel_path string, bytes_len bigint")
    assert rows(packing.piece_sizes(df)) == [(1, 4, "txt"), (2, 2, "inline"), (3, 0, "inline"), (4, 0, "")]


# -- 8: tokens --------------------------------------------------------------------------------------------------------------------------------------


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=12), st.lists(st.integers(0, 50_000), max_size=4), max_size=60), st.lists(st.binary(max_size=12), max_size=20))
def test_lexicon(words, others):
    lexicon = Lexicon.view(np.frombuffer(Lexicon.build(words).to_bytes(), np.uint8))
    asked = [*words, *others]
    for w, n in zip(asked, lexicon.numbers(pa.array(asked, pa.binary()))):
        got = None if n < 0 else lexicon.ids[lexicon.offsets[n] : lexicon.offsets[n + 1]].tolist()
        assert got == words.get(w)


def test_lexicon_shares_suffixes():
    built = Lexicon.build({w + b"ation": [1] for w in (b"n", b"st", b"r", b"l")})
    assert len(built.keys) < 12


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab 1\n\t'!é你s  ", max_size=60))
def test_chunks_are_independent(text):
    import regex

    pattern = regex.compile(tokens.PATTERN)
    assert [w for c in tokens.chunks(text) for w in pattern.findall(c)] == pattern.findall(text)
    values, starts, order = tokens.cut(pa.array([text, None, text + "x"], pa.string()))
    for k, row in enumerate(order):
        got = values[starts[k] : starts[k + 1]].to_pylist()
        assert got[0] + "".join(" " + x for x in got[1:]) == [text, "", text + "x"][row]


@no_vocabulary
def test_ids_equal_the_public_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.TOKENIZERS + "/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["Hello world, it's  here.\n\n  x = 1\t", "", None, "你好 мир 🙂‍🔥 <|endoftext|>", "a" * 3000, " leading", "trail ", "\r\n \r\n", "é ½ ﬁ​"] * 3
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(texts)], "id bigint, text string, ids int").repartition(3)
    got = {r.id: r.ids for r in tokens.encode_corpus(df, "id", "text").collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    counts = {r.id: r.tokens for r in tokens.encode_corpus(df, "id", "text", count_only=True).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert tokens.encode_corpus(df.where("false"), "id", "text").count() == 0


# -- 9: mixing ---------------------------------------------------------------------------------------------------------------------------------------


def test_route_prefers_what_is_unused():
    flows = mixing.route({("a",): 100, ("b",): 100, ("a", "b"): 100}, {"a": (0.5, 1), "b": (0.5, 3), "gone": (0.1, 2)})
    a, b = (sum(n for (_, s), n in flows.items() if s == x) for x in "ab")
    assert abs(a - b) <= 2 and a >= 198 and ("gone",) not in {s for _, s in flows}
    assert mixing.route({}, {"a": (1.0, 1)}) == {}


def test_mix(spark):
    rng = random.Random(1)
    docs = [(i, ["Big", " small ", "both-a", "unknown", None][i % 5 if i % 50 else 0], f"h{i // 2 if i % 10 == 2 else i}", rng.randint(1, 40)) for i in range(4000)]
    docs += [(5000, "big", "zero", 0)]
    counted = spark.createDataFrame(docs, "doc_id bigint, source string, h string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("both_a", 0.1, 1), ("nothing", 0.1, 4)], "source string, target_share double, max_repeats int")
    selection, report = mixing.mix(counted, targets)
    caps = {"big": 1, "small": 2, "both_a": 1}
    chosen = selection.collect()
    assert len({(r.doc_id) for r in chosen}) == len(chosen) and all(1 <= r.uses <= caps[r.source] for r in chosen)
    shares = {r.source: r.actual_share for r in report.collect()}
    assert shares["nothing"] == 0 and all(abs(shares[s] - x / 0.9) < 0.01 for s, x in (("big", 0.5), ("small", 0.3), ("both_a", 0.1)))
    narrow, report = mixing.mix(counted, targets, patterns=1)
    assert all(1 <= r.uses <= caps[r.source] for r in narrow.collect())
    shares = {r.source: r.actual_share for r in report.collect()}
    assert all(abs(shares[s] - x / 0.9) < 0.02 for s, x in (("big", 0.5), ("small", 0.3), ("both_a", 0.1)))
    nothing, report = mixing.mix(counted.where("false"), targets)
    assert nothing.count() == 0 and {r.actual_share for r in report.collect()} == {0.0}
