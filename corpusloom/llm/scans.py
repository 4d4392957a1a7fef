"""Noise in text from scanned pages: page furniture, words broken over line ends, misread characters.

Furniture is found by fuzzy repetition at page edges, in three ways: a line at the edge of a page whose words, with letters that
scanning confuses falling together, stand at an edge of another page of the same scan; numbers that run with the pages (the
difference of number and page is that of another page of the scan, or the numbered heads inside one long text count up); and,
over the whole corpus, a form of line (classes of words, digits as one sign) that stands at page edges far more often than
inside pages. Broken words are joined, and misread words corrected, if the corpus' vocabulary knows the result much better than
what stands there. Forms and words are counted over all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.sketch import hashed_counts, lookup
from corpusloom.operators.skew import join_counts
from corpusloom.session import materialize


@dataclass(frozen=True)
class Settings:
    word_bits: int = 20  # cells of the counts of words (two rows)
    shape_bits: int = 18  # cells of the counts of shapes (two rows)
    edge_share: float = 0.6  # least share of a shape's lines that stand at page edges
    edge_least: int = 5  # least number of them
    known: int = 5  # least count of a word that a repair may lead to
    better: float = 25.0  # how many times better known it must be than what stands there
    apart: int = 3  # least lines between numbered heads inside a text; rows of a table stand closer
    two_up_to: int = 40  # two misreadings at once are undone in words of up to so many letters, a single one in words of any length


# What scanning takes for what, as (read, meant).
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g"), ("8", "b"), ("6", "b"), ("6", "g"), ("3", "e"), ("2", "z"), ("4", "a"), ("7", "t"),
    ("@", "a"), ("|", "l"), ("|", "i"), ("$", "s"), ("!", "l"), ("!", "i"), ("€", "e"), ("¢", "c"),
    ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("n", "u"), ("u", "n"), ("o", "c"), ("c", "o"),
    ("q", "g"), ("g", "q"), ("l", "t"), ("t", "l"), ("a", "o"), ("o", "a"), ("s", "5"), ("v", "y"), ("y", "v"), ("r", "n"), ("i", "j"), ("j", "i"),
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("ii", "u"), ("ii", "ü"), ("ii", "n"), ("li", "h"), ("h", "li"), ("nn", "m"), ("ri", "n"), ("ln", "m"), ("ij", "y"), ("fi", "ñ"), ("m", "hi"), ("m", "in"), ("m", "ni"), ("b", "ß"), ("o0", "ö"), ("a0", "ä"), ("u0", "ü"),
    ("б", "6"), ("6", "б"), ("3", "з"), ("0", "о"), ("o", "о"), ("a", "а"), ("e", "е"), ("c", "с"), ("p", "р"), ("ш", "щ"), ("и", "й"), ("н", "п"), ("п", "н"),
]
_SIGNS = str.maketrans("015986324|@$!", "olsgbbezalasi")
#: Conjunctions before which a hyphen at a line end is a compound part's own.
CONJUNCTIONS = {"and", "or", "und", "oder", "bzw", "sowie", "bis", "et", "ou", "y", "e", "o", "u", "to", "и", "или"}
#: Letters that scanning takes for one another, as one: pairs of them first, then single ones.
_FOLDED = [("rn", "m"), ("nn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u")]
_FOLD = {ord(c): one for one, many in {"l": "1i|!jtf", "c": "0oae", "s": "5$", "g": "69q", "b": "8h", "u": "nvy", "z": "2"}.items() for c in many}
HYPHENS = "-¬\u00ad\u2010\u2011"

_TOKEN = re.compile(r"\w+|[^\w\s]")
_ROMAN = re.compile(r"[ivxl]+$")
_NUMBER = re.compile(r"\d[\d.,]*$")
_BROKEN = re.compile(rf"(?<![^\W_])([^\W\d_]+(?:[0-9@|$!][^\W\d_]*)*)([{HYPHENS}])[ \t]*\n[ \t]*(([^\W_]|[@|$!])+)")
_WORD = re.compile(r"[^\W_](?:[^\W_]|[@|$!€¢](?=[^\W_]))*[@|$]?|[@|$][^\W\d_]+")
_GAP = re.compile(r"[ \t]{3,}")
_PAGE_NUMBER = re.compile(r"(?:[^\W\d_]{1,6}\.? ?)?[-~\[(–]? ?\d{1,4} ?[-~\])–]?(?: (?:of|von|de|sur|/) ?\d{1,4})?$")
_SPLIT = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"\r\n|[\n\r\x0b]")
_DIGITS = re.compile(r"\d{1,4}")


@dataclass(frozen=True)
class Numbered:
    """A line with a page number: alone, or set apart by a gap from a title before or after it."""

    title: str
    cell: str
    number: int
    first: bool  # whether the number comes first


def numbered_line(line: str) -> Numbered | None:
    if _PAGE_NUMBER.match(line):
        return Numbered("", line, int(_DIGITS.search(line)[0]), True)
    if "   " not in line and "\t" not in line or line[-1] in ".!?。" or len(cells := _GAP.split(line)) != 2:
        return None
    at = next((i for i in (1, 0) if _PAGE_NUMBER.match(cells[i])), None)
    return None if at is None else Numbered(cells[1 - at], cells[at], int(_DIGITS.search(cells[at])[0]), at == 0)


def _classes(line: str) -> str:
    out = []
    for w in _TOKEN.findall(line):
        if _NUMBER.match(w):
            out.append("#")
        elif _ROMAN.match(w):
            out.append("r")
        elif w[0].isalnum():
            upper = sum(c.isupper() or c.isdigit() for c in w)
            out.append("AA" if len(w) > 1 and upper * 4 >= 3 * len(w) else "A" if w[0].isupper() else "a")
        else:
            out.append(w)
    return " ".join(out)


def shape(line: str) -> str:
    """A line's form: its words by class, its digits as one sign, its punctuation as it is; a title set apart from a page number
    is one sign."""
    n = numbered_line(line)
    if n is None or not n.title:
        return _classes(line)
    return f"{_classes(n.cell)} \t T" if n.first else f"T \t {_classes(n.cell)}"


def skeleton(title: str) -> str:
    """A title as scanning may have read it: letters that are taken for one another as one, numbers as one sign."""
    words = ("#" if w.isdigit() else w for w in re.findall(r"[^\W_]+|[@|$!€¢]", title.casefold()))
    joined = "".join(words)
    for read, meant in _FOLDED:
        joined = joined.replace(read, meant)
    return joined.translate(_FOLD)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _lines(text: str) -> list[str]:
    return _BREAK.split(text)


def edges(text: str, deep: int = 1) -> tuple[list[str], set[int]]:
    """The lines of a text, stripped, and which of them are the first or last ``deep`` of a page that aren't blank; form feeds part pages."""
    lines: list[str] = []
    at: set[int] = set()
    for page in text.split("\x0c"):
        mine = [x.strip() for x in _lines(page)]
        full = [len(lines) + i for i, x in enumerate(mine) if x]
        at.update(full[:deep], full[-deep:])
        lines += mine
    return lines, at


def edge_shapes(text: str) -> tuple[list[int], list[int]]:
    """Hashes of the forms of lines at the edges of pages and inside them."""
    lines, at = edges(text)
    edge, inside = [], []
    for i, line in enumerate(lines):
        if line:
            (edge if i in at else inside).append(_hash(shape(line)))
    return edge, inside


def running_heads(lines: list[str], at: set[int], apart: int) -> set[int]:
    """Lines of one text that are numbered heads or feet of its pages: their numbers count up by one (or two, where a page's is
    lost), or their titles repeat; at least ``apart`` full lines lie between. A bare number proves nothing inside a page."""
    found: set[int] = set()
    heads: list[tuple[int, int, Numbered]] = []
    row = 0
    for i, line in enumerate(lines):
        if not line:
            continue
        row += 1
        n = numbered_line(line)
        if n is not None and (n.title or i in at or not n.cell.isdigit()):
            heads.append((i, row, n))
    # Neighbours are rows of a table.
    rows = {r for _, r, _ in heads}
    heads = [h for h in heads if h[0] in at or not {h[1] - 1, h[1] + 1} & rows]
    by_number: dict[int, list[tuple[int, int, Numbered]]] = {}
    by_title: dict[str, tuple[int, int]] = {}
    for i, r, n in heads:
        for j, q, m in (*by_number.get(n.number - 1, ()), *by_number.get(n.number - 2, ())):
            if r - q > apart and bool(m.title) == bool(n.title) and m.first == n.first:
                found |= {i, j}
        by_number.setdefault(n.number, []).append((i, r, n))
        if len(key := skeleton(n.title)) >= 4:
            if key in by_title and r - by_title[key][1] > apart:
                found |= {i, by_title[key][0]}
            by_title[key] = (i, r)
    return found


def vocabulary_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The words of whole texts (letters only, lower-cased), counted as often as they stand."""
    held: list[int] = []
    for t in batch.column(0).to_pylist():
        if t:
            held += map(_word_hash, _SPLIT.findall(t.lower()))
        if len(held) > 1 << 19:
            yield np.array(held, np.uint64)
            held = []
    if held:
        yield np.array(held, np.uint64)


_word_hash = lru_cache(maxsize=1 << 18)(_hash)
_INSIDE = np.uint64(0x5851F42D4C957F2D)


def shape_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    edge, inside = [], []
    for t in batch.column(0).to_pylist():
        if t:
            a, b = edge_shapes(t)
            edge += a
            inside += b
    yield np.concatenate([np.array(edge, np.uint64), np.array(inside, np.uint64) ^ _INSIDE])


def repeated_edges(records: DataFrame) -> DataFrame:
    """``src, rec_id, lines``: the lines at the edges of pages that repeat on another page of their scan, by their words or by
    numbers that run with the pages. Of ``records(src, rec_id, scan, page_no, text)``, those without scan or page give no row.

    Only two or four marks a page are compared, by their counts; the pages of a scan never come together.
    """
    schema = "src string, rec_id bigint, page int, line int, mark bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for src, rec, scan, page, text in zip(*(c.to_pylist() for c in batch.columns)):
                lines, outer = edges(text)
                for i in sorted(edges(text, 2)[1]):  # a number may stand behind a stamp; words only at the very edge
                    n = numbered_line(lines[i])
                    # A sentence may end with the same words on two pages.
                    if i in outer and lines[i][-1] not in ".!?。" and len(key := skeleton(n.title if n else lines[i])) >= 4:
                        out.append((src, rec, page, i, _hash(f"{src} {scan} words {key}") - (1 << 63)))
                    if n:
                        out.append((src, rec, page, i, _hash(f"{src} {scan} runs {n.number - page}") - (1 << 63)))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["src", "rec_id", "page", "line", "mark"])

    paged = records.where("scan IS NOT NULL AND page_no IS NOT NULL AND text <> ''").select("src", "rec_id", "scan", "page_no", "text")
    marks = materialize(paged.mapInArrow(run, schema), "marks")
    counts = marks.groupBy("mark").agg(F.count("*").alias("n"), F.min("page").alias("low"), F.max("page").alias("high"))
    again = join_counts(marks.select("src", "rec_id", "line", "mark"), materialize(counts, "marked"), "mark", "n", F.col("low") < F.col("high"))
    return again.groupBy("src", "rec_id").agg(F.collect_set("line").alias("lines"))  # at most four lines a page


class Reader:
    """Judges texts by the corpus' counts (tables of fixed size)."""

    def __init__(self, words: np.ndarray, shapes: np.ndarray, s: Settings):
        self.words, self.shapes, self.s = words, shapes, s
        self.counts: dict[str, int] = {}
        self.fixes: dict[str, str | None] = {}
        self.judged: dict[str, bool] = {}

    def count(self, word: str) -> int:
        n = self.counts.get(word)
        if n is None:
            if len(self.counts) > 1 << 18:
                self.counts.clear()
            n = self.counts[word] = int(lookup(self.words, np.array([_hash(word)], np.uint64))[0])
        return n

    def common_at_edges(self, line: str) -> bool:
        """Whether the form of a line stands at page edges in the corpus, far more often than inside pages."""
        form = shape(line)
        known = self.judged.get(form)
        if known is None:
            if len(self.judged) > 1 << 18:
                self.judged.clear()
            h = np.array([_hash(form)], np.uint64)
            edge, inside = int(lookup(self.shapes, h)[0]), int(lookup(self.shapes, h ^ _INSIDE)[0])
            known = self.judged[form] = edge >= self.s.edge_least and edge >= self.s.edge_share * (edge + inside) and form[-1] not in ".!?。"
        return known

    def furniture(self, text: str, repeated: set[int]) -> tuple[list[str], set[int]]:
        """The lines of a text and which of them are furniture. ``repeated`` are known to repeat on other pages of the scan."""
        lines, at = edges(text)
        found = {i for i in repeated if i < len(lines)} | running_heads(lines, at, self.s.apart)
        for i, line in enumerate(lines):
            # Inside a page a title and a number set apart may be a row of a table: there, only what repeats or counts up is furniture.
            if line and i not in found and self.common_at_edges(line) and (i in at or "\t" not in shape(line)):
                found.add(i)
        return lines, found

    def meant(self, word: str) -> str | None:
        """The word that was misread as ``word``, or None if it is none: one or two confusions away, and known much better."""
        low = word.lower()
        if low in self.fixes:
            return self.fixes[low]
        if len(self.fixes) > 1 << 18:
            self.fixes.clear()
        best = None
        letters = sum(c.isalpha() for c in low)
        clean = letters == len(low)
        here = self.count(low) if clean else 0
        if 3 <= len(low) and letters * 2 > len(low) and not (clean and here >= 400 * self.s.known):
            floor = max(self.s.known, self.s.better * here)
            near = self._apart(low)
            if not clean:  # all its signs at once
                near += [low.translate(_SIGNS), low.replace("1", "i").translate(_SIGNS)]
            best = self._best(near, floor)
            if best is None and len(low) <= self.s.two_up_to and not (clean and here >= self.s.known):
                best = self._best([other for first in near for other in self._apart(first) if other != low], 4 * floor)
        self.fixes[low] = best
        return best

    def _best(self, words: list[str], least: float) -> str | None:
        """The best known of some words, if it is known well enough; the first of equals."""
        if not words:
            return None
        counts = lookup(self.words, np.fromiter(map(_hash, words), np.uint64, len(words)))
        at = int(counts.argmax())
        return words[at] if counts[at] >= least else None

    @staticmethod
    def _apart(word: str) -> list[str]:
        out = []
        for read, meant in CONFUSIONS:
            at = word.find(read)
            while at >= 0:
                out.append(word[:at] + meant + word[at + len(read) :])
                at = word.find(read, at + 1)
        return out

    def broken(self, left: str, mark: str, right: str) -> str | None:
        """The whole word, if its parts were broken over a line end; None if the hyphen is a compound's own."""
        whole = (left + right).lower()
        if right.lower() in CONJUNCTIONS and self.count(whole) < self.s.known and (mark in "-\u2010\u2011"):
            return None
        if right[:1].isupper() or right[:1].isdigit() and mark in "-\u2010\u2011" and not right[1:].isalpha():
            return None
        joined = self.count(whole) if whole.isalpha() else 0
        apart = min(self.count(left.lower()), self.count(right.lower()))
        if mark in "¬\u00ad" or joined >= self.s.known and joined * 4 >= apart or self.meant(whole):
            return left + right
        # Unknown as a whole: broken if a part alone is no word either, else a compound with its own hyphen.
        return left + right if apart < self.s.known and right.lower() not in CONJUNCTIONS else None

    def read(self, text: str, repeated: set[int] = frozenset()) -> tuple[str, dict[str, int]]:
        """The repaired text, in paragraphs, and how often each defect was found."""
        lines, gone = self.furniture(text, repeated)
        found = {"furniture": len(gone), "hyphen": 0, "misread": 0}
        kept = [line for i, line in enumerate(lines) if i not in gone]
        body = "\n".join(kept)

        def join(m: re.Match) -> str:
            whole = self.broken(m[1], m[2], m[3])
            if whole is None:
                return m[0]
            found["hyphen"] += 1
            return whole + "\x00"  # the line break moves behind the word

        body = _BROKEN.sub(join, body)
        body = re.sub("\x00([^\\w\\s]*)[ \t]*\n?", "\\1\n", body)

        def correct(m: re.Match) -> str:
            word = m[0]
            before, after = body[m.start() - 1 : m.start()], body[m.end() : m.end() + 1]
            if before in ("-", "/", "_", "\\", "=") and before or after in ("-", "/", "_", "\\", "=") and after and body[m.end() + 1 : m.end() + 2].isdigit():
                return word  # part of a code or path
            if word.isupper() and len(word) > 1 or (meant := self.meant(word)) is None:
                return word
            found["misread"] += 1
            return meant[:1].upper() + meant[1:] if word[0].isupper() else meant

        body = _WORD.sub(correct, body)
        return _paragraphs(body), found


def _paragraphs(text: str) -> str:
    """Lines joined into paragraphs; a break stays where a line ends early and the next begins something new."""
    lines = text.split("\n")
    width = max(map(len, lines), default=0)
    out: list[str] = []
    fresh, before = True, 0
    for line in lines:
        line = line.strip()
        if not line:
            fresh = True
            continue
        if fresh or before < 0.6 * width and (line[0].isdigit() or line[0] in "-*•|#" or out and out[-1][-1:] == ":"):
            out.append(line if fresh or not out else "\n" + line)
        else:
            out[-1] += " " + line
        fresh, before = False, len(line)
    return "\n\n".join(out).replace("\n\n\n", "\n")


def scanned_records(ocr: DataFrame, conversions: DataFrame, catalog: DataFrame) -> DataFrame:
    """``src, rec_id, scan, page_no, text``: recognised pages, and conversions of the catalog kinds ``pdf`` and ``image``, which
    have no page. Null texts are left out."""
    kinds = catalog.where(F.lower(F.trim("kind")).isin("pdf", "image")).select("scan_row_id").distinct()
    conv = conversions.where("markdown IS NOT NULL").select("conv_id", "scan_row_id", "markdown").join(kinds, "scan_row_id", "left_semi")
    pages = ocr.where("text IS NOT NULL").select(F.lit("ocr").alias("src"), F.col("ocr_id").alias("rec_id"), F.col("scan_row_id").alias("scan"), F.col("page_no").cast("int").alias("page_no"), "text")
    none = F.lit(None)
    conv = conv.select(F.lit("conv").alias("src"), F.col("conv_id").alias("rec_id"), none.cast("bigint").alias("scan"), none.cast("int").alias("page_no"), F.col("markdown").alias("text"))
    return pages.unionAll(conv)


def repair_scans(records: DataFrame, vocabulary: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``src, rec_id, repaired, furniture, hyphen, misread`` of every record: the text in paragraphs and the number of each defect.

    ``records(src, rec_id, scan, page_no, text)``: the pages of a scan share ``scan``; both may be null. ``vocabulary`` is one
    column of texts whose words count as known. Null texts are left out, empty ones come back empty, without defects.
    """
    # With a number given, small inputs are not drawn into one task before they cross into Python.
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    records = records.where("text IS NOT NULL").select("src", "rec_id", "scan", "page_no", "text").repartition(parts, "src", "rec_id")
    records = materialize(records, "records")  # spread evenly, whatever the files they came from
    words = hashed_counts(vocabulary, vocabulary_keys, s.word_bits, 2)
    shapes = hashed_counts(records.select("text"), shape_keys, s.shape_bits, 2)
    sent = records.sparkSession.sparkContext.broadcast((words.clip(max=(1 << 32) - 1).astype(np.uint32), shapes.clip(max=(1 << 32) - 1).astype(np.uint32)))  # fixed sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*sent.value, s)
        for batch in batches:
            read = [reader.read(t, set(again or ())) for t, again in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            counts = [pa.array([f[d] for _, f in read], pa.int32()) for d in ("furniture", "hyphen", "misread")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in read], pa.string()), *counts], ["src", "rec_id", "repaired", "furniture", "hyphen", "misread"])

    known = records.select("src", "rec_id", "text").repartition(parts, "src", "rec_id").join(repeated_edges(records).repartition(parts, "src", "rec_id"), ["src", "rec_id"], "left")
    return known.select("src", "rec_id", "text", "lines").mapInArrow(run, "src string, rec_id bigint, repaired string, furniture int, hyphen int, misread int")
