"""Splitting oversized texts at natural boundaries, by agglomerative merging.

A text begins as atomic segments (lines, else sentences, else words, else characters). Every adjacent pair waits in a heap
under the strength of the boundary between them; the weakest boundary is removed first, as long as the merged piece together
with the overlap it must repeat stays under the limit. Strong boundaries (headings, blank lines) survive as the cuts.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINE = re.compile(rb"[^\n]*\n|[^\n]+")
_SENTENCE = re.compile(rb"(?s).+?(?:[.!?;]['\")\]]*[ \t]+|\xe3\x80\x82|\xef\xbc[\x81\x9f\x9b]|[|,] )|.+")
_WORD = re.compile(rb"(?s)[^ \t\n]*[ \t\n]+|[^ \t\n]+")

#: Strengths of boundaries, by what they lie between; a lower one is given up first.
INSIDE_WORD, WORD, SENTENCE, ROW, LINE, FENCE_EDGE, BLANK, HEADING = range(8)


def _pieces(pattern: re.Pattern, raw: bytes) -> list[bytes]:
    return [m.group(0) for m in pattern.finditer(raw)]


def _hard(raw: bytes, room: int) -> list[bytes]:
    """Cuts of at most ``room`` bytes between characters."""
    out, at = [], 0
    while at < len(raw):
        end = min(at + room, len(raw))
        while end < len(raw) and end > at + 1 and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:end])
        at = end
    return out


def atoms(raw: bytes, room: int) -> tuple[list[bytes], list[int]]:
    """Segments of at most ``room`` bytes and the strength of the boundary before each (the first has none)."""
    segments: list[bytes] = []
    strengths: list[int] = []
    fenced, before = False, b""
    for line in _pieces(_LINE, raw):
        bare = line.strip()
        fence = bare.startswith(b"```")
        if fence and not fenced:
            strength = BLANK
        elif fenced and fence:
            strength = INSIDE_WORD  # the closing fence stays with its code
        elif fenced:
            strength = ROW
        elif bare.startswith(b"#"):
            strength = HEADING
        elif before == b"" and bare:
            strength = BLANK
        elif before.startswith(b"#") or not bare:
            strength = WORD  # a heading stays with what it heads, a blank line with what it ends
        elif before.startswith(b"|") and bare.startswith(b"|"):
            strength = ROW
        else:
            strength = FENCE_EDGE if before.startswith(b"```") else LINE
        if fence:
            fenced = not fenced
        before = bare
        for level, part in _refine(line, room):
            segments.append(part)
            strengths.append(strength)
            strength = level
    return segments, strengths


def _refine(line: bytes, room: int) -> Iterator[tuple[int, bytes]]:
    """A line as parts of at most ``room`` bytes with the strength of the boundary after each."""
    if len(line) <= room:
        yield LINE, line
        return
    for sentence in _pieces(_SENTENCE, line):
        if len(sentence) <= room:
            yield SENTENCE, sentence
            continue
        for word in _pieces(_WORD, sentence):
            if len(word) <= room:
                yield WORD, word
            else:
                for part in _hard(word, room):
                    yield INSIDE_WORD, part


def split(raw: bytes, max_bytes: int, overlap: int) -> list[tuple[int, int, int]]:
    """``(start, end, overlap_start)`` of consecutive pieces; a piece is ``raw[overlap_start:end]``, at most ``max_bytes`` long.

    ``overlap_start`` reaches back up to ``overlap`` bytes into the piece before, to where a line or word
    begins if that keeps at least half of it. A text within the limit is one piece; an empty text gives none.
    """
    if not raw:
        return []
    if max_bytes < 4:
        raise ValueError("max_bytes must hold a character of four bytes")
    overlap = max(0, min(overlap, max_bytes // 2))
    if len(raw) <= max_bytes:
        return [(0, len(raw), 0)]
    room = max(4, max_bytes - overlap)
    segments, strengths = atoms(raw, min(room, max(4, max_bytes // 4)))
    n = len(segments)
    end = np.cumsum([len(s) for s in segments]).tolist()
    start = [0, *end[:-1]]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    size = [e - s for s, e in zip(start, end)]
    alive = [True] * n
    # Weakest boundary first; among equals the pair that makes the smallest piece.
    heap = [(strengths[i], size[i - 1] + size[i], i) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, expected, i = heapq.heappop(heap)
        if not alive[i]:
            continue
        a = left[i]
        both = size[a] + size[i]
        # The first piece repeats nothing; every other one repeats up to ``overlap`` bytes.
        if both > (max_bytes if a == 0 else room):
            continue
        if both != expected:
            heapq.heappush(heap, (strengths[i], both, i))
            continue
        size[a], alive[i], right[a] = both, False, right[i]
        if right[i] < n:
            left[right[i]] = a
    heads = [i for i in range(n) if alive[i]]
    out = []
    for i in heads:
        s, e = start[i], start[i] + size[i]
        out.append((s, e, s if not out else _back(raw, s, overlap, out[-1][0])))
    return out


def _back(raw: bytes, at: int, overlap: int, floor: int) -> int:
    """Where a repeated part of at most ``overlap`` bytes before ``at`` begins: after a line or word end in its first half, else
    between characters."""
    low = max(floor, at - overlap)
    if low >= at:
        return at
    for mark in (b"\n", b" "):
        found = raw.find(mark, low, at - 1)
        if found >= 0 and (at - found - 1) * 2 >= at - low:
            return found + 1
    while low < at and raw[low] & 0xC0 == 0x80:
        low += 1
    return low


def split_texts(df: DataFrame, key: str, text: str, max_bytes: int, overlap_bytes: int) -> DataFrame:
    """The pieces of every text over the limit: ``key, piece_no, pieces, byte_start, byte_end, overlap_bytes, text``.

    ``text`` begins with the ``overlap_bytes`` bytes repeated from the piece before; ``byte_start..byte_end`` is what the piece
    adds, so that the additions joined give the text back. Texts within the limit, empty or null give no row. Only the key
    and the text are read, and only oversized texts cross into Python, one at a time.
    """
    kind = df.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, piece_no int, pieces int, byte_start bigint, byte_end bigint, overlap_bytes int, text string"
    arrow_key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "piece_no", "pieces", "byte_start", "byte_end", "overlap_bytes", "text"]
        types = [arrow_key, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                cut = split(raw, max_bytes, overlap_bytes)
                rows = [(k.as_py(), i, len(cut), s, e, s - o, raw[o:e].decode("utf-8", "replace")) for i, (s, e, o) in enumerate(cut)]
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), types)], names)

    big = df.select(key, text).where(F.octet_length(text) > max_bytes)
    return big.mapInArrow(run, schema)
