"""Text that was decoded with a wrong character encoding: finding it and restoring it.

Every adjacent pair of characters is scored by its mutual information in the corpus (in how many texts the pair stands,
against how many its characters stand in, with a floor under the expectation so that rare pairs gain nothing from being
rare together). Maximum-scoring segments of improbable pairs are the suspect runs. Only inside those runs are the inverse
mappings tested (encode as it was wrongly decoded, decode as it should have been); a mapping counts if the corpus finds its
result far less improbable. What was lost (U+FFFD, or bytes that no longer map) is reported but can't be restored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.sketch import hashed_counts, lookup


@dataclass(frozen=True)
class Settings:
    pair_bits: int = 20  # cells of the counts of pairs and characters (two rows)
    floor: float = 0.05  # least expected share of texts of a pair
    improbable: float = 0.8  # a pair is improbable by what its score lies below minus this
    suspect: float = 0.4  # what a pair must be more improbable than that to raise the score of a suspect segment
    gain: float = 1.5  # least improbability that a mapping must take away
    left: float = 0.5  # greatest share of it that may be left


#: The mistakes tested, as (decoded as, should have been decoded as), the likeliest first.
MISTAKES = [
    (wrong, right)
    for right, wrongs in (
        ("utf-8", ("cp1252", "latin-1", "mac_roman", "cp1251", "gb18030", "cp437", "cp850", "cp1250", "koi8_r", "cp866", "iso8859_15", "big5", "shift_jis", "euc_kr")),
        ("cp1252", ("mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8_r", "cp866", "gb18030", "iso8859_2")),
        ("gb18030", ("latin-1", "cp1252", "big5", "cp1251", "mac_roman", "cp437", "shift_jis", "euc_kr")),
        ("cp1251", ("latin-1", "cp1252", "koi8_r", "mac_roman", "cp866", "cp437", "gb18030")),
        ("koi8_r", ("cp1251", "latin-1", "cp1252", "cp866")),
        ("cp866", ("cp1251", "cp1252", "koi8_r", "latin-1")),
        ("mac_roman", ("cp1252", "latin-1")),
        ("cp850", ("cp1252", "latin-1")),
        ("cp437", ("cp1252", "latin-1")),
        ("big5", ("latin-1", "cp1252", "gb18030")),
        ("shift_jis", ("latin-1", "cp1252", "gb18030")),
        ("euc_kr", ("latin-1", "cp1252", "gb18030")),
    )
    for wrong in wrongs
]
#: The five bytes that cp1252 leaves undefined; decoders commonly keep them as C1 controls.
_UNDEFINED = {0x81, 0x8D, 0x8F, 0x90, 0x9D}
_QUOTED = re.compile(r"([\"“„«»`'‘])([^\"”“«»`'’\n]{1,40})([\"”“«»`'’])")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
#: The mistakes by what was decoded as, so that a run is encoded once for all of them; with their place in the order.
_BY_WRONG: dict[str, list[tuple[int, str]]] = {}
for _i, (_w, _r) in enumerate(MISTAKES):
    _BY_WRONG.setdefault(_w, []).append((_i, _r))
_ENTITY = re.compile(r"&#(?:[xX]([0-9a-fA-F]{2,6})|(\d{3,7}));")
_LOST = "�"


def _encode(run: str, codec: str) -> bytes:
    if codec in ("cp1252", "cp1251", "cp1250"):
        try:
            return run.encode(codec)
        except UnicodeEncodeError:
            return b"".join(bytes([ord(ch)]) if ord(ch) in _UNDEFINED or (codec == "cp1252" and 0x80 <= ord(ch) < 0xA0) else ch.encode(codec) for ch in run)
    return run.encode(codec)


def _decode(raw: bytes, right: str, run: str) -> str | None:
    try:
        new = raw.decode(right)
    except UnicodeError:
        return None
    return None if new == run else new


def invert(run: str, wrong: str, right: str) -> str | None:
    """The run with one mistake undone, or None where its bytes don't allow it."""
    try:
        raw = _encode(run, wrong)
    except UnicodeError:
        return None
    return _decode(raw, right, run)


def _reference(m: re.Match) -> str:
    """The character beyond ASCII that a numeric reference names, else the reference."""
    code = int(m[1], 16) if m[1] else int(m[2])
    return chr(code) if 127 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


def unescaped(text: str) -> str:
    """The text with numeric character references beyond ASCII as characters: wrongly decoded text is often escaped afterwards."""
    return _ENTITY.sub(_reference, text) if "&#" in text else text


def with_references(text: str) -> tuple[str, dict[int, str]]:
    """``unescaped``, and where in it which references stood, so that those outside of wrongly decoded runs can be put back."""
    if "&#" not in text:
        return text, {}
    parts, stood, at, n = [], {}, 0, 0
    for m in _ENTITY.finditer(text):
        if len(char := _reference(m)) == 1:
            n += m.start() - at
            stood[n] = m[0]
            parts += [text[at : m.start()], char]
            at, n = m.end(), n + 1
    return "".join([*parts, text[at:]]), stood


def _again(once: str | None, mistake: tuple[str, str]) -> list[str]:
    """What a mistake undone once gave, and, where UTF-8 was wrongly decoded again and again, what it gives undone ever again."""
    found = []
    while once is not None:
        if not _CONTROL.search(once):  # control characters stand in what is garbled several times, but in no text
            found.append(once)
        once = invert(once, *mistake) if mistake[1] == "utf-8" and not once.isascii() else None
    return found


def all_undone(run: str) -> list[tuple[tuple[str, str], str]]:
    """Every mistake that the run's bytes allow to undo, with the result, the likeliest first."""
    found = []
    for wrong, rights in _BY_WRONG.items():
        try:
            raw = _encode(run, wrong)
        except UnicodeError:
            continue
        found += [(i, (wrong, right), new) for i, right in rights for new in _again(_decode(raw, right, run), (wrong, right))]
    return [(mistake, new) for _, mistake, new in sorted(found, key=lambda x: x[0])]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _pairs(codes: np.ndarray) -> np.ndarray:
    return (codes[:-1] << np.uint64(32)) | codes[1:]


#: Entries of a worker's memories of pairs and runs, after which they begin anew.
_MEMORY = 1 << 18


class Scorer:
    """Scores of pairs from counts over the whole corpus (a table of fixed size)."""

    def __init__(self, counts: np.ndarray, total: int, s: Settings):
        self.counts, self.total, self.s = counts, max(total, 1), s
        self.known: dict[str, float] = {}
        self.inverted: dict[str, list[tuple[tuple[str, str], str]]] = {}
        self.undone: dict[tuple[str, str, str], tuple | None] = {}

    def improbability(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Of pairs of characters, how far their mutual information lies below what is usual; negative for usual pairs."""
        n = (lookup(self.counts, (first << np.uint64(32)) | second) + 0.3) / self.total
        a, b = lookup(self.counts, first) / self.total, lookup(self.counts, second) / self.total
        return -np.log(n / (a * b + self.s.floor)) - self.s.improbable

    def penalty(self, text: str, limit: float = float("inf")) -> float:
        """The improbability of a text: what its improbable pairs sum up to; counting ends beyond ``limit``."""
        total, known = 0.0, self.known
        for i in range(len(text) - 1):
            p = known.get(pair := text[i : i + 2])
            if p is None:
                if len(known) >= _MEMORY:
                    known.clear()
                codes = _codes(pair)
                p = known[pair] = max(0.0, float(self.improbability(codes[:1], codes[1:])[0]))
            total += p
            if total > limit:
                break
        return total

    def inversions(self, run: str) -> list[tuple[tuple[str, str], str]]:
        """Every mistake that the run's bytes allow to undo, with the result."""
        if (got := self.inverted.get(run)) is None:
            got = all_undone(run)
            if len(run) <= 8:
                if len(self.inverted) >= _MEMORY:
                    self.inverted.clear()
                self.inverted[run] = got
        return got


def segments(score: np.ndarray, least: float, drop: float = 6.0) -> list[tuple[int, int]]:
    """The maximum-scoring segments of a sequence that reach ``least``, as half-open ranges, in one pass.

    A segment ends where its sum has fallen to nothing, or by ``drop`` below its best, and is cut back to its best end.
    """
    ahead = np.concatenate([[0.0], np.cumsum(score)])
    at = np.flatnonzero(score > 0)
    found: list[tuple[int, int]] = []
    base = best = 0.0
    start = end = -1
    for i, before, through in zip(at.tolist(), ahead[at].tolist(), ahead[at + 1].tolist()):
        if start < 0 or before <= base or best - (before - base) > drop:
            if start >= 0 and best >= least:
                found.append((start, end))
            start, base, best = i, before, 0.0
        if through - base > best:
            best, end = through - base, i + 1
    if start >= 0 and best >= least:
        found.append((start, end))
    return found


def suspect_runs(codes: np.ndarray, scorer: Scorer, least: float, suspect: float) -> list[tuple[int, int]]:
    """Character ranges to test: the stretches of characters beyond ASCII that a maximum-scoring segment of ``least`` touches."""
    beyond = codes > 126
    score = np.full(len(codes) - 1, -0.5)  # a pair of ASCII characters neither begins nor bridges a run
    at = np.flatnonzero(beyond[:-1] | beyond[1:])
    score[at] = scorer.improbability(codes[at], codes[at + 1]) - suspect
    found = segments(score, least)
    if not found:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], beyond, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    a, b = (np.array(c) for c in zip(*found))
    # A segment of pairs [a, b) has the characters [a, b]; of the stretches, those that end after a and start by b.
    touched = np.searchsorted(b, starts, "left") < np.searchsorted(a, ends, "left")
    return list(zip(starts[touched].tolist(), ends[touched].tolist()))


@dataclass
class Verdict:
    text: str
    found: bool
    restored: int
    lost: int
    mistakes: list[str]


def examine(text: str, scorer: Scorer) -> Verdict:
    """Find and undo wrong decoding in a text. Runs that stand only in quotation marks are examples, and no case.

    Character references are read as the characters they name; those outside of the runs that are undone stay references.
    """
    text, stood = with_references(text)
    if text.isascii() or len(text) < 2:
        return Verdict(text, False, 0, 0, [])
    quoted = [(m.start(), m.end()) for m in _QUOTED.finditer(text)]
    s = scorer.s
    out, mistakes = text, []
    known: list[tuple[str, str]] = []
    restored = lost = outside = 0
    for layer in count():  # a text can be wrongly decoded any number of times over; every round makes it less improbable
        codes = _codes(out)
        # Once a mistake is known, what is left of it is undone on less evidence; quoted examples stay.
        sure = known if layer else []
        runs = suspect_runs(codes, scorer, 0.2 if sure else s.gain, 0.0 if sure else s.suspect)
        parts, at, changed = [], 0, 0
        edits: list[tuple[int, int, int]] = []
        usual: tuple[str, str] | None = None
        for a, b in runs:
            if a < at:
                continue
            best = _undo(out, a, b, usual, scorer) if usual else None
            if best is None or best[1] > 0.2:
                best = _undo_any(out, a, b, scorer) or best
            for mistake in sure if best is None else ():
                best = best or _undo(out, a, b, mistake, scorer, 0.2, 0.9)
            if best is None:
                continue
            _, _, wider, new, mistake = best
            b += wider
            if layer == 0:
                outside += not any(x < a and b < y for x, y in quoted)
            usual = mistake
            if mistake not in known:
                known.append(mistake)
            parts += [out[at:a], new]
            edits.append((a, b, len(new)))
            at, changed = b, changed + 1
            name = f"{mistake[1]} as {mistake[0]}"
            if name not in mistakes:
                mistakes.append(name)
        if not changed:
            break
        restored += changed
        out = "".join([*parts, out[at:]])
        stood = _moved(stood, edits)
    for m in re.finditer(f"{_LOST}+", text):
        a, b = m.span()
        lost += 1
        outside += not any(x < a and b < y for x, y in quoted)
    lost += out.count(_LOST) > text.count(_LOST)
    if stood:
        ends = sorted(stood)
        out = "".join(out[x + 1 : y] + stood.get(y, "") for x, y in zip([-1, *ends], [*ends, len(out)]))
    return Verdict(out, outside > 0, restored, lost, mistakes)


def _moved(stood: dict[int, str], edits: list[tuple[int, int, int]]) -> dict[int, str]:
    """Where references stand after ``edits`` (from, to, new length), in order; those inside an edit are gone."""
    if not stood:
        return stood
    kept, shift, i = {}, 0, 0
    for at in sorted(stood):
        while i < len(edits) and edits[i][1] <= at:
            shift += edits[i][2] - (edits[i][1] - edits[i][0])
            i += 1
        if i == len(edits) or at < edits[i][0]:
            kept[at + shift] = stood[at]
    return kept


_WIDE = {"gb18030", "big5", "shift_jis", "euc_kr"}


def _undo(text: str, a: int, b: int, only: tuple[str, str] | None, scorer: Scorer, gain: float = 0.0, left: float = 0.0) -> tuple[float, float, int, str, tuple[str, str]] | None:
    """(gain, share left, characters taken in after the run, new text, mistake) of the best mistake undone in a run; of ``only`` one where it is given.

    An encoding of two bytes may have drawn in the ASCII character after the run, so the run is also tried with it.
    """
    best = None
    gain, left, before = gain or scorer.s.gain, left or scorer.s.left, text[max(0, a - 1) : a]
    for y in (b, b + 1) if b < len(text) else (b,):
        run, after = text[a:y], text[y : y + 1]
        old = scorer.penalty(before + run + after)
        if old < gain:
            continue
        if only:
            tried = [(only, new) for new in _again(invert(run, *only), only)]
        else:
            tried = scorer.inversions(run)
        for mistake, new in tried:
            if y > b and not _WIDE & {*mistake}:
                continue
            now = scorer.penalty(before + new + after, min(left * old, old - gain, old - best[0] if best else old))
            if _LOST in new and _LOST not in run:
                now = min(now, old * left)  # the sign of a loss, itself wrongly decoded
            if old - now >= gain and now <= left * old and (best is None or old - now > best[0] + 1e-9):
                best = (old - now, now / old, y - b, new, mistake)
    return best


def _undo_any(text: str, a: int, b: int, scorer: Scorer):
    """``_undo`` of any mistake; for a short run, remembered with the characters around it, on which alone it depends."""
    if b - a > 12:
        return _undo(text, a, b, None, scorer)
    key = (text[max(0, a - 1) : a], text[a:b], text[b : b + 2])
    if key not in scorer.undone:
        if len(scorer.undone) >= _MEMORY:
            scorer.undone.clear()
        scorer.undone[key] = _undo(text, a, b, None, scorer)
    return scorer.undone[key]


def corpus_scores(df: DataFrame, text: str, s: Settings) -> Scorer:
    """Count, over all texts as ``examine`` sees them (``unescaped``), in how many each pair and each character stands."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        held, n = [], 0
        for t in batch.column(0).to_pylist():
            if t:
                codes = _codes(unescaped(t))
                # A character c is counted as the pair (0, c), so that one table holds both.
                held += [np.unique(_pairs(codes)), np.unique(codes)]
                n += len(held[-1]) + len(held[-2])
            if n > 1 << 19:
                yield np.concatenate(held)
                held, n = [], 0
        if held:
            yield np.concatenate(held)

    one = df.select(text)
    counts = hashed_counts(one, keys, s.pair_bits, 2)
    return Scorer(counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts, one.count(), s)


def repair(df: DataFrame, key: str, text: str, s: Settings = Settings()) -> DataFrame:
    """``key, restored_text, found, restored, lost, mistakes`` of every row with wrongly decoded text (``found``).

    ``restored`` runs were undone, ``lost`` ones can't be; ``mistakes`` names what was undone, as "right as wrong". Null and
    empty texts and ASCII texts without character references hold no trace and give no row.
    """
    scorer = corpus_scores(df, text, s)
    sent = df.sparkSession.sparkContext.broadcast((scorer.counts, scorer.total))  # 2 * 2**pair_bits cells, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Scorer(*sent.value, s)
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0), batch.column(1)):
                if (t := t.as_py()) and (not t.isascii() or "&#" in t) and (v := examine(t, mine)).found:
                    rows.append((k.as_py(), v.text, v.restored, v.lost, v.mistakes))
            cols = list(zip(*rows)) or [[]] * 5
            types = (batch.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, types)], [key, "restored_text", "restored", "lost", "mistakes"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, restored_text string, restored int, lost int, mistakes array<string>")
