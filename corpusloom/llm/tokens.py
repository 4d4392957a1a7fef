"""Encoding a corpus with a public byte-level BPE, exactly, through a transducer lexicon of its frequent words.

A text is cut before every space that a character other than white space follows; the tokenizer's own pattern always begins
a word there, so the cut pieces ("chunks") are encoded one by one. Texts are cut and their chunks told apart inside Arrow. The
frequent chunks of the whole corpus, with their ids, are compiled into a minimal acyclic transducer that every worker maps
into memory; any other chunk is cut by the tokenizer's pattern and its unseen words are merged by rank.

An empty or null text has the empty list of ids. Texts are used whole. Lone surrogates, which UTF-8 can't hold, count as U+FFFD.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.lexicon import LONGEST, Lexicon
from corpusloom.session import materialize, shared_dir

#: Where the vocabulary files lie; they are never copied.
TOKENIZERS = os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the word pattern of the public byte-level BPE vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for text in ASCII, which the standard library matches faster.
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: The size of the lexicon, and of a partition's summary while counting (both bound what is collected).
LEXICON_WORDS, SUMMARY_WORDS = 1 << 16, 1 << 16
#: Entries of a worker's memory of merged words, after which it begins anew.
MEMORY = 1 << 18

_START = re.compile(r"(?= \S)")
#: A space that white space or nothing follows (all that may count as white space): such texts are cut outside Arrow.
_UNUSUAL = r" ([\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"


def chunks(text: str) -> list[str]:
    """Pieces of a text that the tokenizer encodes independently; joined they are the text. All but the first begin with a space."""
    return _START.split(text)


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The chunks of texts without their leading space, where each text's chunks begin (and the last ends), and the order of
    the texts. A text's first chunk is as it stands, and may be empty."""
    texts = texts.fill_null("")
    unusual = pc.match_substring_regex(texts, _UNUSUAL).to_numpy(zero_copy_only=False)
    order = np.concatenate([np.flatnonzero(~unusual), np.flatnonzero(unusual)])
    usual = pc.split_pattern(texts.take(pa.array(np.flatnonzero(~unusual))), " ")
    values, starts = usual.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(usual).to_numpy(zero_copy_only=False))]).astype(np.int64)
    rest = [chunks(t.decode("utf-8", "replace")) for t in texts.take(pa.array(np.flatnonzero(unusual))).cast(pa.binary()).to_pylist()]
    if rest:
        more = pa.array([c[1:] if i else c for r in rest for i, c in enumerate(r)], pa.string())
        values = pa.concat_arrays([values, more])
        starts = np.concatenate([starts, starts[-1] + np.cumsum([len(r) for r in rest])])
    return values, starts, order


class BytePairEncoder:
    """Exact merging by rank, with a bounded memory of words."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.words = regex.compile(PATTERN)
        self.ascii_words = re.compile(ASCII_PATTERN, re.ASCII)
        self.known: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of the lowest rank is joined first, the leftmost of equals, by a heap (n log n)."""
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        parts = [word[i : i + 1] for i in range(len(word))]
        n = len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or parts[i] + parts[j] != joined:
                continue
            parts[i], alive[j], after[i] = joined, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return [ranks[parts[i]] for i in range(n) if alive[i]]

    def encode(self, chunk: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for word in (self.ascii_words if chunk.isascii() else self.words).findall(chunk):
            ids = known.get(word)
            if ids is None:
                ids = self.merge(word.encode("utf-8", "replace"))
                if len(word) <= 64:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[word] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    return BytePairEncoder(path)


@lru_cache(maxsize=2)
def _mapped(path: str) -> Lexicon:
    return Lexicon.view(np.memmap(path, np.uint8, "r"))


def frequent_chunks(df: DataFrame, text: str) -> list[bytes]:
    """The most frequent chunks of the whole corpus, by bounded frequent-item summaries of its partitions, merged."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for part in _slices(batch.column(0)):
                found = pc.value_counts(cut(part)[0])
                short = found.filter(pc.and_(pc.less_equal(pc.binary_length(found.field(0)), LONGEST), pc.greater(pc.binary_length(found.field(0)), 0)))
                for w, n in zip(short.field(0).cast(pa.binary()).to_pylist(), short.field(1).to_pylist()):
                    counts[w] = counts.get(w, 0) + n
            while len(counts) > 4 * SUMMARY_WORDS:  # as Misra and Gries: what is frequent in all survives
                least = int(np.median(np.fromiter(counts.values(), np.int64)))
                counts = {w: n - least for w, n in counts.items() if n > least}
        top = sorted(((n, w) for w, n in counts.items() if n > 1), reverse=True)[:SUMMARY_WORDS]
        yield pa.RecordBatch.from_arrays([pa.array([w for _, w in top], pa.binary()), pa.array([n for n, _ in top], pa.int64())], ["word", "n"])

    merged = df.select(text).mapInArrow(summarise, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    merged = materialize(merged.withColumn("step", F.floor(F.log2("n") * 16).cast("int")), "words")
    # The most frequent words by steps of their counts, so that no task and no driver sorts candidates of every partition.
    room, lowest = LEXICON_WORDS, 1 << 30
    for r in sorted(merged.groupBy("step").agg(F.count("*").alias("k")).collect(), key=lambda r: -r.step):  # at most 16 steps a doubling
        if r.k > room:
            break
        room, lowest = room - r.k, r.step
    return [bytes(r.word) for r in merged.where(F.col("step") >= lowest).select("word").collect()]  # at most LEXICON_WORDS


def compile_lexicon(df: DataFrame, text: str, vocabulary: str) -> tuple[str, object]:
    """Compile the corpus' frequent chunks into a transducer; returns (path to map, None) or, where the shared folder is no
    mounted one, ("", the broadcast bytes). At most a few MB, by the bounds above."""
    spark: SparkSession = df.sparkSession
    merge = BytePairEncoder(vocabulary)
    words = {w: merge.encode(" " + w.decode("utf-8", "replace")) for w in frequent_chunks(df, text)}
    raw = Lexicon.build(words).to_bytes()
    there = urlparse(shared_dir(spark))
    if there.scheme in ("", "file"):
        os.makedirs(there.path, exist_ok=True)
        path = f"{there.path}/lexicon-{uuid.uuid4().hex}"
        with open(path, "wb") as f:
            f.write(raw)
        return path, None
    return "", spark.sparkContext.broadcast(raw)


def _encoded(texts: pa.Array, lexicon: Lexicon, bpe: BytePairEncoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of the texts, one text after the other in some order, the number of ids of each, and that order."""
    values, starts, order = cut(texts)
    coded = values.dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    heads = values.take(pa.array(starts[:-1])).dictionary_encode()  # first chunks stand without a space
    codes[starts[:-1]] = len(words) + heads.indices.to_numpy()
    number = lexicon.numbers(words)
    unseen = np.flatnonzero(number < 0)
    merged = [bpe.encode(" " + w.decode("utf-8", "replace")) for w in words.take(pa.array(unseen)).cast(pa.binary()).to_pylist()]
    merged += [bpe.encode(w.decode("utf-8", "replace")) for w in heads.dictionary.cast(pa.binary()).to_pylist()]
    # One table of ids of this batch's distinct chunks: the lexicon's, then the merged ones.
    own = np.concatenate([unseen, np.arange(len(words), len(words) + len(heads.dictionary))])
    start, size = np.zeros(len(words) + len(heads.dictionary), np.int64), np.zeros(len(words) + len(heads.dictionary), np.int64)
    seen = np.flatnonzero(number >= 0)
    start[seen] = lexicon.offsets[number[seen]]
    size[seen] = lexicon.offsets[number[seen] + 1].astype(np.int64) - start[seen]
    extra = np.fromiter(map(len, merged), np.int64, len(merged))
    size[own] = extra
    start[own] = len(lexicon.ids) + np.cumsum(extra) - extra
    table = np.concatenate([lexicon.ids, np.array(list(chain.from_iterable(merged)), np.int32)])
    size, start = size[codes], start[codes]
    ends = np.cumsum(size)
    ids = table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]
    return ids, np.diff(np.concatenate([[0], ends])[starts]), order


#: Bytes of text that are encoded at once, which bounds a worker's memory.
STEP = 8_000_000


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in runs of about ``STEP`` bytes."""
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + STEP, "right")))
        yield texts.slice(at, end - at)
        at = end


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = "", count_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, ids`` (or ``key, tokens``, their number) and the columns ``keep`` of every row; the rows' order and number are kept.

    ``vocabulary`` is the path of a file of ranks; by default ``byte_bpe_50k``. No special tokens are added, and their
    strings in a text are ordinary text.
    """
    vocabulary = vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    df = df.select(key, text, *keep)
    path, sent = compile_lexicon(df, text, vocabulary)
    name = "tokens" if count_only else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _mapped(path) if path else Lexicon.view(np.frombuffer(sent.value, np.uint8))
        bpe = encoder(vocabulary)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1)):
                ids, sizes, order = _encoded(texts, lexicon, bpe)
                back = np.empty(len(order), np.int64)
                back[order] = np.arange(len(order))
                if count_only:
                    out = pa.array(sizes[back], pa.int64())
                else:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())).take(pa.array(back))
                rows = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([rows.column(0), out, *rows.columns[2:]], [key, name, *keep])

    kept = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {name} {'bigint' if count_only else 'array<int>'}{kept}")
