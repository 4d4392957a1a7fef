"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles.

Exact copies (equal word sequences) form one class and only its representative is compared. A representative's shingles
(runs of consecutive words; tf is 1, as the share asked for is one of sets) weigh by their idf, from counts over all texts,
bounded to [1, ``heaviest``]: so a pair whose common part is boilerplate and whose rest is rare can't fall far below its share.
Consistent weighted samples (Ioffe, 2010) make two texts agree in a sample with the probability of their weighted Jaccard
similarity; they are banded, texts that share a band are candidates. A candidate is verified by the weighted similarity
that its samples tell, then by the exact shingles.

Nothing is capped. A crowded band is first thinned by leaders: a text within half the allowed distance of a leader lies in
its ball, and as Jaccard distance is a metric, all texts of a ball are linked without comparing them. What lies in different balls,
or in none, is compared in blocks, spread over tasks, so no task holds a whole band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.prefix import running_sums
from corpusloom.llm.sketch import hashed_counts, lookup, mix
from corpusloom.operators.skew import join_counts
from corpusloom.session import materialize


@dataclass(frozen=True)
class Settings:
    words: int = 5  # words in a shingle
    similarity: float = 0.8  # least share of common shingles
    least_words: int = 0  # shorter texts have no partner
    rows: int = 4  # samples in a band
    bands: int = 40
    heaviest: float = 1.3  # weight of the rarest shingle; that of one in every text is 1
    idf_bits: int = 20  # cells of the shingle counts
    block: int = 512  # texts of a band that are compared in one block; a band of more is crowded
    rounds: int = 3  # rounds of leaders in crowded bands

    @property
    def least_agreeing(self) -> int:
        """Samples in which a pair of just the least share agrees, less six standard deviations: t / (t + (1 - t) heaviest) is the
        least weighted similarity of a pair with the share t."""
        n, t = self.rows * self.bands, self.similarity
        p = t / (t + (1 - t) * self.heaviest)
        return max(0, int(n * p - 6 * (n * p * (1 - p)) ** 0.5))


#: Cells of the random draws, by a shingle's hash, and steps of the weights: tables of fixed size instead of a generator per shingle.
_DRAWS, _STEPS = 1 << 14, 16


@lru_cache(maxsize=2)
def _draws(heaviest: float) -> tuple[np.ndarray, np.ndarray]:
    """Of every weight step and draw: ln a and the level t of Ioffe's sampling (r and c gamma-distributed, beta uniform)."""
    rng = np.random.default_rng(20240229)
    r, c, beta = rng.gamma(2.0, 1.0, _DRAWS), rng.gamma(2.0, 1.0, _DRAWS), rng.random(_DRAWS)
    weight = 1 + (heaviest - 1) * np.arange(_STEPS)[:, None] / (_STEPS - 1)
    level = np.floor(np.log(weight) / r + beta)
    return (np.log(c) - r * (level - beta) - r).astype(np.float32).ravel(), level.astype(np.int64).ravel()


class _Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 19:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text: lower-cased, split at white space."""
    found = text.lower().split() if text else []
    return np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))


def shingles(h: np.ndarray, k: int, least: int = 0) -> np.ndarray:
    """Hashes of all runs of ``k`` words, one per position, from the words' hashes; empty below ``least`` words."""
    n = len(h)
    if n < max(k, least, 1):
        return np.zeros(0, np.uint64)
    out = np.zeros(n - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i]
    return mix(out)


def steps(distinct: np.ndarray, counts: np.ndarray, total: int) -> np.ndarray:
    """The weight step of every shingle, by its idf."""
    idf = np.log1p(total / np.maximum(lookup(counts, distinct), 1))
    return np.minimum((idf * (_STEPS / np.log1p(total))).astype(np.int64), _STEPS - 1)


def samples(distinct: np.ndarray, step: np.ndarray, n: int, heaviest: float, at_once: int = 2048) -> np.ndarray:
    """``n`` consistent weighted samples of shingles in ascending order: of each, a hash of the drawn shingle and its level."""
    a_of, level_of = _draws(heaviest)
    salts = ((np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1))[:, None]
    best = np.full(n, np.inf, np.float32)
    sign = np.zeros(n, np.uint64)
    rows = np.arange(n)
    with np.errstate(over="ignore"):
        for at in range(0, len(distinct), at_once):  # in pieces, so that a very long text needs no more memory than a short one
            h = distinct[at : at + at_once]
            draw = ((salts * h[None, :]) >> np.uint64(50)).view(np.int64)
            draw += step[None, at : at + at_once] * _DRAWS
            a = a_of.take(draw)
            first = a.argmin(axis=1)
            least = a[rows, first]
            better = least < best
            best[better] = least[better]
            drawn = mix(h[first] ^ (level_of[draw[rows, first]].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)))
            sign[better] = drawn[better]
    return sign


def _band_keys(sign: np.ndarray, rows: int, bands: int) -> np.ndarray:
    key = np.zeros(bands, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(rows):
            key = mix(key * np.uint64(31) + sign[i * bands : (i + 1) * bands], i)
        return (key + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def signatures(texts: DataFrame, s: Settings) -> DataFrame:
    """``id, h, long, bands, sketch`` of every text of ``texts(id, text)``: 128 bits of its word sequence, whether it has
    ``least_words``, its band keys and a byte of each sample (null if it has no shingle). Two passes."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        held, n = [], 0
        for t in batch.column(0).to_pylist():
            if len(found := np.unique(shingles(word_hashes(t), s.words, s.least_words))):
                held.append(found)
                n += len(found)
            if n > 1 << 19:
                yield np.concatenate(held)
                held, n = [], 0
        if held:
            yield np.concatenate(held)

    total = texts.count()
    table = hashed_counts(texts.select("text"), keys, s.idf_bits)
    sent = texts.sparkSession.sparkContext.broadcast(table.clip(max=(1 << 32) - 1).astype(np.uint32))  # 2**idf_bits cells, whatever the data

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for batch in batches:
            whole, long, bands, sketches = [], [], [], []
            for t in batch.column(1).to_pylist():
                words = word_hashes(t)
                whole.append(xxhash.xxh3_128_digest(words.tobytes()))
                long.append(len(words) >= s.least_words)
                if len(distinct := np.unique(shingles(words, s.words, s.least_words))):
                    signs = samples(distinct, steps(distinct, counts, total), s.rows * s.bands, s.heaviest)
                    bands.append(_band_keys(signs, s.rows, s.bands))
                    sketches.append(signs.astype(np.uint8).tobytes())
                else:
                    bands.append(None)
                    sketches.append(None)
            cols = [batch.column(0), pa.array(whole, pa.binary()), pa.array(long), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "h", "long", "bands", "sketch"])

    return materialize(texts.mapInArrow(sign, "id bigint, h binary, long boolean, bands array<bigint>, sketch binary"), "signs")


def classes(signs: DataFrame) -> DataFrame:
    """``id, rep, copies, long``: the class of every text, by its word sequence. The representative is the smallest id.

    Counts per hash are pre-aggregated; a class of more than one text in 1024 gets its representative without a shuffle.
    """
    keys = signs.select("id", "h", "long")
    reps = materialize(keys.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "reps")
    return join_counts(keys, reps, "h", "copies").select("id", "rep", "copies", "long")


class Verifier:
    """Exact shares of pairs of texts. The sets of shingles are made once for all texts that take part in a pair."""

    def __init__(self, texts: DataFrame, signs: DataFrame, s: Settings):
        self.texts, self.signs, self.s = texts, signs.select("id", "sketch"), s

    def shares(self, pairs: DataFrame, least: float) -> DataFrame:
        """``a, b, weighted, shared`` of the pairs ``a, b`` that share at least ``least``; ``weighted`` is the similarity that the samples tell."""
        s = self.s
        mine, theirs = self.signs.toDF("a", "sa"), self.signs.toDF("b", "sb")
        agreeing = s.least_agreeing

        def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = s.rows * s.bands
            for batch in batches:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, n) for c in batch.columns[2:])
                same = (x == y).sum(axis=1)
                keep = pa.array(same >= agreeing)
                cols = [batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(same[same >= agreeing] / n)]
                yield pa.RecordBatch.from_arrays(cols, ["a", "b", "weighted"])

        near = pairs.join(mine, "a").join(theirs, "b").select("a", "b", "sa", "sb").mapInArrow(likely, "a bigint, b bigint, weighted double")
        near = materialize(near, "candidates")
        ends = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [np.unique(shingles(word_hashes(t), s.words, s.least_words)).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "set"])

        made = materialize(self.texts.join(ends, "id", "left_semi").mapInArrow(sets, "id bigint, set binary"), "sets")
        both = near.join(made.toDF("a", "x"), "a").join(made.toDF("b", "y"), "b").select("a", "b", "weighted", "x", "y")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shared = []
                for x, y in zip(batch.column(3), batch.column(4)):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    n = len(np.intersect1d(x, y, assume_unique=True))
                    shared.append(n / (len(x) + len(y) - n))
                shared = np.array(shared, np.float64)
                keep = pa.array(shared >= least - 1e-9)
                yield pa.RecordBatch.from_arrays([*(c.filter(keep) for c in batch.columns[:3]), pa.array(shared).filter(keep)], ["a", "b", "weighted", "shared"])

        return materialize(both.mapInArrow(verify, "a bigint, b bigint, weighted double, shared double"), "shares")


def _leaders(crowd: DataFrame, verifier: Verifier, s: Settings) -> DataFrame:
    """``id, ball`` of the texts of crowded bands ``crowd(id, band)`` that lie within half the allowed distance of a leader.

    A round takes the smallest id of every band that is still crowded; a text is compared with the smallest leader of its bands.
    Two texts of a ball are at most the allowed distance apart, by the triangle inequality.
    """
    spark = crowd.sparkSession
    found = spark.createDataFrame([], "id bigint, ball bigint")
    for _ in range(s.rounds):
        bands = materialize(crowd.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("n")), "bands")
        led = join_counts(crowd, bands, "band", "n", F.col("n") > s.block).groupBy("id").agg(F.min("leader").alias("leader"))
        led = materialize(led, "led")
        if led.isEmpty():
            break
        near = verifier.shares(led.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")), (1 + s.similarity) / 2)
        inside = near.select(F.col("b").alias("id"), F.col("a").alias("ball"))
        found = found.unionByName(inside)
        # A leader stays with its own ball; it and all it holds take no part in the next round.
        gone = inside.select("id").unionByName(led.where("id = leader").select("id"))
        crowd = materialize(crowd.join(gone, "id", "left_anti"), "crowd")
    return materialize(found, "balls")


def similar_classes(texts: DataFrame, signs: DataFrame, member: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """``a, b, weighted, shared``, the pairs of representatives whose share of common shingles reaches the least, but for those
    inside a ball; and ``id, ball`` of the representatives in a ball, ``ball`` being its leader."""
    reps = member.where("id = rep").select("id")
    banded = signs.where("bands IS NOT NULL").select("id", "bands").join(reps, "id", "left_semi").select("id", F.explode("bands").alias("band"))
    banded = materialize(banded, "banded")
    shared = materialize(banded.groupBy("band").agg(F.count("*").alias("n")), "shared")
    verifier = Verifier(texts, signs, s)
    few = banded.join(shared.where(F.col("n").between(2, s.block)), "band").select("id", "band")
    left, right = few.toDF("a", "band"), few.toDF("b", "band")
    candidates = left.join(right, "band").where("a < b").select("a", "b")

    balls = None
    if shared.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] > s.block:
        crowd = materialize(join_counts(banded, shared, "band", "n", F.col("n") > s.block).select("id", "band"), "crowd")
        balls = _leaders(crowd, verifier, s)
        home = balls.unionByName(balls.select(F.col("ball").alias("id"), "ball")).groupBy("id").agg(F.min("ball").alias("ball"))
        placed = crowd.join(home, "id", "left").withColumn("ball", F.coalesce("ball", F.lit(-(2**63)).cast("bigint")))
        groups = placed.groupBy("band", "ball").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks"))
        groups = materialize(groups, "groups")
        mine = placed.join(groups, ["band", "ball"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        other = groups.select("band", F.col("ball").alias("ball2"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block2"))
        outside = F.lit(-(2**63)).cast("bigint")
        told = mine.join(other, "band").where((F.col("ball") != F.col("ball2")) | (F.col("ball") == outside))
        here, there = F.struct("ball", "block"), F.struct(F.col("ball2").alias("ball"), F.col("block2").alias("block"))
        told = told.select("id", "band", F.least(here, there).alias("low"), F.greatest(here, there).alias("high"))
        meet = told.withColumnRenamed("id", "a").join(told.withColumnRenamed("id", "b"), ["band", "low", "high"])
        candidates = candidates.unionByName(meet.where("a < b").select("a", "b"))
    candidates = candidates.distinct()
    if balls is not None:  # what a ball holds is linked already
        balls_of = balls.toDF("id", "ball")
        candidates = candidates.join(balls_of.toDF("a", "ball_a"), "a", "left").join(balls_of.toDF("b", "ball_b"), "b", "left")
        known = (F.col("ball_a") == F.col("ball_b")) | (F.col("ball_a") == F.col("b")) | (F.col("ball_b") == F.col("a"))
        candidates = candidates.where(~F.coalesce(known, F.lit(False))).select("a", "b")
    else:
        balls = texts.sparkSession.createDataFrame([], "id bigint, ball bigint")
    return verifier.shares(candidates, s.similarity), balls


def near_duplicates(df: DataFrame, key: str, text: str, s: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The links between class representatives and who stands for whom, of any size without writing out a group:

    - ``a, b, weighted, shared``: verified pairs of representatives;
    - ``id, ball``: representatives that are linked with ``ball`` and with each other one of the same ball;
    - ``id, rep, copies, long``: the class of every text.

    Null texts belong to no class. Texts of fewer than ``least_words`` words (not ``long``) are in a class but have no partners.
    """
    texts = df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    signs = signatures(texts, s)
    member = materialize(classes(signs), "classes")
    return *similar_classes(texts, signs, member, s), member


def written_out(pairs: DataFrame, balls: DataFrame, member: DataFrame, s: Settings) -> DataFrame:
    """``a, b`` with a < b, by one rule at every size: linked classes and the copies of a class as pairs of rows.

    The texts of a class are ranked, the representative first and the others in a seeded order. Of a class, the first is paired
    with every other one, and neighbours in rank; of two linked classes, those whose ranks differ by one at most. That is every pair of classes
    of up to two texts, and all pairs within classes of up to three; the pairs it leaves out follow from the class links and the
    membership. So a class of a third of all rows gives at most two rows a copy and three a copy of the smaller linked class.
    """
    held = balls.unionByName(balls.select("ball", "ball").distinct().toDF("id", "ball"))
    sizes = held.groupBy("ball").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks"))
    told = held.join(sizes, "ball").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    told = told.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    told = told.select("id", "ball", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    inside = told.withColumnRenamed("id", "a").join(told.withColumnRenamed("id", "b"), ["ball", "low", "high"]).where("a < b").select("a", "b").distinct()
    linked = pairs.select("a", "b").unionByName(inside)

    several = member.where("long AND copies > 1")
    others = several.where("id <> rep").select("id", "rep", "copies", F.lit(1).cast("bigint").alias("one"))
    others = running_sums(others, "rep", "one", "id", out="before").select("id", "rep", (F.col("before") + 1).alias("rank"), "copies")
    firsts = several.where("id = rep").select("id", "rep", F.lit(0).cast("bigint").alias("rank"), "copies")
    ranked = materialize(firsts.unionByName(others), "ranked")
    first = ranked.where("rank > 0").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    after = ranked.where("rank > 1").select("rep", (F.col("rank") - 1).alias("rank"), F.col("id").alias("next"))
    neighbours = ranked.where("rank > 0").join(after, ["rep", "rank"]).select(F.least("id", "next").alias("a"), F.greatest("id", "next").alias("b"))
    # Copies meet those of a linked class by rank; the key holds the rank, so that a large class is spread.
    sizes = ranked.where("rank = 0").select("rep", "copies")
    most = linked.join(sizes.toDF("a", "n"), "a", "left").join(sizes.toDF("b", "m"), "b", "left").fillna(1, ["n", "m"]).where("n > 1 OR m > 1")
    near = F.expr("least(n, m)")
    steps = most.withColumn("i", F.explode(F.sequence(F.lit(0), near))).withColumn("j", F.explode(F.sequence(F.greatest(F.col("i") - 1, F.lit(0)), F.col("i") + 1)))
    steps = steps.where("(i > 0 OR j > 0) AND i < n AND j < m").select("a", "b", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"))
    of = ranked.select("rep", "rank", "id")
    left = steps.join(of.toDF("a", "i", "x"), ["a", "i"], "left")
    both = left.join(of.toDF("b", "j", "y"), ["b", "j"], "left")
    x, y = F.coalesce("x", "a"), F.coalesce("y", "b")
    across = both.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    return linked.unionByName(first).unionByName(neighbours).unionByName(across)


def links(pairs: DataFrame, balls: DataFrame, member: DataFrame) -> DataFrame:
    """``id, rep, copies, links`` of every text: its class, and the number of other classes that are linked with it."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n"))
    sizes = balls.groupBy("ball").agg(F.count("*").alias("n"))  # without the leader
    own = balls.join(sizes, "ball").select(F.col("id").alias("rep"), "n").unionByName(sizes.select(F.col("ball").alias("rep"), "n"))
    every = ends.unionByName(own).groupBy("rep").agg(F.sum("n").alias("links"))
    return member.where("id = rep").select("rep").join(every, "rep").join(member, "rep", "right").select("id", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"))
