import random
from itertools import combinations

import numpy as np
from corpusloom.llm import neardup

S3 = dict(words=3, similarity=0.6, least_words=40)


def rows(df):
    return {tuple(r) for r in df.collect()}


def found(spark, texts, s, **extra):
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in texts], "id bigint, text string, rep int, h string")
    pairs, balls, member = neardup.near_duplicates(df, "id", "text", s)
    return pairs, balls, member


def jaccard(a, b, k=3):
    x, y = (set(zip(*(t.lower().split()[i:] for i in range(k)))) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def brute(texts, t=0.6):
    return {(i, j) for (i, a), (j, b) in combinations(texts, 2) if jaccard(a, b) >= t}


def near_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(60)]
    for i in range(20):
        w = texts[i].split()
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(80)] = "edit"
        texts.append(" ".join(w))
    return list(enumerate(texts + [texts[0], texts[0].upper() + " ", texts[1]]))


def test_pairs_equal_brute_force(spark):
    texts = near_texts()
    s = neardup.Settings(**S3)
    odd = [(900, None), (901, ""), (902, "few words"), (903, "few words")]
    pairs, balls, member = found(spark, texts + odd, s)
    got = rows(neardup.written_out(pairs, balls, member, s))
    want = brute(texts)
    assert got <= want and (0, 80) in got and (80, 81) in got
    assert {p for p in want - got} <= {(60, i) for i in (80, 81, 82)}, "only what follows from a class of three"
    assert {r.rep for r in member.where("id IN (0, 80, 81)").collect()} == {0}
    of = {r.id: r.links for r in neardup.links(pairs, balls, member).collect()}
    assert of[0] == sum(1 for p in rows(pairs.select("a", "b")) if 0 in p) and of[902] == 0 and 900 not in of


def test_empty_tables(spark):
    s = neardup.Settings(**S3)
    pairs, balls, member = found(spark, [], s)
    assert neardup.written_out(pairs, balls, member, s).count() == member.count() == neardup.links(pairs, balls, member).count() == 0


def test_texts_that_repeat_their_blocks_differently(spark):
    rng = random.Random(7)
    blocks = [" ".join(rng.choices([f"b{i}" for i in range(400)], k=50)) for _ in range(8)]
    texts = [t for b in blocks for t in (" ".join([b] * 3), " ".join([b] * 40) + " end")]
    s = neardup.Settings(**S3)
    assert rows(neardup.written_out(*found(spark, list(enumerate(texts)), s), s)) == {(2 * i, 2 * i + 1) for i in range(8)}


def test_pairs_whose_common_part_is_boilerplate(spark):
    """Each text holds three of ten paragraphs, and 13 words of its own: what is shared is frequent, what is not is rare."""
    rng = random.Random(11)
    paragraphs = [" ".join(f"p{i}w{j}" for j in range(20)) for i in range(10)]
    texts = [(n, " ".join([*(paragraphs[i] for i in rng.sample(range(10), 3)), *(f"own{n}x{j}" for j in range(13))])) for n in range(600)]
    s = neardup.Settings(**S3)
    got = rows(neardup.written_out(*found(spark, texts, s), s))
    by_pages = {}
    for n, t in texts:
        by_pages.setdefault(frozenset(w[:2] for w in t.split() if w[0] == "p"), []).append((n, t))
    want = {p for group in by_pages.values() for p in brute(group)}
    assert len(want) > 500 and got <= want
    assert len(got) >= 0.95 * len(want)


def test_a_crowded_family_is_linked_through_leaders(spark):
    """A template family of texts that differ in one word: with blocks of 8 all of its bands are crowded."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base, other = rng.choices(words, k=120), rng.choices(words, k=120)
    family = [(i, " ".join([*base[: i % 100], f"n{i}", *base[i % 100 + 1 :]])) for i in range(60)]
    far = base[:76] + other[:44]  # linked with some of the family, but beyond half the distance
    texts = family + [(60 + i, " ".join([*far[: i * 9], f"m{i}", *far[i * 9 + 1 :]])) for i in range(6)] + [(70, " ".join(other))]
    s = neardup.Settings(**S3, block=8)
    pairs, balls, member = found(spark, texts, s)
    assert balls.count() >= 50
    assert pairs.count() < 60 * 59 / 8, "what a ball holds is not compared"
    want = brute(texts)
    assert rows(neardup.written_out(pairs, balls, member, s)) == want
    of = {r.id: r.links for r in neardup.links(pairs, balls, member).collect()}
    assert of == {i: sum(i in p for p in want) for i, _ in texts}


def test_a_class_of_a_third_of_all_rows(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    hot = " ".join(rng.choices(words, k=60))
    texts = [(i, hot if i % 3 == 0 else " ".join(rng.choices(words, k=60))) for i in range(6000)] + [(9000, hot + " end")]
    s = neardup.Settings(**S3)
    pairs, balls, member = found(spark, texts, s)
    assert member.where("rep = 0 AND copies = 2000").count() == 2000
    got = rows(neardup.written_out(pairs, balls, member, s))
    assert {(0, i) for i in range(3, 6000, 3)} <= got and (0, 9000) in got and len(got) < 3 * 2000 + 100


def test_samples_agree_as_the_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 2**63, 300, dtype=np.uint64))
    step = rng.integers(0, 16, 300)
    w = 1 + 8 * step / 15
    x, y = rng.permutation(300)[:220], rng.permutation(300)[:220]
    a = neardup.samples(h[np.sort(x)], step[np.sort(x)], 4096, 9.0)
    b = neardup.samples(h[np.sort(y)], step[np.sort(y)], 4096, 9.0, at_once=50)
    both, either = np.intersect1d(x, y), np.union1d(x, y)
    assert abs((a == b).mean() - w[both].sum() / w[either].sum()) < 0.05


def test_least_agreeing_is_below_what_a_pair_of_the_least_share_has():
    s = neardup.Settings(**S3)
    assert 0 < s.least_agreeing < s.rows * s.bands * s.similarity / (s.similarity + (1 - s.similarity) * s.heaviest)
