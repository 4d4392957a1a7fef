"""Best representative of each duplicate group: a latent two-sided quality model.

A source that covers an entity either asserts a fact about it or, by giving another value or none, denies it: the fact's votes. Sensitivity (how often a source asserts what is true) and specificity (how often it stays away
from what is false) of every source are inferred together with the truth of the facts by expectation-maximisation, so a
field may keep several values judged true. A source of few claims leans on what is learned of its kind. Facts with the same
sources for and against are one pattern: the EM runs over pattern counts, on the driver while they are few (``FEW``), else in
Spark, by the same steps; neither limits anything.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.skew import join_counts
from corpusloom.session import materialize

#: Patterns and votes up to which the EM runs on the driver (some 50 MB).
FEW = 200_000
#: Pseudo-counts of what is known before of a kind of source, as (hits, misses), and of a source by its kind.
SENSITIVITY, SPECIFICITY, KIND = (8.0, 2.0), (9.0, 1.0), 20.0
#: The share of facts that are true, at first.
PREVALENCE = 0.5
_LEAST = 0.005
#: No file of these trees is older; the epochs of common file systems lie before it.
EARLIEST = "1981-01-01 00:00:00"

# Marks of copies, backups and leftovers in file names and directories.
COPY_NAME = (
    r"(?i)^(copy|kopie|copie|copia|cópia|копия) (\(\d+\) )?(of|von|de|do) "
    r"|[ _.-]+(copy|kopie|copie|copia|cópia|копия|副本|复件|backup|bak|old|orig)([ _-]?\(?\d*\)?)?(\.[A-Za-z0-9]{1,5})?$"
    r"| ?\(\d{1,3}\)(\.[A-Za-z0-9]{1,5})?$"
    r"|\.(bak|old|orig|tmp|temp|swp|save|part|crdownload)$|~$|^~\$|^\.#|^#.*#$"
)
COPY_DIR = r"(?i)(^|/)(old|alt|backups?|bak|\.?trash(-\d+)?|\$recycle\.bin|tmp|temp|lost\+found|copies|duplicates?|deleted)/"


def marked_path(path: Column) -> Column:
    """Whether a path marks its file as a copy, backup or leftover."""
    p = F.regexp_replace(path, r"\\", "/")
    return F.element_at(F.split(p, "/"), -1).rlike(COPY_NAME) | p.rlike(COPY_DIR)


def possible(date: Column, seen: Column) -> Column:
    """The date if it can be true (not before ``EARLIEST``, not a day after the row was loaded), else null."""
    late = F.coalesce(seen + F.expr("INTERVAL 1 DAY"), F.lit("9999-01-01").cast("timestamp_ntz"))
    return F.when((date >= F.lit(EARLIEST).cast("timestamp_ntz")) & (date <= late), date)


def filled(text: Column) -> Column:
    return F.when(F.trim(text) != "", F.trim(text))


def members(groups: DataFrame, catalog: DataFrame, trees: DataFrame) -> DataFrame:
    """The catalog rows of each group, each once, with cleaned fields. Ids that the catalog lacks give no row."""
    ids = groups.select("group_id", F.explode(F.array_distinct("files")).alias("scan_row_id")).where("scan_row_id IS NOT NULL").distinct()
    rows = catalog.select(
        "scan_row_id",
        "tree_id",
        "rel_path",
        possible(F.col("mtime"), F.col("loaded_at")).alias("mtime"),
        possible(F.col("ctime"), F.col("loaded_at")).alias("ctime"),
        filled(F.col("kind")).alias("kind"),
        filled(F.col("content_hash_algo")).alias("content_hash_algo"),
    )
    trust = trees.select("tree_id", "trust")
    return ids.join(rows, "scan_row_id").join(trust, "tree_id", "left")


def _kind(source: str) -> str:
    return source.split("@")[0]


Rivalry = Callable[[np.ndarray], np.ndarray]


def _em(patterns: list[tuple[str, list[str], int]], rounds: int, prevalence: float, rivalry: Rivalry | None = None) -> tuple[np.ndarray, np.ndarray, dict[tuple[str, str], tuple[float, float]]]:
    """Truth and log-odds of every pattern ``(field, votes, n)`` and quality of every (field, source).

    Facts are judged each by itself, or, with ``rivalry``, as it shares the truth of an entity out among them (from log-odds of
    the patterns to their mean truth).
    """
    at = {}
    rows, cols, said = [], [], []
    for i, (field, votes, _) in enumerate(patterns):
        for v in votes:
            rows.append(i)
            cols.append(at.setdefault((field, v[:-1]), len(at)))
            said.append(v[-1] == "+")
    rows, cols, said = np.array(rows, np.int64), np.array(cols, np.int64), np.array(said, bool)
    n = np.array([p[2] for p in patterns], np.float64)
    fields = {f: i for i, f in enumerate(sorted({p[0] for p in patterns}))}
    of = np.array([fields[p[0]] for p in patterns], np.int64)
    kinds: dict[tuple[str, str], int] = {}
    kind = np.array([kinds.setdefault((f, _kind(s)), len(kinds)) for f, s in at], np.int64)
    sens = np.full(len(at), SENSITIVITY[0] / sum(SENSITIVITY))
    spec = np.full(len(at), SPECIFICITY[0] / sum(SPECIFICITY))
    share = np.full(len(fields), prevalence)
    truth = odds = np.zeros(len(n))
    for i in range(rounds + 1):
        weight = np.where(said, np.log(sens / (1 - spec))[cols], np.log((1 - sens) / spec)[cols])
        odds = np.log(share / (1 - share))[of] + np.bincount(rows, weight, len(n))
        if i == rounds and rivalry is not None:
            break
        truth = rivalry(odds) if rivalry is not None else 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if i == rounds:
            break
        t, f = (truth * n)[rows], ((1 - truth) * n)[rows]
        tp, fn, fp, tn = (np.bincount(cols, w, len(at)) for w in (t * said, t * ~said, f * said, f * ~said))

        def quality(hit: np.ndarray, miss: np.ndarray, prior: tuple[float, float]) -> np.ndarray:
            known = np.bincount(kind, hit, len(kinds)) + prior[0], np.bincount(kind, miss, len(kinds)) + prior[1]
            usual = (known[0] / (known[0] + known[1]))[kind]
            return np.clip((hit + KIND * usual) / (hit + miss + KIND), _LEAST, 1 - _LEAST)

        sens, spec = quality(tp, fn, SENSITIVITY), quality(tn, fp, SPECIFICITY)
        true, every = np.bincount(of, truth * n, len(fields)), np.bincount(of, n, len(fields))
        share = np.clip((true + prevalence) / (every + 1), _LEAST, 1 - _LEAST)
    return truth, odds, {key: (float(sens[j]), float(spec[j])) for key, j in at.items()}


def _em_spread(patterns: DataFrame, rounds: int, prevalence: float) -> tuple[DataFrame, DataFrame]:
    """``_em`` in Spark, for any number of patterns and sources: ``field, votes, truth`` and ``field, source, sens, spec``."""
    vote = F.col("vote")
    ballots = patterns.select("field", "votes", "n", F.explode("votes").alias("vote")).select(
        "field", "votes", "n", F.expr("left(vote, length(vote) - 1)").alias("source"), vote.endswith("+").alias("said")
    )
    ballots = materialize(ballots, "ballots")
    quality = ballots.select("field", "source").distinct().withColumns({"sens": F.lit(SENSITIVITY[0] / sum(SENSITIVITY)), "spec": F.lit(SPECIFICITY[0] / sum(SPECIFICITY))})
    share = patterns.select("field").distinct().withColumn("share", F.lit(prevalence))

    def judge() -> DataFrame:
        weight = F.when(F.col("said"), F.log(F.col("sens") / (1 - F.col("spec")))).otherwise(F.log((1 - F.col("sens")) / F.col("spec")))
        odds = ballots.join(quality, ["field", "source"]).groupBy("field", "votes", "n").agg(F.sum(weight).alias("odds")).join(share, "field")
        return odds.select("field", "votes", "n", (1 / (1 + F.exp(-(F.col("odds") + F.log(F.col("share") / (1 - F.col("share"))))))).alias("truth"))

    for _ in range(rounds):
        truth = materialize(judge(), "truth")
        each = truth.select("field", "truth", "n", F.explode("votes").alias("vote"))
        t, f, yes = F.col("truth") * F.col("n"), (1 - F.col("truth")) * F.col("n"), vote.endswith("+")
        stats = each.groupBy("field", F.expr("left(vote, length(vote) - 1)").alias("source")).agg(
            F.sum(F.when(yes, t).otherwise(0.0)).alias("tp"), F.sum(F.when(~yes, t).otherwise(0.0)).alias("fn"), F.sum(F.when(yes, f).otherwise(0.0)).alias("fp"), F.sum(F.when(~yes, f).otherwise(0.0)).alias("tn")
        )
        stats = stats.withColumn("kind", F.split("source", "@")[0])
        usual = stats.groupBy("field", "kind").agg(*(F.sum(c).alias("u" + c) for c in ("tp", "fn", "fp", "tn")))

        def shrunk(hit: str, miss: str, prior: tuple[float, float]) -> Column:
            mean = (F.col("u" + hit) + prior[0]) / (F.col("u" + hit) + F.col("u" + miss) + sum(prior))
            got = (F.col(hit) + KIND * mean) / (F.col(hit) + F.col(miss) + KIND)
            return F.least(F.greatest(got, F.lit(_LEAST)), F.lit(1 - _LEAST))

        quality = materialize(stats.join(usual, ["field", "kind"]).select("field", "source", shrunk("tp", "fn", SENSITIVITY).alias("sens"), shrunk("tn", "fp", SPECIFICITY).alias("spec")), "quality")
        part = (F.sum(F.col("truth") * F.col("n")) + prevalence) / (F.sum("n") + 1)
        share = materialize(truth.groupBy("field").agg(F.least(F.greatest(part, F.lit(_LEAST)), F.lit(1 - _LEAST)).alias("share")), "share")
    return judge().select("field", "votes", "truth"), quality


def votes_of(claims: DataFrame) -> DataFrame:
    """``entity, field, fact, votes`` of ``claims(entity, field, fact, source, said)``, one row per source and fact."""
    votes = F.array_sort(F.collect_list(F.concat(F.col("source"), F.when(F.col("said"), "+").otherwise("-"))))
    # collect_list per fact holds at most one vote per source, so it is bounded by the number of sources.
    return claims.groupBy("entity", "field", "fact").agg(votes.alias("votes"))


def quality_model(facts: DataFrame, rounds: int = 5, prevalence: float = PREVALENCE, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """Truth of facts and quality of sources from ``facts(entity, field, fact, votes)``; a vote is a source and ``+`` or ``-``.

    A source is named ``kind@which``; its quality leans on that of its kind. Returns ``(entity, field, fact, truth)`` and
    ``(field, source, sens, spec)``. A field's facts without any claim give no row; one claim alone is judged by the priors.
    """
    spark = facts.sparkSession
    facts = materialize(facts.select("entity", "field", "fact", "votes"), "facts")
    patterns = materialize(facts.groupBy("field", "votes").agg(F.count("*").alias("n")), "patterns")
    ballots = patterns.agg(F.coalesce(F.sum(F.size("votes")), F.lit(0))).first()[0]
    if ballots <= few:
        held = [(r.field, r.votes, r.n) for r in patterns.collect()]
        truths, _, quality = _em(held, rounds, prevalence) if held else (np.zeros(0), None, {})
        judged = spark.createDataFrame([(f, v, n, t) for (f, v, n), t in zip(held, truths.tolist())], "field string, votes array<string>, n bigint, truth double")
        known = spark.createDataFrame([(*k, *q) for k, q in quality.items()], "field string, source string, sens double, spec double")
        joined = facts.join(F.broadcast(judged.drop("n")), ["field", "votes"])  # at most ``few`` rows
    else:
        judged, known = _em_spread(patterns, rounds, prevalence)
        counted = materialize(patterns.join(judged, ["field", "votes"]).select(F.xxhash64("field", "votes").alias("p"), "n", "truth", F.col("field").alias("f"), F.col("votes").alias("v")), "judged")
        joined = join_counts(facts.withColumn("p", F.xxhash64("field", "votes")), counted, "p", "n").where("field = f AND votes = v")
    return joined.select("entity", "field", "fact", "truth"), known


#: The four respects in which a row may be the best of its group. Each, in each tree, is a source of the field ``survivor``: the
#: latest time of a tree that copies everything says less than that of one which seldom has it.
RESPECTS = ("complete", "recent", "trusted", "unmarked")


def respect_votes(rows: DataFrame) -> DataFrame:
    """Of every row of a group, each respect says, as a source of the row's tree, whether no other row beats it."""
    gaps = sum((F.col(c).isNull().cast("int") for c in ("mtime", "ctime", "kind", "content_hash_algo")), F.lit(0))
    at = F.coalesce(F.unix_micros(F.col("mtime").cast("timestamp")), F.lit(-(2**62)))
    scored = rows.select(
        "group_id",
        "scan_row_id",
        F.coalesce(F.col("tree_id").cast("string"), F.lit("?")).alias("tree"),
        (-gaps).cast("long").alias("complete"),
        at.alias("recent"),
        F.coalesce(F.col("trust"), F.lit(-(2**31))).cast("long").alias("trusted"),
        (~F.coalesce(marked_path(F.col("rel_path")), F.lit(True))).cast("long").alias("unmarked"),
    )
    best = scored.groupBy("group_id").agg(F.count("*").alias("n"), *(F.max(c).alias(f"best_{c}") for c in RESPECTS))
    votes = F.array(*(F.concat(F.lit(f"{c}@"), F.col("tree"), F.when(F.col(c) == F.col(f"best_{c}"), "+").otherwise("-")) for c in RESPECTS))
    told = join_counts(scored, materialize(best, "best"), "group_id", "n")
    return told.select(F.col("group_id").alias("entity"), F.lit("survivor").alias("field"), F.col("scan_row_id").cast("string").alias("fact"), votes.alias("votes"))


FIELDS = ("mtime", "ctime", "kind", "content_hash_algo", "rel_path")


def field_votes(rows: DataFrame) -> DataFrame:
    """Each tree asserts the values that its rows give for a field of the group, and denies the group's other values.

    The arrays hold trees, never rows. A group of many values is joined to its trees without bringing its values together.
    """
    values = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("fact")) for c in FIELDS))
    tree = F.concat(F.lit("@"), F.coalesce(F.col("tree_id").cast("string"), F.lit("?")))
    told = rows.select("group_id", tree.alias("source"), F.explode(values).alias("v")).select(F.col("group_id").alias("entity"), "v.field", "v.fact", "source")
    said = told.where("fact IS NOT NULL").groupBy("entity", "field", "fact").agg(F.collect_set("source").alias("said"))
    said = materialize(said.withColumn("about", F.xxhash64("entity", "field")), "said")
    covers = told.groupBy("entity", "field").agg(F.collect_set("source").alias("covers"))
    counts = said.groupBy("about").agg(F.count("*").alias("n"))
    covers = covers.select(F.xxhash64("entity", "field").alias("about"), F.col("entity").alias("e"), F.col("field").alias("f"), "covers").join(counts, "about")
    votes = F.array_sort(F.transform("covers", lambda x: F.concat(x, F.when(F.array_contains("said", x), "+").otherwise("-"))))
    joined = join_counts(said, materialize(covers, "covers"), "about", "n").where("entity = e AND field = f")
    return joined.select("entity", "field", "fact", votes.alias("votes"))


def survivor_model(facts: DataFrame, rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """``entity, fact, odds, truth`` of the likeliest fact of every entity, of which just one is true, and ``source, sens, spec``.

    As ``quality_model``, but the facts of an entity share its truth. Ties fall to the smaller fact, a number. The patterns of
    the respects, at most 16 a tree, are held on the driver; an entity comes together only as counts of its patterns.
    """
    spark = facts.sparkSession
    facts = materialize(facts.select("entity", "fact", "votes"), "facts")
    held = facts.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    number = spark.createDataFrame([(r.votes, i) for i, r in enumerate(held)], "votes array<string>, p int")
    groups = materialize(facts.join(F.broadcast(number), "votes").groupBy("entity", "p").agg(F.count("*").alias("m")), "groups")  # 16 rows a tree
    n = np.array([r.n for r in held], np.float64)

    def rivalry(odds: np.ndarray) -> np.ndarray:
        known = spark.createDataFrame(list(enumerate((odds - odds.max()).tolist())), "p int, w double")
        likely = F.col("m") * F.exp("w")
        share = likely / F.sum(likely).over(Window.partitionBy("entity"))
        rows = groups.join(F.broadcast(known), "p").select("p", share.alias("share")).groupBy("p").agg(F.sum("share")).collect()  # 16 a tree
        out = np.zeros(len(n))
        for p, x in rows:
            out[p] = x
        return out / n

    _, odds, quality = _em([("survivor", r.votes, r.n) for r in held], rounds, 0.5, rivalry) if held else (None, np.zeros(0), {})
    judged = spark.createDataFrame([(r.votes, w) for r, w in zip(held, (odds - odds.max(initial=-1e9)).tolist())], "votes array<string>, odds double")
    top = F.max(F.struct("odds", (-F.col("fact").cast("long")).alias("minus"))).alias("t")
    best = facts.join(F.broadcast(judged), "votes").groupBy("entity").agg(top, F.sum(F.exp("odds")).alias("all"))
    best = best.select("entity", (-F.col("t.minus")).alias("fact"), F.col("t.odds").alias("odds"), (F.exp("t.odds") / F.col("all")).alias("truth"))
    return best, spark.createDataFrame([(s, *q) for (_, s), q in quality.items()], "source string, sens double, spec double")


def best_rows(rows: DataFrame) -> DataFrame:
    """``group_id, scan_row_id, truth``: the row of each group that the model judges most likely the survivor."""
    best, _ = survivor_model(respect_votes(rows))
    return best.select(F.col("entity").alias("group_id"), F.col("fact").alias("scan_row_id"), "truth")


def survivors(groups: DataFrame, catalog: DataFrame, trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One surviving record per group: the representative row's id and, field by field, the best value; and the group's paths.

    ``mtime``, ``ctime``, ``kind`` and ``content_hash_algo`` take the value with the highest truth (ties: the greater value,
    so the more recent date). A group keeps every path judged true (truth of 0.5 or more; at least the representative's own):
    ``paths`` counts them, and the second table, ``group_id, rel_path, truth``, has them, one a row, as a group may have any
    number. Groups whose files are all missing from the catalog, or null, give no row. A field without any value is null.
    """
    rows = materialize(members(groups, catalog, trees), "members")
    best = materialize(best_rows(rows), "best")
    truth, _ = quality_model(field_votes(rows))
    truth = materialize(truth.withColumnRenamed("entity", "group_id"), "truth")
    own = best.select("group_id", "scan_row_id").join(rows.select("group_id", "scan_row_id", "tree_id", "rel_path"), ["group_id", "scan_row_id"])
    paths = truth.where("field = 'rel_path' AND truth >= 0.5").select("group_id", F.col("fact").alias("rel_path"), "truth")
    kept = own.where("rel_path IS NOT NULL").select("group_id", "rel_path", F.lit(0.0).alias("truth")).unionByName(paths)
    kept = kept.groupBy("group_id", "rel_path").agg(F.round(F.max("truth"), 6).alias("truth"))
    pick = {c: F.max(F.when(F.col("field") == c, F.struct("truth", "fact"))).getField("fact").alias(c) for c in FIELDS[:4]}
    fused = truth.groupBy("group_id").agg(*pick.values())
    record = (
        own.join(best.select("group_id", "truth"), "group_id")
        .join(fused, "group_id", "left")
        .join(kept.groupBy("group_id").agg(F.count("*").alias("paths")), "group_id", "left")
        .select(
            "group_id",
            "scan_row_id",
            "tree_id",
            "rel_path",
            F.col("mtime").cast("timestamp_ntz").alias("mtime"),
            F.col("ctime").cast("timestamp_ntz").alias("ctime"),
            "kind",
            "content_hash_algo",
            F.coalesce("paths", F.lit(0)).alias("paths"),
            F.round("truth", 6).alias("truth"),
        )
    )
    return record, kept
