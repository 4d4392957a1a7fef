"""Mixing sources to target shares of all tokens, with capped repetition.

Equal texts may belong to several sources. Texts are grouped by their membership pattern (the set of sources that hold
them); a min-cost flow routes the patterns' tokens to the sources' quotas, each further use of a pattern's tokens costing more
than the one before, so that nothing is repeated while something unused could serve. The flow is solved on the driver over
patterns (at most 2**sources), never over documents. The quotas then become stretches of a seeded order of the texts.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.prefix import running_sums
from corpusloom.session import materialize

#: Membership patterns that the flow is solved over; texts of rarer ones count for one of their sources, see ``few_patterns``.
PATTERNS = 1 << 12


def source_name(source: Column) -> Column:
    """One spelling of a source: trimmed, lower case, with underscores. Blank is null."""
    name = F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")
    return F.when(name != "", name)


class Flow:
    """Min-cost flow by successive shortest paths, for graphs of patterns and sources."""

    def __init__(self, n: int):
        self.edges: list[list[float]] = []  # to, capacity, cost
        self.out: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, capacity: float, cost: float) -> int:
        self.out[a].append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.out[b].append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def run(self, source: int, sink: int) -> float:
        n, sent = len(self.out), 0.0
        price = [0.0] * n
        while True:
            dist, via = [float("inf")] * n, [-1] * n
            dist[source] = 0.0
            heap = [(0.0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > dist[a] + 1e-12:
                    continue
                for e in self.out[a]:
                    b, cap, cost = self.edges[e]
                    new = d + cost + price[a] - price[int(b)]
                    if cap > 0.5 and new < dist[int(b)] - 1e-12:
                        dist[int(b)], via[int(b)] = new, e
                        heapq.heappush(heap, (new, int(b)))
            if via[sink] < 0:
                return sent
            price = [p + d if d < float("inf") else p for p, d in zip(price, dist)]
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = int(self.edges[via[at] ^ 1][0])
            push = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= push
                self.edges[e ^ 1][1] += push
            sent += push


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens of each pattern for each source: the greatest total in which every reachable source has its share.

    ``targets`` gives share and greatest number of uses of each source. Sources that no pattern holds (or of share 0) get
    nothing, and the others keep their shares relative to one another.
    """
    live = {s: t for s, t in targets.items() if t[0] > 0 and t[1] > 0 and any(s in p and n > 0 for p, n in patterns.items())}
    if not live:
        return {}
    whole = sum(t[0] for t in live.values())
    names, keys = sorted(live), sorted(p for p, n in patterns.items() if n > 0)

    def solve(total: float) -> tuple[bool, dict[tuple[tuple[str, ...], str], int]]:
        g = Flow(2 + len(keys) + len(names))
        arcs = {}
        for i, p in enumerate(keys):
            uses = sum(live[s][1] for s in p if s in live)
            for k in range(uses):  # convex: the k-th use of the same tokens costs k squared
                g.add(0, 2 + i, patterns[p], float(k * k))
            for s in p:
                if s in live:
                    arcs[p, s] = g.add(2 + i, 2 + len(keys) + names.index(s), patterns[p] * live[s][1], 0.0)
        want = 0
        for j, s in enumerate(names):
            quota = int(total * live[s][0] / whole)
            want += quota
            g.add(2 + len(keys) + j, 1, quota, 0.0)
        sent = g.run(0, 1)
        return sent >= want - len(names), {k: int(g.edges[e ^ 1][1]) for k, e in arcs.items()}

    low, high = 0.0, float(sum(n * max(live[s][1] for s in p if s in live) for p, n in patterns.items() if any(s in live for s in p))) * len(names)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if solve(middle)[0] else (low, middle)
        if high - low < 1:
            break
    return solve(low)[1]


def few_patterns(texts: DataFrame, most: int) -> tuple[DataFrame, dict[tuple[str, ...], int]]:
    """``texts(pattern, members, tokens)`` with at most ``most`` patterns of several sources, and the tokens of each pattern.

    The patterns with the most tokens stay. A text of a rarer one is a member only of the source of its pattern that has the
    fewest tokens, where it is needed most: every text stays in the flow, only its choice of sources is narrowed.
    """
    sums = materialize(texts.groupBy("pattern").agg(F.sum("tokens").alias("n")), "patterns")
    if sums.count() > most:
        kept = sums.orderBy(F.desc("n"), "pattern").limit(most).select("pattern")
        rare = sums.join(F.broadcast(kept), "pattern", "left_anti").where("pattern LIKE '%|%'").select("pattern")
        sizes = sums.select(F.explode(F.split("pattern", "[|]")).alias("source"), "n").groupBy("source").agg(F.sum("n").alias("n"))
        each = rare.select("pattern", F.explode(F.split("pattern", "[|]")).alias("source")).join(F.broadcast(sizes), "source")  # a row a source
        only = each.groupBy("pattern").agg(F.min(F.struct("n", "source")).getField("source").alias("only"))
        texts = texts.join(only, "pattern", "left").withColumns(
            {"pattern": F.coalesce("only", "pattern"), "members": F.when(F.col("only").isNull(), F.col("members")).otherwise(F.filter("members", lambda m: m["source"] == F.col("only")))}
        )
        texts = materialize(texts.drop("only"), "texts")
        sums = texts.groupBy("pattern").agg(F.sum("tokens").alias("n"))
    return texts, {tuple(r.pattern.split("|")): r.n for r in sums.collect()}  # at most ``most`` patterns and one a source


def mix(counted: DataFrame, targets: DataFrame, patterns: int = PATTERNS) -> tuple[DataFrame, DataFrame]:
    """The selection ``doc_id, source, tokens, uses`` and the report ``source, target_share, actual_share, tokens, documents, most_uses``.

    ``counted(doc_id, source, h, tokens)`` has the documents with the hash of their text. Documents without a target, and
    texts without tokens, are never selected. Of several copies in one source the smallest id stands for all. The report has
    every target, also one that no document can serve. Its actual shares miss the reachable targets by less than one document
    a pattern.
    """
    spark = counted.sparkSession
    rows = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL").collect()
    wanted = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in rows}
    known = counted.select("doc_id", source_name(F.col("source")).alias("source"), "h", "tokens").where((F.col("tokens") > 0) & F.col("source").isin(*wanted))
    each = known.groupBy("h", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    texts = each.groupBy("h").agg(
        F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("members"),  # at most one a source
        F.max("tokens").alias("tokens"),
        F.min("doc_id").alias("first"),
    )
    texts = materialize(texts.withColumn("pattern", F.array_join("members.source", "|")), "texts")
    texts, tokens = few_patterns(texts, patterns)
    flows = route(tokens, wanted)
    # The sources of a pattern take stretches of its seeded order, one after the other, around and around.
    stretches, at = [], {}
    for (p, s), n in sorted(flows.items()):
        if n > 0:
            stretches.append(("|".join(p), s, at.get(p, 0), at.get(p, 0) + n, tokens[p]))
            at[p] = at.get(p, 0) + n
    plan = spark.createDataFrame(stretches, "pattern string, source string, low bigint, high bigint, length bigint")
    placed = running_sums(texts, "pattern", "tokens", "first", out="start")
    chosen = placed.join(F.broadcast(plan), "pattern")  # at most patterns x sources rows
    uses = F.ceil((F.col("high") - F.col("start")) / F.col("length")) - F.ceil((F.col("low") - F.col("start")) / F.col("length"))
    chosen = chosen.withColumn("uses", uses.cast("int")).where("uses > 0")
    own = F.element_at(F.filter("members", lambda m: m["source"] == F.col("source")), 1)["doc_id"]
    selection = materialize(chosen.select(own.alias("doc_id"), "source", "tokens", "uses"), "selection")
    sums = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    total = F.sum("tokens").over(Window.partitionBy())  # over one row a source
    goals = spark.createDataFrame([(s, t[0]) for s, t in wanted.items()], "source string, target_share double")
    report = goals.join(sums, "source", "left").select(
        "source",
        "target_share",
        F.round(F.coalesce(F.coalesce("tokens", F.lit(0)) / total, F.lit(0.0)), 6).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
    return selection, report
