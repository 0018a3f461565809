"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Each source's quota follows its
weight; a network routes the patterns' word capacity to quotas, where the first use of a word is free and every
repetition costs more than the one before. What a pattern is to give is then taken from its documents in a seeded
order: whole rounds of all of them, and the rest up to a boundary document, which gives the missing words.

Defined results: null texts have size 0 and are never taken; texts of any length are counted whole; a null source is a
source of its own, the last; names may hold any character; rows that repeat an id and a size are taken alike; sources whose documents have no words have target 0; an empty table gives
an empty table; equal inputs and seeds give equal results. Patterns are bounded by MAX_PATTERNS, checked before their
totals reach the driver. Of other columns ``plan`` reads none; ``select`` keeps all.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkobs.llm.common import stored

MAX_PATTERNS = 50_000
BUCKET_BITS = 10  # runs of the seeded order, by the top of its hash; each level cuts them so much finer
WEIGHTS = (5, 2, 1)  # of sources by code point, repeating
Pattern = tuple[str, ...]


def size_of(text: Column) -> Column:
    """Words: runs of characters but blanks and line ends."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def pattern(sources: Column) -> Column:
    """A document's sources as one key: sorted, each once, "n" for null and "m" before a name."""
    return F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.when(s.isNull(), "n").otherwise(F.concat(F.lit("m"), s)))))


def members(key: Sequence[str]) -> list[str | None]:
    return [None if x == "n" else x[1:] for x in key]


def quotas(sizes: dict[str | None, int], weights: dict[str | None, float], total: float, cap: float) -> dict[str | None, float]:
    """Shares of ``total`` by weight; a share stops at ``cap`` times its source's size, the excess is shared again."""
    out: dict[str | None, float] = {}
    left, open_ = total, set(sizes)
    while open_:
        weight = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / weight for s in open_}
        above = [s for s in open_ if share[s] > cap * sizes[s]]
        if not above:
            return out | share
        for s in sorted(above, key=str):
            out[s] = float(cap * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def route(capacity: dict[Pattern, int], quota: dict[str | None, int], layers: int) -> dict[Pattern, int]:
    """Words each pattern gives: a min-cost flow from patterns (``layers`` uses of every word, the ith at cost i) to the quotas of their sources.

    All cost lies on the way into a pattern, so a path costs what its first edge costs: the cheapest paths come first if
    the uses are opened one after another and each is filled as far as it goes, over what was routed before as well."""
    patterns, names = sorted(capacity), list(quota)
    place = {s: j for j, s in enumerate(names)}
    into = [[place[s] for s in members(p)] for p in patterns]
    inside: list[list[int]] = [[] for _ in names]
    for i, js in enumerate(into):
        for j in js:
            inside[j].append(i)
    left, given, flow = [quota[s] for s in names], [0] * len(patterns), defaultdict(int)
    for _ in range(layers):
        free = [capacity[p] for p in patterns]
        while fill(free, left, into, inside, flow):
            pass
        given = [g + capacity[p] - f for g, p, f in zip(given, patterns, free, strict=True)]
    return dict(zip(patterns, given, strict=True))


def fill(free: list[int], left: list[int], into: list[list[int]], inside: list[list[int]], flow: dict[tuple[int, int], int]) -> bool:
    """One round of Dinic's method: all shortest paths from patterns with free words to sources with room; false if there is none.

    A pattern i reaches its sources, a source j (node ~j) the patterns that gave to it, which can give elsewhere."""
    depth = {i: 0 for i, n in enumerate(free) if n}
    queue, goal = deque(depth), None
    while queue:
        a = queue.popleft()
        if goal is not None and depth[a] >= goal:
            break
        if a < 0 and left[~a]:
            goal = depth[a]
            continue
        for b in ([~j for j in into[a]] if a >= 0 else [i for i in inside[~a] if flow[i, ~a]]):
            if b not in depth:
                depth[b] = depth[a] + 1
                queue.append(b)
    if goal is None:
        return False
    tried: dict[int, int] = defaultdict(int)
    for start in [i for i, n in enumerate(free) if n]:
        path = [start]
        while path and free[start]:
            a = path[-1]
            if a < 0 and left[~a]:
                back = [(path[k + 1], ~path[k]) for k in range(1, len(path) - 1, 2)]  # flow that turns to another source
                n = min(free[start], left[~a], *(flow[x] for x in back))
                free[start] -= n
                left[~a] -= n
                for k in range(0, len(path), 2):
                    flow[path[k], ~path[k + 1]] += n
                for x in back:
                    flow[x] -= n
                path = [start]
                continue
            edges = into[a] if a >= 0 else inside[~a]
            while tried[a] < len(edges):
                e = edges[tried[a]]
                b = ~e if a >= 0 else e
                if depth.get(b) == depth[a] + 1 and depth[b] <= goal and (a >= 0 or flow[e, ~a]):
                    path.append(b)
                    break
                tried[a] += 1
            else:
                path.pop()
                if path:
                    tried[path[-1]] += 1
    return True


@dataclass
class Plan:
    """sizes and targets by source; cuts: pattern, rounds, and the boundary document (mix, id, size) with the words it gives."""

    sizes: dict[str | None, int]
    targets: dict[str | None, float]
    cuts: DataFrame


def mixed(key: Column, size: Column, seed: int) -> Column:
    return F.xxhash64(key, size, F.lit(seed))


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, seed: int = 11) -> Plan:
    """``rows``: stored columns id, size, pat."""
    spark = rows.sparkSession
    totals = rows.groupBy("pat").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns cannot be routed")
    capacity = {tuple(r.pat): r.n for r in totals}
    sizes: dict[str | None, int] = {}
    for p, n in capacity.items():
        for s in members(p):
            sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = quotas(sizes, {s: weights[i % len(weights)] for i, s in enumerate(names)}, share * sum(capacity.values()), cap)
    gives = route(capacity, {s: round(t) for s, t in targets.items()}, cap)
    split = [(list(p), g // capacity[p] if capacity[p] else 0, g % capacity[p] if capacity[p] else 0) for p, g in sorted(gives.items())]
    rounds = spark.createDataFrame(split, "pat array<string>, rounds long, rest long")
    # Where the words of a pattern's seeded order reach the rest: by bucket, by finer bucket, then by document.
    seeded, edge = rows.where("size > 0").withColumn("mix", mixed(F.col("id"), F.col("size"), seed)), rounds.select("pat", "rest")
    along = Window.partitionBy("pat").orderBy("bucket")
    for level in (1, 2):
        finer = seeded.withColumn("bucket", F.shiftrightunsigned("mix", 64 - level * BUCKET_BITS))
        buckets = finer.groupBy("pat", "bucket").agg(F.sum("size").alias("n")).withColumn("before", F.sum("n").over(along) - F.col("n"))
        edge = buckets.join(F.broadcast(edge.select("pat", "rest")), "pat").where("before <= rest and rest < before + n").select("pat", "bucket", (F.col("rest") - F.col("before")).alias("rest"))
        seeded = finer.join(F.broadcast(edge.select("pat", "bucket")), ["pat", "bucket"], "left_semi").drop("bucket")
    within = Window.partitionBy("pat").orderBy("mix", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = seeded.join(F.broadcast(edge.select("pat", "rest")), "pat").withColumn("before", F.sum("size").over(within) - F.col("size")).where("before <= rest and rest < before + size")
    cuts = rounds.select("pat", "rounds").join(last.select("pat", "mix", F.col("id").alias("edge_id"), F.col("size").alias("edge_size"), (F.col("rest") - F.col("before")).alias("gives")), "pat", "left")
    return Plan(sizes, targets, stored(cuts.withColumnRenamed("mix", "edge_mix"), "cuts"))


def taken(rows: DataFrame, own: Plan, seed: int = 11) -> DataFrame:
    """Adds taken to rows with id, size and pat: the words that the mix takes of each, repeats counted."""
    mix = mixed(F.col("id"), F.col("size"), seed)
    known = F.when(F.col("size") == 0, 0)
    # rows order by (bucket, mix, id, size); the bucket is the top of mix as an unsigned number
    here = F.struct(F.shiftrightunsigned(mix, 64 - BUCKET_BITS).alias("b"), mix.alias("m"), F.col("id").alias("i"), F.col("size").alias("s"))
    edge = F.struct(F.shiftrightunsigned("edge_mix", 64 - BUCKET_BITS).alias("b"), F.col("edge_mix").alias("m"), F.col("edge_id").alias("i"), F.col("edge_size").alias("s"))
    more = F.when(F.col("edge_mix").isNull(), 0).when(here < edge, F.col("size")).when(here == edge, F.col("gives")).otherwise(0)
    joined = rows.join(F.broadcast(own.cuts), "pat", "left")  # a row for each pattern
    return joined.withColumn("taken", known.otherwise(F.coalesce("rounds", F.lit(0)) * F.col("size") + more).cast("long")).drop("rounds", "edge_mix", "edge_id", "edge_size", "gives")


def mix(docs: DataFrame, sources: Column, text: str = "text", **how) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; the two in the middle are those of its first source."""
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("id"), pattern(sources).alias("pat"), size_of(F.col(text)).alias("size")), "sizes")
    own = plan(rows, **how)
    first = [(p, own.sizes[members(p)[0]], float(own.targets[members(p)[0]])) for p in (r.pat for r in own.cuts.select("pat").collect()) if members(p)]
    table = docs.sparkSession.createDataFrame(first, "pat array<string>, source_size long, target double")
    out = taken(rows, own, how.get("seed", 11)).join(F.broadcast(table), "pat", "left")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def select(docs: DataFrame, sources: Column, text: str = "text", **how) -> DataFrame:
    """The documents that the mix takes, with all columns, as often as it takes them; half a document or more counts as a whole."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"), pattern(sources).alias("pat"), size_of(F.col(text)).alias("size"))
    own = plan(stored(rows.select("id", "pat", "size"), "sizes"), **how)
    chosen = taken(rows, own, how.get("seed", 11)).where("taken > 0").withColumn("times", F.expr("cast((taken * 2 + size) div (size * 2) as int)")).where("times > 0")
    return chosen.select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")
