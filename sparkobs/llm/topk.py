"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks; a block sorts one list per dimension. A query walks all lists side by side, from the
top where its component is positive and from the bottom where it is negative, scores what it meets in full, and stops
when the sum of its components times the lists' current values cannot reach its kth score. Queries travel to blocks
in groups, never as a whole; blocks answer k rows a query, which merge by a second grouping.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without an id;
vectors of another length than a query's are no candidates for it; equal vectors are searched once and answer with
their smallest ids, so ties go to the smaller id whatever the order; rows that repeat an id and a vector count once;
a query is never its own answer; components so large that an inner product might exceed 64 bits raise an error; empty
tables give no rows; columns but the id and the vector are never read. No list of a query or vector exceeds k + 1 rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rows of a candidate block and of a query group, and rows of a block that are worth a task. A block is sorted for each group of queries.
BLOCK_ROWS, QUERY_ROWS, LEAST_ROWS = 16_384, 16_384, 2048
LARGEST = 2**62  # of a component, as an integer; beyond it, and where products might exceed 64 bits, an error says so
ROUND = 32


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as long; null unless all components are finite."""
    finite = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def threshold_topk(block: np.ndarray, order: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of ``block`` that may be among the k best (ties with the kth included), their scores, and the depth read."""
    n = len(block)
    live = np.flatnonzero(query)
    if not len(live):
        return np.arange(n), np.zeros(n, block.dtype), 0
    own, q = order[:, live], query[live]
    down = q > 0
    seen, scores = np.zeros(n, bool), np.full(n, np.iinfo(np.int64).min, np.int64)
    kth, depth, step, met = np.iinfo(np.int64).min, 0, ROUND, 0
    while depth < n:
        to = min(n, depth + step)
        rows = np.concatenate([own[depth:to, ~down].ravel(), own[n - to : n - depth, down].ravel()])
        new = np.zeros(n, bool)
        new[rows] = True
        new = np.flatnonzero(new & ~seen)
        seen[new] = True
        scores[new] = block[new] @ query
        met += len(new)
        if met >= k:
            kth = np.partition(scores, n - k)[n - k]
        last = np.where(down, own[n - to], own[to - 1])
        bound = int((block[last, live] * q).sum())
        depth, step = to, step * 2
        if met >= k and bound < kth:  # a row not met yet scores bound at most
            break
    best = np.flatnonzero(seen & (scores >= kth))
    return best, scores[best], depth


def first(df: DataFrame, by: str, order: list[Column], k: int, to: str = "rank") -> DataFrame:
    """The first ``k`` rows of each ``by`` with their rank; tasks keep their own first ``k`` before rows are shuffled."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(to) <= k)


def tiles(n: int, rows: int, cores: int) -> int:
    """How many groups of ``n`` rows: as many as ``rows`` at most in each asks for, or as keep the cores busy."""
    return max(1, -(-n // rows), min(-(-n // LEAST_ROWS), 2 * cores))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, the key of the candidate, score: the k best of all other rows for every row where ``queries`` holds."""
    picked = vectors.select(F.col(key).cast("long").alias("id"), quantised(F.col(vector), scale).alias("v"), queries.alias("q")).where("id is not null and v is not null")
    seen = picked.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("most"), F.max(F.size("v")).alias("size"), F.count(F.lit(1)).alias("n"), F.count_if("q").alias("asked")).first()
    if (seen.most or 0) >= LARGEST or (seen.most or 0) ** 2 * (seen.size or 0) >= 2**63:
        raise ValueError(f"components up to {seen.most} in {seen.size} dimensions: inner products may exceed 64 bits")
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks, groups = tiles(seen.n, BLOCK_ROWS, cores), max(1, -(-seen.asked // QUERY_ROWS))
    # equal vectors are one candidate with its k + 1 smallest ids (one of which may be the query itself)
    distinct = first(picked.select("id", "v").distinct(), "v", [F.col("id")], k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asked = picked.where("q").select("id", "v").distinct()
    cells = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    candidates = distinct.select((F.pmod(F.xxhash64("v"), F.lit(blocks))).cast("int").alias("b"), "v", "ids").select("*", cells(groups, "g"))
    searches = asked.select((F.pmod(F.xxhash64("id"), F.lit(groups))).cast("int").alias("g"), "id", "v").select("*", cells(blocks, "b"))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            sizes = left.v.map(len).to_numpy()
            for size in np.unique(sizes):
                own = left[sizes == size]
                block = np.array(own.v.tolist(), np.int64).reshape(len(own), size)
                ids = own.ids.tolist()
                order = np.argsort(block, axis=0, kind="stable").astype(np.int32)
                for q, v in zip(right.id, right.v, strict=True):
                    if len(v) != size:
                        continue
                    # up to k + 1 rows: one of them may be the query alone
                    rows, scores, _ = threshold_topk(block, order, np.array(v, np.int64), min(k + 1, len(block)))
                    found = sorted((-int(s), int(i)) for r, s in zip(rows, scores, strict=True) for i in ids[r] if i != q)[:k]
                    out += [(q, i, -s) for s, i in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    near = candidates.groupBy("b", "g").cogroup(searches.groupBy("b", "g")).applyInPandas(run, schema)  # k rows at most for a query and a block
    best = first(near.repartition("query_id").distinct(), "query_id", [F.desc("score"), F.col("vec_id")], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(key), "score")


__all__ = ["quantised", "threshold_topk", "top_k"]
