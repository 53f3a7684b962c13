"""Exact top-k search by inner product with pivot tables.

Components are turned into integers.  Maximum inner product becomes nearest
neighbour: a candidate gets one more component so that all candidates have the same
length, and the distance to a query then falls as the product rises.  Distances of
every candidate to a table of pivots are computed once and kept with it.  For a
query, the largest difference between its and a candidate's distance to a pivot is a
lower bound of their distance.  Candidates are evaluated in the order of their bounds
until the next bound is beyond the k-th best distance; ties are evaluated too.

Queries and candidates are packed into blocks of bounded size; every block of
queries meets every block of candidates, and the best of the blocks are merged.

Defined results
  NULL id; NULL vector or one with NULL or non-finite components   takes no part
  repeated id              rows of their own; a query leaves out only its own row
  equal scores             smaller id first
  vectors of other length  are no candidates of a query
  scores beyond 64 bits    stop at the limits of a long
  empty table, one row     no rows
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.shared import by_value, stored

K, SCALE, PIVOTS, PIVOT_SAMPLE = 20, 64, 24, 256
QUERY_BLOCK, CANDIDATE_BLOCK, FIRST = 512, 8192, 128

PACKED = "dim int, block int, ids binary, rows binary, vectors binary, distances binary"


def integers(vector: Column) -> Column:
    """``floor(SCALE * x)`` of every component; NULL for a vector that takes no part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample that lie far apart: each is the farthest from those before."""
    chosen = [0]
    nearest = np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        if nearest.max() <= 0:
            break
        chosen.append(int(nearest.argmax()))
    return sample[chosen]


def lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Candidates with the component that makes them all ``longest`` (squared) long."""
    rest = np.maximum(longest - (vectors ** 2).sum(axis=1), 0)
    return np.hstack([vectors, np.sqrt(rest)[:, None]])


def to_pivots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (points ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def exact_type(queries: np.ndarray, vectors: np.ndarray, dim: int) -> type:
    """The smallest type in which every sum of products of these integers is exact."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(dim, 1)
    return np.float32 if top < 2 ** 23 else np.float64 if top < 2 ** 52 else object


def products(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Products in the exact type both are given in; longs stop at their limits."""
    sums = vectors @ query
    if sums.dtype == object:
        sums = np.array([min(max(int(x), -2 ** 63), 2 ** 63 - 1) for x in sums], object)
    return sums


def best(own: int, query: np.ndarray, bounds: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
         base: float, slack: float, k: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the k best of a block but the query's own row, and how many candidates were evaluated.

    A candidate's squared distance is ``base`` less twice its score.  Without ``rows`` ids tell rows apart.
    """
    open_ = np.flatnonzero((ids if rows is None else rows) != own)
    if len(open_) > FIRST:
        open_ = open_[np.argpartition(bounds[open_], FIRST)]
    now, later = open_[:FIRST], open_[FIRST:]
    top_ids, top, evaluated = ids[:0], np.zeros(0, vectors.dtype), 0
    while len(now):
        scores, first = products(query, vectors[now]), not evaluated
        evaluated += len(now)
        if len(top) == k:  # only what can enter is sorted
            entering = scores >= top[-1]
            now, scores = now[entering], scores[entering]
        found, scores = np.concatenate([top_ids, ids[now]]), np.concatenate([top, scores])
        order = np.lexsort((found, -scores))[:k]
        top_ids, top = found[order], scores[order]
        if len(top) == k:
            reach = np.sqrt(max(base - 2.0 * float(top[-1]), 0.0)) + slack
            later = later[bounds[later] <= reach]
        if first:  # the survivors of the first look, in the order of their bounds
            later = later[np.argsort(bounds[later])]
        step = max(FIRST, 3 * evaluated)
        now, later = later[:step], later[step:]
    return top_ids, top.astype(np.int64), evaluated


def _pack(pivots: dict[int, np.ndarray], longest: dict[int, float], as_queries: bool):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        dim, block = int(group["dim"].iloc[0]), int(group["block"].iloc[0])
        vectors = np.array(group["vector"].tolist(), np.int64).reshape(len(group), dim)
        points = vectors.astype(np.float64)
        points = np.hstack([points, np.zeros((len(points), 1))]) if as_queries else lengthened(points, longest[dim])
        table = to_pivots(points, pivots[dim]).astype(np.float32)
        return pd.DataFrame({"dim": [dim], "block": [block], "ids": [group["vec_id"].to_numpy(np.int64).tobytes()],
                             "rows": [group["row"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()], "distances": [table.tobytes()]})
    return work


def _search(longest: dict[int, float], k: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                dim = int(row.dim)
                q_ids, q_rows, c_ids, c_rows = (np.frombuffer(x, np.int64) for x in (row.ids, row.rows, row.c_ids, row.c_rows))
                queries = np.frombuffer(row.vectors, np.int64).reshape(len(q_ids), dim)
                vectors = np.frombuffer(row.c_vectors, np.int64).reshape(len(c_ids), dim)
                near = np.frombuffer(row.distances, np.float32).reshape(len(q_ids), -1)
                table = np.ascontiguousarray(np.frombuffer(row.c_distances, np.float32).reshape(len(c_ids), -1).T)
                squares = (queries.astype(np.float64) ** 2).sum(axis=1)
                exact = exact_type(queries, vectors, dim)
                queries, vectors = queries.astype(exact), vectors.astype(exact)
                out = []
                for i, query_id in enumerate(q_ids):
                    bounds = np.zeros(len(c_ids), np.float32)
                    for distance, column in zip(near[i], table):
                        np.maximum(bounds, np.abs(column - distance), out=bounds)
                    base = squares[i] + longest[dim]
                    found, scores, _ = best(q_rows[i], queries[i], bounds, c_ids, vectors, base,
                                            1e-5 * (np.sqrt(base) + 1), k, c_rows)
                    out.append(pd.DataFrame({"row": q_rows[i], "query_id": query_id, "vec_id": found, "score": scores}))
                if out:
                    yield pd.concat(out).astype("int64")
    return work


def search(vectors: DataFrame, is_query: str, k: int = K, query_block: int = QUERY_BLOCK,
           candidate_block: int = CANDIDATE_BLOCK, n_pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of ``vec_id, embedding``; ``is_query`` is a condition on ``vec_id``."""
    spark = vectors.sparkSession
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("vector"))
    rows = stored(
        usable.where("vec_id IS NOT NULL AND vector IS NOT NULL")
        .select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("vector").alias("dim"), "vector",
                F.expr(is_query).alias("is_query")), "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q"), F.max(square).alias("longest")).collect()
    empty = "query_id long, rank int, vec_id long, score long"
    if not any(s.q for s in sizes):
        return spark.createDataFrame([], empty)
    longest = {s.dim: s.longest for s in sizes}
    # A bounded sample by id digest to choose pivots from; any pivots give exact results.
    by_digest = W.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id", "vector")
    sample = rows.withColumn("at", F.row_number().over(by_digest)).where(F.col("at") <= PIVOT_SAMPLE).collect()
    grouped: dict[int, list] = {}
    for r in sample:
        grouped.setdefault(r.dim, []).append((r.at, r.vector))
    pivots = {d: choose_pivots(lengthened(np.array([v for _, v in sorted(g)], np.float64).reshape(len(g), d), longest[d]), n_pivots)
              for d, g in grouped.items()}

    def block(column: str, size: int) -> Column:
        count = F.create_map(*[F.lit(x) for s in sizes for x in (s.dim, max(1, -(-s[column] // size)))])
        return F.pmod(F.xxhash64("row", F.lit(column)), count[F.col("dim")]).cast("int")

    def packed(part: DataFrame, column: str, size: int) -> DataFrame:
        return (part.withColumn("block", block(column, size)).groupBy("dim", "block")
                .applyInPandas(_pack(pivots, longest, column == "q"), PACKED))

    blocks = F.create_map(*[F.lit(x) for s in sizes for x in (s.dim, max(1, -(-s.n // candidate_block)) - 1)])
    asked = packed(rows.where("is_query"), "q", query_block).withColumn(
        "c_block", F.explode(F.sequence(F.lit(0), blocks[F.col("dim")])))
    offered = packed(rows, "n", candidate_block).select(
        "dim", F.col("block").alias("c_block"), F.col("ids").alias("c_ids"), F.col("rows").alias("c_rows"), F.col("vectors").alias("c_vectors"),
        F.col("distances").alias("c_distances"))
    found = asked.join(offered, ["dim", "c_block"]).repartition("dim", "block", "c_block").mapInPandas(
        _search(longest, k), "row long, query_id long, vec_id long, score long")
    order = W.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


by_value(__name__)
