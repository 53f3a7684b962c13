from __future__ import annotations

import math

import numpy as np
import pytest

from assayer.llm import topk
from assayer.llm.queries import QUERIES, SQL
from tools.compare import compare, connect

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"
QUERY = "pmod(vec_id, 20) = 0"


def brute(rows, k):
    usable = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, *_ in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (q, v) in enumerate(usable):
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for at, (i, w) in enumerate(usable) if at != own and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def check(spark, rows, k=20, **options):
    df = spark.createDataFrame([(*r, 1, 1, "clash") for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in topk.search(df, QUERY, k, **options).collect()) == brute(rows, k)


@pytest.mark.parametrize("block", [7, 8192])
def test_clusters_and_ties(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.05 * rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]  # many equal vectors
    check(spark, rows, query_block=block, candidate_block=10 * block)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0]), (1, [math.nan, 1.0]), (2, [math.inf, 1.0]), (3, None), (4, []), (40, []), (None, [1.0, 1.0]),
            (5, [-1.0, 0.3]), (5, [-1.0, 0.2]), (60, [0.0, 0.0]), (-20, [3.0, -1.0]), (80, None), (6, [1e6, -1e6]), (100, [2e9, 3e9])]
    check(spark, rows)
    nulls = spark.createDataFrame([(1, [1.0, None])], "vec_id long, embedding array<float>")
    assert topk.search(nulls, QUERY).count() == 0
    check(spark, [(0, [1.0])])
    check(spark, [(0, [1.0, 1.0]), (1, [2.0, 2.0]), (1, [3.0, 0.0]), (0, [1.0, 1.0]), (0, [0.0, 2.0])])
    check(spark, [])


def test_bounds_spare_evaluations():
    rng = np.random.default_rng(2)
    vectors = np.floor(64 * np.repeat(rng.normal(size=(20, 4)), 200, axis=0) + rng.normal(size=(4000, 4)))
    longest = (vectors ** 2).sum(axis=1).max()
    points = topk.lengthened(vectors, longest)
    pivots = topk.choose_pivots(points[::50], 12)
    query = np.append(vectors[7], 0)[None]
    bounds = np.abs(topk.to_pivots(points, pivots) - topk.to_pivots(query, pivots)).max(axis=1)
    base = (query ** 2).sum() + longest
    _, scores, evaluated = topk.best(-1, vectors[7], bounds, np.arange(4000), vectors, base, 1e-3, 20)
    assert scores.tolist() == sorted((vectors @ vectors[7]).astype(int), reverse=True)[:20] and evaluated < 4000


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    same, note = compare(spark, connect(sf), QUERIES["op2_topk_pivot_table"], SQL["op2_topk_pivot_table"], sf)
    assert same, note
