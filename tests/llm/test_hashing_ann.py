from __future__ import annotations

import math

import numpy as np
import pytest

from assayer.llm import hashing_ann
from assayer.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"
QUERY = "pmod(vec_id, 20) = 0"


def brute(rows, k=20):
    """Of each query row, in order of its id: the ids and products of its k nearest."""
    usable = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and v
              and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    by_dim = {}
    for at, (i, v) in enumerate(usable):
        by_dim.setdefault(len(v), []).append((i, at, v))
    out = []
    for members in by_dim.values():
        for i, at, v in members:
            if i % 20 == 0:
                scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, other, w in members if other != at)
                out.append((i, [(j, -s) for s, j in scores[:k]]))
    return sorted(out, key=lambda x: (x[0], str(x[1])))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 1, "clash") for i, v in rows], SCHEMA)


def recall(found, rows, k=20):
    """Share of the nearest that were found; every product must be right and in order."""
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    hits = total = 0
    for query, near in brute(rows, k):
        assert len(got[query]) == len(near)
        assert got[query] == sorted(got[query], key=lambda x: (-x[1], x[0]))
        assert all(s == pytest.approx(float(vectors[query] @ vectors[j]), rel=1e-12, abs=1e-12) for j, s in got[query])
        hits += len(set(got[query]) & {(j, s) for j, s in near} | {x for x in got[query] if x[1] >= near[-1][1] - 1e-12})
        total += len(near)
    return hits / total


def test_noise_and_clusters(spark, monkeypatch):
    for name, size in (("BLOCK", 64), ("QUERIES", 16), ("PARTS", 8)):
        monkeypatch.setattr(hashing_ann, name, size)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 24))
    x = np.vstack([rng.normal(size=(1200, 24)), centres[rng.integers(8, size=800)] + 0.1 * rng.normal(size=(800, 24))])
    x *= rng.uniform(0.2, 5, size=len(x))[:, None]  # several bands of length
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert recall(hashing_ann.search(frame(spark, rows), QUERY).collect(), rows) >= 0.95


def test_odd_rows_and_copies(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0]), (1, [math.nan, 1.0]), (2, [math.inf, 1.0]), (3, None), (4, []), (40, []), (None, [1.0, 1.0]),
            (5, [-1.0, 0.3]), (5, [-1.0, 0.2]), (60, [0.0, 0.0]), (-20, [3.0, -1.0]), (80, None), (6, [1e6, -1e6]), (7, [-0.0, 0.0])]
    rows += [(200 + i, [0.5, 0.25]) for i in range(60)] + [(9, [0.5, 0.25])] * 3
    found = {}
    for r in sorted(hashing_ann.search(frame(spark, rows), QUERY, 5).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found == {q: near for q, near in brute(rows, 5) if near}
    assert hashing_ann.search(frame(spark, [(0, [1.0])]), QUERY).count() == 0
    assert hashing_ann.search(frame(spark, []), QUERY).count() == 0
    nulls = spark.createDataFrame([(0, [1.0, None])], "vec_id long, embedding array<float>")
    assert hashing_ann.search(nulls, QUERY).count() == 0


def test_repeated_query_ids(spark):
    """Each row of a repeated id asks for itself and leaves out itself alone."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [2.0, 3.0])]
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hashing_ann.search(frame(spark, rows), QUERY).collect())
    want = sorted((q, rank + 1, j, s) for q, near in brute(rows) for rank, (j, s) in enumerate(near))
    assert found == want


def test_every_code_within_the_radius_is_retrieved_once():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 2 ** 63, size=3000).astype(np.uint64)
    near = codes[:200] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, size=(200, 9)).astype(np.uint64), axis=1)
    for bits in (0, 3, 7):
        own, all_ = (hashing_ann.substrings(x) >> (16 - bits) for x in (near, codes))
        for radius in (0, 3, 6, 9, 17):
            modes = np.full(len(near), radius)
            allowed = hashing_ann.within(modes)
            times = np.zeros((len(near), len(codes)), int)
            for t in range(4):
                for prefix in range(2 ** bits):
                    asking = np.flatnonzero(np.bitwise_count(own[:, t] ^ prefix) <= allowed[:, t])
                    bucket = np.flatnonzero(all_[:, t] == prefix)
                    times[np.ix_(asking, bucket)] += hashing_ann.retrieved(t, bits, modes[asking], near[asking], codes[bucket])
            want = np.bitwise_count(near[:, None] ^ codes) <= radius
            assert (times == want).all()


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    rows = [tuple(r) for r in table.collect()]
    assert recall(QUERIES["op13_ann_multi_index"](spark, sf).collect(), rows) >= 0.95
