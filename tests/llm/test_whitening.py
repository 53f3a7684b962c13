from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from assayer.llm import whitening
from assayer.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string"


def brute(rows, most=16):
    """Exact integers for counts, sums and deviations, numpy's SVD of the whole centred matrix."""
    usable = [(i, [math.floor(64 * float(np.float32(c))) + 10 ** 6 for c in v]) for i, v in rows
              if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    matrix = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    _, singular, right = np.linalg.svd(matrix, full_matrices=False)
    rank = int((singular > 1e-12 * singular.max(initial=0)).sum())
    e = (singular ** 2 / n)[:min(most, rank)]
    trace = (matrix ** 2).sum() / n
    out = {}
    for i, x in usable:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        centred = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        out.setdefault(i, []).append((deviation, centred @ right[:len(e)].T / np.sqrt(e)))
    return n, e / trace, out


def check(df, rows, tolerance=1e-7):
    n, explained, expected = brute(rows)
    found = {}
    for r in df.collect():
        assert r["n"] == n and r["identity_error"] <= 1e-9
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        found.setdefault(r["vec_id"], []).append((r["component"], r["deviation"], r["whitened"]))
    assert found.keys() == expected.keys() if len(explained) else not found
    signs = {}
    for i, parts in expected.items():
        if len(explained):
            assert len(found[i]) == len(parts) * len(explained)
        for deviation, white in parts if len(parts) == 1 and len(explained) else []:
            for component, got_deviation, got in found[i]:
                assert got_deviation == (deviation if deviation < 2 ** 63 else None)
                want = white[component - 1]
                if abs(want) > 1e-3:
                    signs.setdefault(component, np.sign(want) == np.sign(got))
                    assert signs[component] == (np.sign(want) == np.sign(got))
                assert abs(got) == pytest.approx(abs(want), abs=tolerance)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 9, "clash") for i, v in rows], SCHEMA)


def test_spread_eigenvalues_and_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 24)) * 2.0 ** np.arange(24)[::-1] @ np.linalg.qr(rng.normal(size=(24, 24)))[0] + 5e3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[3].tolist()) for i in range(400)]
    check(whitening.whiten(frame(spark, rows)), rows)


def test_badly_conditioned(spark):
    """One direction is a million times as long as the others: its square takes up all digits of a covariance."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 6)) * [3e6, 9, 4, 2, 1, 0.5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    check(whitening.whiten(frame(spark, rows)), rows)


def test_constant_and_dependent_dimensions(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 5)) * 64) / 64
    x = np.column_stack([x, x[:, 0] + x[:, 1], np.full(300, 7.25), x[:, 2]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = whitening.whiten(frame(spark, rows))
    check(df, rows)
    assert df.agg({"component": "max"}).first()[0] == 5


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (2, [0.5, 0.25]), (2, [0.5, 0.5]), (None, [1.0, 1.0]),
            (4, None), (5, [math.nan, 1.0]), (6, [math.inf, 0.0])]
    check(whitening.whiten(frame(spark, rows)), rows)
    nulls = spark.createDataFrame([(1, [1.0, None]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(nulls).count() == 0  # one vector has no variance
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, []), (2, [])])).count() == 0


def test_other_lengths_and_large_numbers(spark):
    short, long_ = [(i, [float(i), float(i * i % 7)]) for i in range(9)], [(100 + i, [1e30 * i, -1e30 * i, float(i)]) for i in range(4)]
    found = whitening.whiten(frame(spark, short + long_)).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r["vec_id"], []).append(r)
    assert {len(by_id[i]) for i, _ in short} == {2} and by_id[0][0]["n"] == 9
    assert by_id[100][0]["n"] == 4 and by_id[100][0]["deviation"] is None


def test_query_is_whole(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    check(QUERIES["op12_whitening_cholesky_qr"](spark, sf), [(r["vec_id"], r["embedding"]) for r in table.collect()])
