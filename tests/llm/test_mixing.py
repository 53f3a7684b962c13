from __future__ import annotations

import re

import pytest

from assayer.llm.mixing import mix, sampled
from assayer.llm.queries import QUERIES, SQL
from assayer.llm.shared import stored
from tools.compare import compare, connect

SF = "/root/testdata/sf0.01"


def shared_out(sizes, weights=(5, 2, 1), most=3):
    """Targets by capping and resharing until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        units = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / units for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def check(df, rows, largest_share=1.0, **options):
    got = [tuple(r) for r in mix(df, **options).collect()]
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((repr(r[0]), repr(r[1]), r[2]) for r in got) == sorted((repr(i), repr(s), count(t)) for i, t, s in rows)
    sizes, biggest, taken = {}, {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
        biggest[s] = max(biggest.get(s, 0), count(t))
    target = shared_out(sizes)
    for _, source, size, source_size, goal, copies, words in got:
        assert source_size == sizes[source] and goal == pytest.approx(target[source])
        assert words == copies * size <= 3 * size and copies >= 0
        taken[source] = taken.get(source, 0) + words
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * biggest[s] * largest_share + 1e-6
    again = [tuple(r) for r in mix(df.repartition(3), **options).collect()]
    assert sorted(got, key=repr) == sorted(again, key=repr)


def test_odd_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, None, None), (2, "", ""), (3, "w " * 90_000, "y"),
            (4, "é\u00a0é \u000b z", None), (5, "one", "Z"), (6, "😀 b", "\U0001F600")]
    schema = "doc_id long, text string, source string, size int, copies int, n int, class string"
    df = spark.createDataFrame([(*r, 9, 9, 9, "clash") for r in rows], schema)
    check(df, rows)
    assert mix(df.limit(0)).count() == 0
    kept = stored(df, "docs")
    assert sampled(kept).columns == df.columns
    assert sampled(kept).count() == sum(r.copies for r in mix(df).collect())


def test_slices_and_hot_source(spark):
    rows = [(i, "w " * (i * 37 % 400), "hot" if i % 3 else f"s{i % 7}") for i in range(6000)]
    rows += [(-1, "same " * 50, "hot")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(df, rows, largest_share=20, slice_rows=100)


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    check(df, [(r.doc_id, r.text, r.source) for r in df.collect()])


def test_query_matches_sql(spark):
    same, note = compare(spark, connect(SF), QUERIES["op7_mix_systematic"], SQL["op7_mix_systematic"], SF)
    assert same, note
