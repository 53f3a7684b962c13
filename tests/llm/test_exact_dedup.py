from __future__ import annotations

import hashlib

import pytest

from assayer.llm.exact_dedup import dedup, naming, normalise, shared_ranks, with_rows
from assayer.llm.queries import QUERIES, SQL
from assayer.llm.shared import stored
from tools.compare import compare, connect

SCHEMA = "doc_id long, text string, name string, group_size int, keep int"


def brute(rows):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(normalise(text), []).append(i)
    out = []
    for i, text, *_ in rows:
        ids = groups[normalise(text)]
        known = [x for x in ids if x is not None]
        out.append((i, max(known) if known else None, len(ids), hashlib.sha256(normalise(text)).hexdigest()))
    return sorted(out, key=repr), len(groups)


ODD = [(1, "Ab"), (2, "aB"), (2, "aB"), (3, None), (4, ""), (None, "x"), (None, "X"), (5, "É"), (6, "é"), (7, "y" * 300_000),
       (8, "y" * 299_999), (9, "Y" * 300_000), (10, "abcabcabc"), (11, "abcabcabd"), (None, "ab"), (12, "abc"), (13, "abcabc"), (14, " ab")]


@pytest.mark.parametrize("block, width, limit", [(1024, 8, 10_000), (3, 1, 10_000), (3, 1, 2), (1, 8, 10_000)])
def test_odd_rows(spark, block, width, limit):
    rows = [r if r[1] is None or len(r[1]) < 1000 or block > 10 else (r[0], r[1][:1000 + len(r[1]) % 7]) for r in ODD]
    df = with_rows(stored(spark.createDataFrame([(*r, "clash", 1, 1) for r in rows], SCHEMA).repartition(4), "docs"))
    got = dedup(df, block, width, limit).collect()
    expected, groups = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected
    kept = [r for r in got if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)


def test_shared_keys_are_told_apart(spark):
    """With keys of one byte, most keys stand for several contents on every level."""
    texts = [f"{i:04d}" * (1 + i % 9) for i in range(400)]
    df = spark.createDataFrame([(t,) for t in texts + texts], "text string").repartition(3)
    ranks, width = shared_ranks(df, 4, 1)
    assert width == 1 and max(ranks.values()) > 1
    names = {naming(normalise(t), ranks, 4, 1)[1:] for t in texts}
    assert len(names) == len(set(texts))


def test_empty(spark):
    assert dedup(with_rows(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    same, note = compare(spark, connect(sf), QUERIES["op1_exact_block_naming"], SQL["op1_exact_block_naming"], sf)
    assert same, note
