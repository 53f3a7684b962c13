from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from assayer.llm import merkle
from assayer.llm.queries import QUERIES, SQL
from tools.compare import compare, connect

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int, grp string"
THIRD = "pmod(crc32(CAST(doc_id AS STRING)), 3) = 0"


def digest(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))


def climb(nodes):
    """The last node, and for every first node the siblings left and right of it and its ancestors."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, range(len(paths))):
            start = at[i] // 8 * 8
            run = nodes[start:start + 8]
            path.append((run[:at[i] - start], run[at[i] - start + 1:]))
            at[i] //= 8
        nodes = [digest(nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    """Rows are ``doc_id, text, lang, source, n_chars``."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    climbed = [climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order]
    root, above = climb([top for top, _ in climbed]) if climbed else (None, [])
    out = []
    for g, (subroot, paths), rest in zip(order, climbed, above):
        for (_, _, own, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), paths):
            node, path = own, path + rest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                node = leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            for left, right in path:
                node = digest([*left, node, *right])
            proof = digest(x for left, right in path for x in left + right)
            out.append((r[0], own, subroot, root, proof, node, node == root))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in merkle.manifest(df, F.expr(THIRD)).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("sizes", [[1], [64, 9], [65, 8, 3], [520, 2, 1, 1, 1, 1, 1, 1, 1, 1]])
def test_tree_shapes(spark, sizes):
    check(spark, [(k * 1000 + i, f"Text {i}", f"l{k}", "S", i) for k, n in enumerate(sizes) for i in range(n)])


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "A", "en", "s", 1), (None, "B", "en", "s", 1), (2, "", "", "", 0),
            (3, "Ünïcode ÄÖ Z" * 5000, "zh", "ß", -5), (7, "Q", "=en", "s", 1), (7, "R", "=en", "s", 1)]
    check(spark, rows + [(11, "Same ROW", "en", "s", 8)] * 30 + [(i, "x", chr(0x20 + i), "s", 1) for i in range(70)])
    check(spark, [])


def test_windows_do_not_end_at_block_bounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 16)
    check(spark, [(i, f"T{i}", "en", "s", i) for i in range(300)])


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    same, note = compare(spark, connect(sf), QUERIES["op11_merkle_windows"], SQL["op11_merkle_windows"], sf)
    assert same, note
