from __future__ import annotations

import random

import pytest

from assayer.llm.exact_dedup import with_rows
from assayer.llm.jaccard import components
from assayer.llm.queries import QUERIES
from assayer.llm.shared import stored

SCHEMA = "doc_id long, text string, n int, class string, label int"


def shingle_set(text, words=3):
    found = (text or "").encode().lower().split()
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i:i + words]) for i in range(len(found) - words + 1)}


def brute(rows, words=3, percent=90):
    sets = [shingle_set(t, words) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for x, i in enumerate(order):
        for j in order[x + 1:]:
            if percent * len(sets[j]) > 100 * len(sets[i]):
                break
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None and sets[i]:
            smallest[root(i)] = min(doc_id, smallest.get(root(i), doc_id))
    return sorted(((r[0], len(sets[i]), smallest.get(root(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=repr)


def check(spark, rows, words=3, percent=90, **options):
    df = with_rows(stored(spark.createDataFrame([(*r, 1, "clash", 1) for r in rows], SCHEMA).repartition(4), "docs"))
    got = components(df, words, percent, **options).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, words, percent)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None), (4, ""), (3, " \n"), (2, "a"), (1, "A"), (7, "a b"), (6, "a\tB"), (8, "a b c"), (9, "a b c"), (9, "a b c"), (None, "a b c"),
            (None, "only null"), (None, "only null"), (20, long), (21, long + " more"), (22, "é a b"), (23, "É a b"), (30, "a a a a"), (31, "a a a")]
    check(spark, rows)
    check(spark, [])


@pytest.mark.parametrize("words, percent, thin, growth", [(3, 90, 16, 8), (3, 90, 1, 2), (5, 80, 4, 8), (1, 100, 16, 8)])
def test_edited_copies_and_shared_passages(spark, words, percent, thin, growth):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(60)] + [f"r{i}" for i in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows, doc_id = [], 0
    for base in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([6, 40, 120]))] + (passage if base % 2 else [])
        for _ in range(rng.choice([1, 4, 40])):
            copy = list(text)
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                copy += ["tail"] * rng.randrange(9)
            rows.append((doc_id := doc_id + 1, " ".join(copy)))
    rng.shuffle(rows)
    check(spark, rows, words, percent, sample_step=2, thin=thin, growth=growth)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op4_jaccard_orders"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)
