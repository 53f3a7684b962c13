from __future__ import annotations

import os
import random
import zlib
from collections import Counter
from math import log, log10

import numpy as np
import pyarrow as pa
import pytest

from assayer.llm import suffix_lm
from assayer.llm.exact_dedup import with_rows
from assayer.llm.queries import QUERIES
from assayer.llm.shared import stored
from assayer.llm.suffix_lm import ENTRY_COST, SUFFIX_WEIGHT, Hasher, Lookup, score
from assayer.sources.tables import shared_dir


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def plain(rows, least, depth=None):
    """The tree in dictionaries: contexts as tuples of any length, longest retained suffix first."""
    training = [tokens(t) for i, t, *_ in rows if i is not None and not held(i)]
    c = Counter(w for t in training for w in t)
    total, below = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    texts = [[b"", *t] for t in training]
    states = {}

    def p(word, history):
        if not history:
            return (c[word] + 0.5) / below
        if history in states:
            rest, own = states[history]
            return own[word] if word in own else rest * p(word, history[1:])
        return p(word, history[1:])

    size, seen_of = 1, {(w,): n for w, n in c.items()}
    while depth is None or size <= depth:
        size += 1
        counted = Counter(tuple(t[k:k + size]) for t in texts for k in range(len(t) - size + 1))
        groups, new = {}, {}
        for g, n in counted.items():
            if n >= least:
                groups.setdefault(g[:-1], {})[g[-1]] = n
        for s, follow in groups.items():
            seen = seen_of[s]
            whole = seen + SUFFIX_WEIGHT
            kept = {}
            for w, n in follow.items():
                q, left = p(w, s[1:]), (whole - n) / whole
                if n * log((n / whole + left * q) / q) + (seen - n) * log(left) > ENTRY_COST:
                    kept[w] = n
            if kept:
                rest = (whole - sum(kept.values())) / whole
                new[s] = (rest, {w: n / whole + rest * p(w, s[1:]) for w, n in kept.items()})
        if not new:
            break
        states.update(new)
        seen_of = counted
    out, longest = [], max(map(len, states), default=0)
    for i, t, *_ in rows:
        x = tokens(t)
        history = [b"", *x]
        out.append((i, held(i), len(x), sum(c[w] > 0 for w in x), total, sum(log10(p(w, ())) for w in x),
                    sum(log10(p(w, tuple(history[max(0, j + 1 - longest):j + 1]))) for j, w in enumerate(x))))
    return sorted(out, key=repr), states, c


def check(spark, rows, least=2, **options):
    df = with_rows(stored(spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, n int, word int").repartition(3), "docs"))
    got = sorted((tuple(r) for r in score(df, least, None, **options).collect()), key=repr)
    expected, states, _ = plain(rows, least)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert [x for g in got for x in g[5:]] == pytest.approx([x for e in expected for x in e[5:]])
    return states


def test_against_plain_tree(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        line = ["a"]
        while rng.random() < 0.95:
            line.append(rng.choice("bbbbbc") if line[-1] == "a" else rng.choice("aac") if line[-2:] == ["c", "b"] else rng.choice("abcDÉ"))
        rows.append((i, " ".join(line) + f" rare{i % 50} The quick brown fox jumps over the lazy dog" * (i % 9 == 0)))
    states = check(spark, rows)
    assert {1, 2, 3} <= {len(s) for s in states}


@pytest.mark.parametrize("head", [0.003, 2.0])
def test_same_scores_whatever_is_shipped(spark, monkeypatch, head):
    for name in ("BLOCK_GRAMS", "BLOCK_TOKENS", "HELD", "LISTED", "HASHED"):
        monkeypatch.setattr(suffix_lm, name, 100)
    rng = random.Random(4)
    check(spark, [(i, " ".join(rng.choice(("a b c d", "b a", "c c b", f"w{i}")) for _ in range(20))) for i in range(60)], head=head)


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (None, "a b"), (3, "A\ta\x0bb c " * 20_000), (3, "x"), (3, "x"), (4, "\n"), (5, "a b a b"),
                  (7, "zz" * 100_000 + " a b")])
    check(spark, [(None, "a b"), (None, None)])
    assert score(with_rows(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_unseen_texts_with_common_grams_that_training_lacks(spark):
    out = [i for i in range(400) if held(i)]
    rows = [(i, "never learned words, " * 50 if held(i) else "what is learned here") for i in range(400)]
    states = check(spark, rows)
    assert out and not any(b"never" in s for s in states)


def test_states_are_distributions():
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(("x y z", "x y y", "z")) for _ in range(12))) for i in range(80)]
    _, states, c = plain(rows, 2)
    below = sum(c.values()) + 0.5 * (len(c) + 1)
    root = {w: (n + 0.5) / below for w, n in c.items()}
    for s, (rest, own) in states.items():
        if len(s) == 1:  # what the state keeps, and the rest spread as the root has it
            kept = sum(own[w] - rest * root[w] for w in own)
            assert kept + rest == pytest.approx(1)
    assert states


def test_keys_of_words():
    texts = ["", "one  two\tTWO\nthree", "É é two", None, " ", "two" * 50 + " x", "three"]
    stream, owner = Hasher().stream(pa.array(texts))
    want = [[b"", *(t or "").encode().lower().split(), b""] for t in texts]
    assert np.bincount(owner).tolist() == [len(w) for w in want]
    flat, by_word = [w for words in want for w in words], {}
    for key, word in zip(stream.tolist(), flat):
        by_word.setdefault(word, set()).add(key)
    assert all(len(k) == 1 for k in by_word.values()) and len({k for s in by_word.values() for k in s}) == len(by_word)


def test_lookup():
    rng = np.random.default_rng(1)
    for keys in (np.unique(rng.integers(0, 2 ** 63, 5000).astype(np.uint64)), np.arange(300, dtype=np.uint64), np.zeros(0, np.uint64)):
        asked = np.concatenate([keys, rng.integers(0, 2 ** 63, 100).astype(np.uint64)])
        at = Lookup(keys).find(asked)
        assert at[:len(keys)].tolist() == list(range(len(keys))) and (at[len(keys):] == -1).all()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op9_lm_suffix_tree"](spark, sf).collect()), key=repr)
    expected, _, _ = plain(rows, suffix_lm.LEAST, suffix_lm.DEPTH)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert [x for g in got for x in g[5:]] == pytest.approx([x for e in expected for x in e[5:]])
    unseen = [g for g in got if g[1]]
    assert sum(g[6] for g in unseen) > sum(g[5] for g in unseen)


def test_what_is_seen_often_enough_counts_at_any_size(spark):
    # 6 of 60,000 tokens.
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(600))) for i in range(100)]
    rows += [(i, "quite another language") for i in range(1000, 1010)]
    assert (b"quite",) in check(spark, rows, least=suffix_lm.LEAST)


def test_longer_contexts(spark):
    # The word after "x y" is told by the word before.
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(("a x y a", "b x y b", "c x y c")) for _ in range(30))) for i in range(80)]
    df = with_rows(stored(spark.createDataFrame(rows, "doc_id long, text string"), "docs"))
    two, three = ({r.doc_id: r.score for r in score(df, depth=depth).collect() if r.held_out} for depth in (2, 3))
    assert two and all(three[i] > two[i] + 5 for i in two)


def test_only_the_result_is_left(spark):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    score(with_rows(spark.createDataFrame([(i, "a b c d") for i in range(30)], "doc_id long, text string"))).count()
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before] == ["llm-scores"]


def test_a_block_holds_two_million_tokens_at_most():
    """A task holds a block in scoring, as Arrow in the JVM and in Python at once."""
    assert suffix_lm.blocks_for(70_000_000, suffix_lm.BLOCK_TOKENS) >= 35


def test_listings_are_small_and_exact():
    rng = np.random.default_rng(2)
    key = rng.integers(0, 2 ** 64 - 1, 1000, np.uint64)
    for spread in (1, 5_000, 10 ** 6, 2 ** 40):
        row = rng.integers(0, spread, 1000) + (7 << 33)
        packed = suffix_lm.listing(key, row)
        back = suffix_lm.listed_keys(np.frombuffer(packed, np.uint8))
        assert (back[0] == key).all() and (back[1] == row).all()
        if spread == 5_000:  # as many neighbouring texts as a task lists at a time
            assert len(packed) <= 10 * 1000 + 16


def test_tables_go_once_the_values_have_them(spark, monkeypatch):
    dropped, seen = [], []
    keep, drop = suffix_lm.Scratch.keep, suffix_lm.Scratch.drop

    def kept(self, df, name="table"):
        out = keep(self, df, name)
        seen.append((name, out))
        if name == "scored":
            assert {n for n, t in seen if not any(t is x for x in dropped)} == {"values", "scored"}
        return out

    monkeypatch.setattr(suffix_lm.Scratch, "keep", kept)
    monkeypatch.setattr(suffix_lm.Scratch, "drop", lambda self, *t: dropped.extend(t) or drop(self, *t))
    df = with_rows(stored(spark.createDataFrame([(i, "a b c d " * 9) for i in range(60)], "doc_id long, text string"), "docs"))
    assert score(df).count() == 60 and "gains" in [n for n, _ in seen]


def test_filters_follow_the_size_and_number_of_keys(spark):
    """A long context is looked for among the few of its length, in a small filter."""
    rng = np.random.default_rng(3)
    key = {size: rng.integers(0, 2 ** 64 - 1, count, np.uint64) for size, count in ((1, 60_000), (4, 40))}
    rows = [(size, k) for size, keys in key.items() for k in keys.view(np.int64).tolist()]
    found = suffix_lm.filters_of(spark.createDataFrame(rows, "size int, key long").repartition(3))
    assert set(found) == {1, 4} and len(found[1]) <= 2 ** 14 and len(found[4]) <= 16
    for size, keys in key.items():
        assert suffix_lm._passes(found[size], keys).all()
        assert suffix_lm._passes(found[size], rng.integers(0, 2 ** 64 - 1, 20_000, np.uint64)).mean() < 0.02


def test_texts_are_hashed_in_pieces_that_stay_in_cache(monkeypatch):
    hasher, texts = Hasher(), pa.array(["one two three " * 40_000, None, "four" * 20_000 + " one", ""])
    stream, owner = hasher.stream(texts)
    assert len(hasher.power) < 2 ** 17  # the longest word, not the longest text
    monkeypatch.setattr(suffix_lm, "HASHED", 50)
    again = Hasher().stream(texts)
    assert (again[0] == stream).all() and (again[1] == owner).all()


def test_sums_are_small_and_exact():
    rng = np.random.default_rng(4)
    row = np.sort(np.concatenate([(k << 33) + rng.choice(8_000, 100, replace=False) for k in range(30)]))
    sums = row, rng.integers(0, 9, len(row)), rng.random(len(row)), -rng.random(len(row))
    packed = suffix_lm.packed_sums(*sums)
    assert all((a == b).all() for a, b in zip(suffix_lm.sums_of(np.frombuffer(packed, np.uint8)), sums))
    assert len(zlib.compress(packed[:12 * len(row)], 1)) < 3 * len(row)


def test_same_scores_in_small_slices(spark, monkeypatch):
    for name in ("BLOCK_GRAMS", "BLOCK_TOKENS", "HELD", "LISTED", "TEXTS"):
        monkeypatch.setattr(suffix_lm, name, 100)
    monkeypatch.setattr(suffix_lm, "PART", 2)
    rng = random.Random(8)
    check(spark, [(i, " ".join(rng.choice(("a b c d", "b a", "c c b", f"w{i}")) for _ in range(20))) for i in range(60)], head=0.01)
