from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm.bpe import MergeReplay, decode, digests, encode, load_ranks
from assayer.llm.queries import QUERIES

RANKS = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
KNOWN = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
SINGLE = {bytes([b]): b for b in range(256)}
#: Ranks in which a merge makes one of lower rank possible, and pairs overlap.
ODD = SINGLE | {b"ab": 300, b"abc": 280, b"aa": 290, b"aaa": 285, b"bc": 310, b"cab": 270, b"aab": 400}


def expected(text):
    ids = KNOWN.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=14), max_size=5))
def test_merge_order(words):
    encoding = tiktoken.Encoding("odd", pat_str=r"[abc]+", mergeable_ranks=ODD, special_tokens={})
    assert MergeReplay(ODD).encode([w.encode() for w in words if w]) == [
        encoding.encode_ordinary(w) for w in words if w]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    import regex

    replay = MergeReplay(RANKS)
    ids = [i for word in replay.encode([w.encode() for w in regex.findall(PATTERN, text)]) for i in word]
    assert ids == KNOWN.encode_ordinary(text) and replay.decode(ids) == text.encode()


def test_odd_rows(spark):
    texts = [None, "", " ", "\n\n  a", "a" * 50_000, "x y " * 40_000, "don't I'LL 12345 <|endoftext|>", "é😀‍日本",
             "same", "same", " \t \n "]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: tuple(r)[1:] for r in digests(df.repartition(3), RANKS, PATTERN).collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)}
    back = {r.doc_id: r.text for r in decode(encode(df, RANKS, PATTERN), RANKS).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert digests(df.limit(0), RANKS, PATTERN).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op5_bpe_merge_replay"](spark, sf).collect()}
    assert got == {i: expected(t) for i, t in texts.items()}


def test_large_rank_file_is_refused(tmp_path, monkeypatch):
    from assayer.llm import bpe

    monkeypatch.setattr(bpe, "MAX_RANK_FILE", 3)
    (tmp_path / "ranks").write_text("YQ== 0\n")
    with pytest.raises(ValueError):
        load_ranks(str(tmp_path / "ranks"))


def test_pairs_of_bytes_come_from_a_table(monkeypatch):
    asked = []
    monkeypatch.setattr(MergeReplay, "_rank", lambda self, *a: asked.append(a) or -1)
    assert MergeReplay(SINGLE | {b"ab": 300}).encode([b"cdcd", b"xab", b""]) == [[99, 100, 99, 100], [120, 300], []]
    assert len(asked) == 1  # x with ab


def test_without_room_to_remember_pairs(monkeypatch):
    from assayer.llm import bpe

    monkeypatch.setattr(bpe, "KNOWN_PAIRS", 0)
    monkeypatch.setattr(bpe, "ROW_BYTES", 30)
    texts = ["aaaaaaa", "aabcabcab", "cabcaabaab", "zab"] * 5
    encoding = tiktoken.Encoding("odd", pat_str=r"[a-z]+", mergeable_ranks=ODD, special_tokens={})
    assert MergeReplay(ODD).encode([t.encode() for t in texts]) == [encoding.encode_ordinary(t) for t in texts]
