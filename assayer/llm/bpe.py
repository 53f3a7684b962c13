"""Byte-level BPE by corpus-level merge replay.

A text is split by the tokenizer's pattern.  The different pieces of a slice of
texts are laid out in one row of byte tokens, and an inverted index leads from
every mergeable pair (by the rank of its merge) to the positions where it
stands.  Merges are applied in rank order to all pieces at once; a merge looks
only at its two neighbours and files the new pairs.  Pieces are independent, so
each one sees its own merges in rank order and from the left, as an encoder of
single texts applies them.

Defined results
  NULL or empty text   no tokens; the decoded text is empty
  any other text       exact round trip; texts are never cut
  repeated rows, ties  each row is encoded by itself
  empty table          no rows
Ranks come from a public file given by path; the driver reads it (its size is
checked) and ships it with the plan.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import by_value

#: Largest accepted rank file; a vocabulary does not grow with the corpus.
MAX_RANK_FILE = 32 << 20
#: Bytes of text in a slice, here and for the digests; bytes of pieces laid out together; pieces remembered between slices.
SLICE_CHARS, DIGEST_CHARS, ROW_BYTES, REMEMBERED = 8 << 20, 1 << 19, 1 << 19, 400_000
#: Pairs of ids whose merge a worker remembers; others are looked up again.
KNOWN_PAIRS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 of the token, blank, rank."""
    if os.path.getsize(path) > MAX_RANK_FILE:
        raise ValueError(f"{path} is larger than a vocabulary can be")
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Encodes sets of pieces, and decodes ids, by one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        # Ranks of a token with the one after it, and with the one before it, -1 for none.
        self.follows: dict[int, dict[int, int]] = {}
        self.leads: dict[int, dict[int, int]] = {}
        self.known = 0

    def _rank(self, left: int, right: int, remembered: dict[int, int], key: int) -> int:
        rank = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
        if self.known < KNOWN_PAIRS:
            self.known += 1
            remembered[key] = rank
        return rank

    def encode(self, pieces: Iterable[bytes]) -> list[list[int]]:
        """Ids of every piece; a piece that is a token itself is that token."""
        out: list[list[int] | None] = []
        row: list[bytes] = []
        places: list[int] = []
        size, ranks = 0, self.ranks
        for k, piece in enumerate(pieces):
            whole = ranks.get(piece)
            if whole is not None:
                out.append([whole])
                continue
            out.append(None)
            row.append(piece)
            places.append(k)
            size += len(piece) + 1
            if size > ROW_BYTES:
                self._settle(row, places, out)
                row, places, size = [], [], 0
        self._settle(row, places, out)
        return out

    def _settle(self, row: list[bytes], places: list[int], out: list[list[int] | None]) -> None:
        """Merge one row of pieces and hand every piece its ids."""
        if not row:
            return
        ids = self._replay(row)
        start = 0
        for k, piece in zip(places, row):
            end = start + len(piece)
            out[k] = [t for t in ids[start:end] if t >= 0]
            start = end + 1

    def _replay(self, row: list[bytes]) -> list[int]:
        """Apply all merges to pieces in a row; a merged token stands at its first position, -2 elsewhere.

        Behind each piece stands -1, which keeps neighbours apart, and one more at the end.
        """
        data = np.frombuffer(b"\0".join(row) + b"\0\0", np.uint8)
        ends = np.append(np.cumsum([len(piece) + 1 for piece in row]) - 1, len(data) - 1)
        tokens = self.single[data]
        tokens[ends] = -1
        ranks = self.pairs[data[:-1].astype(np.int64) << 8 | data[1:]]
        ranks[ends[:-1]] = -1
        ranks[ends[ends > 0] - 1] = -1
        found = np.flatnonzero(ranks >= 0)
        found = found[np.argsort(ranks[found], kind="stable")]
        heap, first = np.unique(ranks[found], return_index=True)
        heap = heap.tolist()  # sorted, so a heap
        index = {rank: part.tolist() for rank, part in zip(heap, np.split(found, first[1:]))}
        ids, bytes_of, rank_of = tokens.tolist(), self.bytes_of, self._rank
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            length, follows, leads = len(bytes_of[rank]), self.follows.setdefault(rank, {}), self.leads.setdefault(rank, {})
            for done, p in enumerate(places):
                if ids[p] < 0:
                    continue
                q = after[p]
                r = after[q]
                if r - p != length:  # the bytes from here on are the token's, but no longer two tokens
                    continue
                ids[p], ids[q] = rank, -2
                after[p], before[r] = r, p
                again = False
                t = ids[r]
                if t >= 0:
                    new = follows.get(t)
                    if new is None:
                        new = rank_of(rank, t, follows, t)
                    if new >= 0:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heapq.heappush(heap, new)
                        again = new <= rank
                o = before[p]
                t = ids[o]  # before the first one lies the last, which is no token
                if t >= 0:
                    new = leads.get(t)
                    if new is None:
                        new = rank_of(t, rank, leads, t)
                    if new >= 0:
                        if new in index:
                            index[new].append(o)
                        else:
                            index[new] = [o]
                            heapq.heappush(heap, new)
                        again = again or new <= rank
                if again:  # a merge of lower rank has become possible and goes first
                    index.setdefault(rank, []).extend(places[done + 1:])
                    heapq.heappush(heap, rank)
                    break
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def _digests(ranks: dict[bytes, int], pattern: str):
    """Worker: tokens, digest of the ids and digest of the decoded bytes of every text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, pieces_of = MergeReplay(ranks), regex.compile(pattern).findall
        ids_of: dict[str, str] = {}
        bytes_of: dict[str, bytes] = {}
        for batch in batches:
            for part in slices(batch, "text", DIGEST_CHARS):
                split = [pieces_of(t or "") for t in part.column("text").to_pylist()]
                if len(ids_of) > REMEMBERED:
                    ids_of.clear()
                    bytes_of.clear()
                new = list(set().union(*split).difference(ids_of))
                for word, ids in zip(new, replay.encode([w.encode() for w in new])):
                    ids_of[word], bytes_of[word] = " ".join(map(str, ids)), replay.decode(ids)
                counts, ids_sha, text_sha = [], [], []
                for words in split:
                    listed = " ".join(map(ids_of.__getitem__, words))
                    counts.append(listed.count(" ") + 1 if words else 0)
                    ids_sha.append(hashlib.sha256(listed.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(b"".join(map(bytes_of.__getitem__, words))).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha),
                     pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return work


def _ids(ranks: dict[bytes, int], pattern: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, pieces_of = MergeReplay(ranks), regex.compile(pattern).findall
        for batch in batches:
            for part in slices(batch, "text"):
                split = [pieces_of(t or "") for t in part.column("text").to_pylist()]
                new = list({w for words in split for w in words})
                known = dict(zip(new, replay.encode([w.encode() for w in new])))
                out = [[i for w in words for i in known[w]] for words in split]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])
    return work


def _texts(ranks: dict[bytes, int]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = MergeReplay(ranks)
        for batch in batches:
            out = [replay.decode(ids or []).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])
    return work


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for k, size in enumerate(sizes):
        if k > start and total + size > limit:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id, ids`` of every row."""
    return docs.select("doc_id", "text").mapInArrow(_ids(ranks, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``doc_id, text`` of every row of ``encode``."""
    return encoded.select("doc_id", "ids").mapInArrow(_texts(ranks), "doc_id long, text string")


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Encode every text, decode the ids, and digest both, in one pass.

    A piece's ids, their decimal form and their decoded bytes are worked out once
    per piece; a text's are the concatenations.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        _digests(ranks, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


by_value(__name__)
