"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes.  Blocks are sorted
by (key, content), where the key is a digest of the content, and a block's integer
name is its place in that order: the key, followed by the rank of the content among
the sorted different contents of its key.  Adjacent names are paired and the pairs
named in the same way, level by level, until one name is left.  Names of one level
differ whenever their contents do, so the number of blocks and the last name are a
collision-free identity of the text.

Ranks other than 0 exist only for keys that stand for several contents.  Spark
compares the contents themselves, all levels in one pass, to find such keys; as a
rank on one level changes the pairs above it, the pass is repeated until no new
key shows up (with keys of 8 bytes, one pass).  Should more than ``MAX_SHARED`` keys
be shared, keys are made twice as long instead of shipping a large table.

Defined results
  NULL text            the empty text
  NULL id              loses against any id; equal texts with NULL ids only keep one of the rows
  repeated rows        exactly one row of equal texts stays, also if ids repeat
  very long texts      one name per block, never cut
  empty table          no rows
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.bpe import slices
from assayer.llm.shared import by_value, stored
from assayer.sources.tables import freeing_shuffles

BLOCK_BYTES, KEY_BYTES, MAX_SHARED = 1024, 8, 10_000


def normalise(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def naming(data: bytes, ranks: dict[bytes, int], block: int = BLOCK_BYTES, width: int = KEY_BYTES):
    """All (key, content) of a text, its number of blocks and its last name."""
    seen: list[tuple[bytes, bytes]] = []

    def name(content: bytes) -> bytes:
        key = hashlib.blake2b(content, digest_size=width).digest()
        seen.append((key, content))
        return key + ranks.get(content, 0).to_bytes(4, "big")

    names = [name(b"\0" + data[i:i + block]) for i in range(0, len(data) or 1, block)]
    count, level = len(names), 0
    while len(names) > 1:
        level += 1
        tag = level.to_bytes(1, "big")
        names = [name(tag + b"".join(names[i:i + 2])) for i in range(0, len(names), 2)]
    return seen, count, names[0]


def _contents(ranks: dict[bytes, int], block: int, width: int, only: frozenset[bytes] | None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = {}
                for text in part.column("text").to_pylist():
                    for key, content in naming(normalise(text), ranks, block, width)[0]:
                        if only is None or key in only:
                            found[content] = key
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.values(), pa.binary()), pa.array(found.keys(), pa.binary())], ["key", "content"])
    return work


def _identities(ranks: dict[bytes, int], block: int, width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, names, digests = [], [], []
                for text in part.column("text").to_pylist():
                    data = normalise(text)
                    _, count, last = naming(data, ranks, block, width)
                    counts.append(count)
                    names.append(last)
                    digests.append(hashlib.sha256(data).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), pa.array(counts, pa.int64()),
                     pa.array(names, pa.binary()), pa.array(digests, pa.string())],
                    ["row", "doc_id", "n_blocks", "name", "text_sha256"])
    return work


def shared_ranks(texts: DataFrame, block: int = BLOCK_BYTES, width: int = KEY_BYTES,
                 limit: int = MAX_SHARED) -> tuple[dict[bytes, int], int]:
    """Ranks of the contents whose key stands for several, and the width of the keys."""
    shape = "key binary, content binary"
    ranks: dict[bytes, int] = {}
    while True:
        contents = texts.mapInArrow(_contents(ranks, block, width, None), shape).distinct()
        keys = contents.groupBy("key").count().where("count > 1").select("key").limit(limit + 1).collect()
        if len(keys) > limit:
            ranks, width = {}, 2 * width
            continue
        if not keys:
            return {}, width
        only = frozenset(bytes(r.key) for r in keys)
        found = texts.mapInArrow(_contents(ranks, block, width, only), shape).distinct().collect()
        groups: dict[bytes, list[bytes]] = {}
        for r in found:
            groups.setdefault(bytes(r.key), []).append(bytes(r.content))
        # Contents start with their level, so those of lower levels keep their ranks.
        new = {c: i for group in groups.values() for i, c in enumerate(sorted(group)) if i}
        if new == ranks:
            return ranks, width
        ranks = new


def with_rows(docs: DataFrame) -> DataFrame:
    """Number the rows of a stored table; reading it again gives the same numbers."""
    return docs.withColumn("row", F.monotonically_increasing_id())


def identities(docs: DataFrame, block: int = BLOCK_BYTES, width: int = KEY_BYTES,
               limit: int = MAX_SHARED) -> DataFrame:
    """``row, doc_id, n_blocks, name, text_sha256`` from ``row, doc_id, text``."""
    rows = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    with freeing_shuffles(docs.sparkSession):
        ranks, width = shared_ranks(rows.select("text"), block, width, limit)
    return rows.mapInArrow(_identities(ranks, block, width),
                           "row long, doc_id long, n_blocks long, name binary, text_sha256 string")


def dedup(docs: DataFrame, block: int = BLOCK_BYTES, width: int = KEY_BYTES, limit: int = MAX_SHARED) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, row`` of every row of ``row, doc_id, text``.

    A group is counted in the tasks first; its rows meet again only in a join whose
    large partitions Spark can split.
    """
    named = stored(identities(docs, block, width, limit), "identities", free=True)
    groups = stored(
        named.groupBy("n_blocks", "name")
        .agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
        .where("group_size > 1"), "groups", free=True)
    joined = named.join(groups, ["n_blocks", "name"], "left")
    grouped = F.col("group_size").isNotNull()
    return joined.select(
        "doc_id", F.when(grouped, F.col("keep.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(grouped, F.col("row") == F.col("keep.row")).otherwise(True).alias("kept"), "text_sha256", "row")


by_value(__name__)
