"""N-gram Jaccard join with filters of several global orders.

A document's set holds its distinct word shingles, as 64-bit digests.  Two sets can
only be similar enough if they share a token among the first few (the prefix) under
*any* one order of all tokens, so they must share one under every order.  Three
orders are used: all put tokens that are frequent in a bounded sample last, and
break ties by different digests.  Any fixed order gives exact results; the sample
only decides how few candidates there are.

1. Equal sets become one class.  Prefixes are taken of classes.
2. Classes that share a prefix token of the first order stand in one bucket.  In
   rounds, a few leaders of every bucket are paired with its other members, where
   sizes and token positions allow it and the two are not known to be connected.
   A leader then leaves the bucket, and a bucket whose members are all connected is
   done; rounds go on, with more leaders each time, until no bucket is left.  Large
   groups of copies thus cost a pair per member instead of all pairs, and no pair is
   left out that could connect anything.
3. A pair must also share prefix tokens of the other orders.
4. What remains is verified on the whole sets; links are merged into components.

Defined results
  NULL or empty text, no words   empty set, linked with nothing, component = own id
  fewer words than a shingle     the whole sequence is the one element
  equal sets                     linked, whatever their number
  NULL id                        never names a component; a component of NULL ids only is NULL
  repeated rows                  each row is returned
  empty table                    no rows
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.bpe import slices
from assayer.llm.shared import by_value, stored
from assayer.sources.tables import Scratch, freeing_shuffles

WORDS, PERCENT = 3, 90
#: One document in so many is counted for the orders, and so many frequent tokens are kept at most.
SAMPLE_STEP, FREQUENT = 8, 1_000_000
#: Bits of the filter that spares texts which no candidate needs; more leaders per round.
FILTER_BITS, GROWTH, THIN = 1 << 23, 8, 16
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class _Digests(dict):
    """Digest of a word, remembered while it is in use."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(values: np.ndarray, factor: int) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(factor)
    return values ^ (values >> np.uint64(29))


def shingles(text: str | None, digests: dict[bytes, int], words: int = WORDS) -> np.ndarray:
    """Sorted digests of the distinct shingles; words end at ASCII white space, A-Z count as a-z."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(digests.__getitem__, found), np.uint64, len(found))
    size = min(words, len(codes))
    total = np.full(len(codes) - size + 1, size, np.uint64)
    for k in range(size):
        total = _mixed(total + codes[k:len(codes) - size + 1 + k], MIX[0])
    return np.unique(total)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def prefixes(tokens: np.ndarray, frequent: np.ndarray, ranks: np.ndarray, percent: int) -> list[np.ndarray]:
    """The first tokens under every order, cut to 32 bits."""
    weight = np.zeros(len(tokens), np.uint64)
    if len(frequent) and len(tokens):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        weight = np.where(frequent[at] == tokens, ranks[at], 0).astype(np.uint64)
    size, out = prefix_length(len(tokens), percent), []
    for factor in MIX:
        keys = weight << np.uint64(56) | _mixed(tokens, factor) >> np.uint64(8)
        first = np.argpartition(keys, size - 1)[:size] if 0 < size < len(keys) else np.arange(len(keys))
        first = first[np.lexsort((tokens[first], keys[first]))]
        out.append((tokens[first] >> np.uint64(32)).astype(np.uint32))
    return out


def _sampled(words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = _Digests()
        for batch in batches:
            for part in slices(batch, "text"):
                found = [shingles(t, digests, words) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["token"])
    return work


def _described(frequent: np.ndarray, ranks: np.ndarray, words: int, percent: int, seed: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = _Digests()
        for batch in batches:
            for part in slices(batch, "text"):
                columns = {k: [] for k in ("n", "set", "class", "first", "second", "third")}
                for text in part.column("text").to_pylist():
                    tokens = shingles(text, digests, words)
                    digest = hashlib.blake2b(tokens.tobytes(), digest_size=24, salt=bytes([seed])).digest()
                    first, second, third = prefixes(tokens, frequent, ranks, percent)
                    for k, v in zip(columns, (len(tokens), digest[:16], int.from_bytes(digest[16:], "big", signed=True),
                                              first.view(np.int32), second.tobytes(), third.tobytes())):
                        columns[k].append(v)
                kinds = (pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), *(pa.array(v, t) for v, t in zip(columns.values(), kinds))],
                    ["row", "doc_id", *columns])
    return work


def _share_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a2, b2, a3, b3 in zip(*(batch.column(c).to_pylist() for c in ("a_second", "b_second", "a_third", "b_third"))):
            keep.append(all(len(np.intersect1d(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)))
                            for x, y in ((a2, b2), (a3, b3))))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _needed_sets(bits: np.ndarray, words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = _Digests()
        for batch in batches:
            at = batch.column("bit").to_numpy()
            wanted = batch.filter(pa.array((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for part in slices(wanted, "text"):
                sets = [shingles(t, digests, words).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(sets, pa.binary())], ["row", "tokens"])
    return work


def _verified(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_tokens").to_pylist(), batch.column("b_tokens").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return work


def describe(scratch: Scratch, docs: DataFrame, words: int, percent: int, sample_step: int) -> DataFrame:
    """Per row: size and class of its set, prefixes under the three orders."""
    rows = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    sampled = scratch.keep(rows.where(F.pmod(F.xxhash64("row"), F.lit(sample_step)) == 0).select("text")
                     .mapInArrow(_sampled(words), "token long").groupBy("token").count().where("count > 2"), "frequent")
    # The least count that at most FREQUENT tokens reach.
    least, reached = 1 << 62, 0
    for r in sorted(sampled.groupBy("count").agg(F.count("*").alias("tokens")).collect(), key=lambda r: -r["count"]):
        reached += r["tokens"]
        if reached > FREQUENT:
            break
        least = r["count"]
    counted = sampled.where(F.col("count") >= least).toPandas()
    scratch.drop(sampled)
    frequent = counted["token"].to_numpy(np.int64).view(np.uint64)
    ranks = np.minimum(255, 8 * np.log2(counted["count"].to_numpy(float))).astype(np.uint64)
    order = np.argsort(frequent)
    for seed in range(16):
        found = scratch.keep(rows.mapInArrow(
            _described(frequent[order], ranks[order], words, percent, seed),
            "row long, doc_id long, n int, set binary, class long, first array<int>, second binary, third binary"), "sets")
        twice = found.groupBy("class").agg(F.min("set").alias("x"), F.max("set").alias("y")).where("x <> y")
        if twice.isEmpty():  # no two sets share a class number
            return found
        scratch.drop(found)
    raise RuntimeError("class numbers keep colliding")


def connected(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``node, label`` with the smallest node of each component, from ``a, b``.

    Every node takes the smallest label around it, then the label of that label.
    """
    both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    last = labels = scratch.keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        around = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near")))
        lower = scratch.keep(labels.join(around, labels["node"] == around["a"]).select(
            "node", "label", F.least("label", "near").alias("next")), "lower")
        scratch.drop(last)
        jump = lower.select(F.col("node").alias("at"), F.col("next").alias("after"))
        last = new = scratch.keep(lower.join(jump, lower["next"] == jump["at"]).select(
            "node", "label", F.least("next", "after").alias("next")), "jumped")
        scratch.drop(lower)
        done = new.where("label <> next").isEmpty()
        labels = new.select("node", F.col("next").alias("label"))
        if done:
            scratch.drop(both)
            return labels


def _fit(percent: int) -> str:
    """Sizes and first common positions that leave enough tokens in common."""
    return (f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND "
            f"{100 + percent} * least(x.n - x.pos, y.n - y.pos) >= {percent} * (x.n + y.n)")


def component_labels(scratch: Scratch, docs: DataFrame, classes: DataFrame, words: int, percent: int,
                     thin: int = THIN, growth: int = GROWTH) -> DataFrame | None:
    """``node, label`` of the classes that are linked to another one; None if none is."""
    placed = classes.select(F.posexplode("first").alias("pos", "token"), "class", "n")
    several = scratch.keep(placed.groupBy("token").count().where("count > 1").select("token"), "tokens")
    members = scratch.keep(placed.join(several, "token"), "members")
    scratch.drop(several)
    labels, tested, leaders, turn = None, None, 1, 0
    while True:
        rows = members.where(F.pmod(F.xxhash64("token"), F.lit(thin)) == 0) if turn == 0 else members
        if labels is None:
            rows = rows.withColumn("label", F.col("class"))
        else:
            rows = rows.join(labels, rows["class"] == labels["node"], "left").select(
                *[rows[c] for c in ("token", "pos", "class", "n")], F.coalesce("label", "class").alias("label"))
        rows = labelled = scratch.keep(rows, "labelled")
        active = scratch.keep(rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"))
                        .where("low < high").select("token"), "active")
        if turn and active.isEmpty():
            return labels
        rows = rows.join(active, "token", "left_semi")
        by_digest = W.partitionBy("token").orderBy(F.xxhash64("class", "token"), "class")
        heads = scratch.keep(rows.withColumn("at", F.row_number().over(by_digest)).where(F.col("at") <= leaders).drop("at"), "leaders")
        pairs = (rows.alias("x").join(heads.alias("y"), F.expr(
            f"x.token = y.token AND x.label <> y.label AND x.class <> y.class AND {_fit(percent)}"))
            .select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct())
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if turn:
            scratch.drop(members)
            members = scratch.keep(rows.join(heads.select("token", "class"), ["token", "class"], "left_anti").select(
                "token", "pos", "class", "n"), "members")
            leaders *= growth
        else:
            leaders = 4
        scratch.drop(labelled, active, heads)
        turn += 1
        links = _links(scratch, docs, classes, pairs, words, percent)
        if links is not None:
            labels = _merge(scratch, labels, links)
            scratch.drop(links)


def _links(scratch: Scratch, docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame | None:
    """The pairs that pass the other orders and whose whole sets are similar."""
    def side(which: str) -> DataFrame:
        return classes.select(F.col("class").alias(which), F.col("second").alias(f"{which}_second"),
                              F.col("third").alias(f"{which}_third"), F.col("row").alias(f"{which}_row"))

    several = pairs.join(side("a").drop("a_row"), "a").join(side("b").drop("b_row"), "b")
    candidates = scratch.keep(several.mapInArrow(_share_prefixes, "a long, b long"), "candidates")
    ends = candidates.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    needed = scratch.keep(classes.select("class", "row").join(ends, "class", "left_semi"), "needed")
    bit = F.pmod(F.xxhash64("row"), F.lit(FILTER_BITS))
    filled = needed.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("bits")).collect()
    if not filled:
        scratch.drop(candidates, needed)
        return None
    words_of = np.zeros(FILTER_BITS >> 6, np.uint64)
    words_of[[r["word"] for r in filled]] = np.array([r["bits"] for r in filled], np.int64).view(np.uint64)
    sets = docs.select("row", "text", bit.alias("bit")).mapInArrow(
        _needed_sets(words_of, words), "row long, tokens binary").join(needed, "row").select("class", "tokens")
    sets = scratch.keep(sets, "tokens")
    left = candidates.join(sets.select(F.col("class").alias("a"), F.col("tokens").alias("a_tokens")), "a")
    both = left.join(sets.select(F.col("class").alias("b"), F.col("tokens").alias("b_tokens")), "b")
    links = scratch.keep(both.mapInArrow(_verified(percent), "a long, b long"), "links")
    scratch.drop(candidates, needed, sets)
    return None if links.isEmpty() else links


def _merge(scratch: Scratch, labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links: the links join components of before."""
    if labels is None:
        return connected(scratch, links)
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("a_label"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("b_label"))
    known = links.join(a, "a", "left").join(b, "b", "left").select(
        F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    new = connected(scratch, known).select(F.col("node").alias("was"), F.col("label").alias("now"))
    moved = labels.join(new, labels["label"] == new["was"], "left").select("node", F.coalesce("now", "label").alias("label"))
    added = new.join(labels, new["was"] == labels["node"], "left_anti").select(
        F.col("was").alias("node"), F.col("now").alias("label"))
    return scratch.keep(moved.unionByName(added), "merged")


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, sample_step: int = SAMPLE_STEP,
               thin: int = THIN, growth: int = GROWTH) -> DataFrame:
    """``row, doc_id, n_shingles, component_id, group`` of every row of ``row, doc_id, text``.

    ``group`` numbers the components of documents with words, also where no id names them.
    """
    spark = docs.sparkSession
    with Scratch(spark, "jaccard") as scratch, freeing_shuffles(spark):
        described = describe(scratch, docs, words, percent, sample_step)
        rows = scratch.keep(described.select("row", "doc_id", F.col("n").cast("long").alias("n_shingles"), "class"), "described")
        classes = scratch.keep(described.where("n > 0").dropDuplicates(["class"]).drop("doc_id", "set"), "classes")
        scratch.drop(described)
        labels = component_labels(scratch, docs, classes, words, percent, thin, growth)
        if labels is not None:
            rows = rows.join(labels, rows["class"] == labels["node"], "left").withColumn(
                "class", F.coalesce("label", "class"))
        rows = stored(rows.select("row", "doc_id", "n_shingles", "class"), "rows", free=True)
    smallest = stored(rows.where("n_shingles > 0").groupBy("class").agg(
        F.min("doc_id").alias("smallest"), F.count("*").alias("size")).where("size > 1").drop("size"), "smallest", free=True)
    return rows.join(smallest, "class", "left").select(
        "row", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("smallest", "doc_id"))
        .otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n_shingles") > 0, F.col("class")).alias("group"))


by_value(__name__)
