"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are lower-cased words and the end of a text.  The root is the smoothed unigram
distribution of all training tokens.  A context, one or more words, is a state if it
keeps entries: next symbols that were seen after it ``LEAST`` times and pass a test of
divergence each, namely that the log-likelihood gained by giving this symbol its own
probability here, instead of its probability after the suffix, pays for the entry.  A
state gives what it keeps that probability and leaves the rest of its mass to its longest
retained suffix, so every state is a distribution.  A token is scored in the longest
retained state that ends its history.  Contexts grow by a word to the left, level by
level, as long as some entry passes, and at most to ``DEPTH`` words.

Words and grams are named by 64-bit keys, computed over whole columns of text at once.
Counting: a task sorts the grams of a few million tokens, counts equal ones and sends them
on in blocks by leading bits of the key; a block of all tasks is merged by one task, and
there are so many blocks that each has a few million grams at most.  No gram is dropped
before its whole count is known, but a gram is only looked at if the grams of its first and
of its last words were seen often enough themselves, which a filter of at most
``2 ** FILTER_BITS`` bits, three for each key, tells of most (it never says no wrongly).

Scoring: what the states change in the logarithm of a text's probability is a sum over its
grams, so all words, states and entries are one table of values per key.  Those that are a
share ``HEAD`` of all tokens are shipped (as shares of a level sum to one, at most
``1 / HEAD`` of each length); the others' keys travel to the table in blocks, as in counting.
Shipped values and filters are kept by the number of words, so a gram is looked for only
among those of its length, of which longer contexts have few.
Tables of a level are deleted once the next is written.

Defined results
  NULL or empty text    the end alone
  NULL id               not held out, not learned from
  no training rows      probability 1 for every token
  repeated rows         each row by itself; very long texts are scored whole
  empty table           no rows
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.bpe import slices
from assayer.llm.shared import by_value, fold, stored
from assayer.sources.tables import Scratch

#: Occurrences without which a gram is no entry and no context; weight of the suffix in a state; log-likelihood (nats) that an entry must gain; words of the longest context.
LEAST, SUFFIX_WEIGHT, ENTRY_COST, DEPTH = 4, 4.0, 4.0, 4
#: Least share of tokens for a value that is shipped; most bits of a filter of grams, bits a key below that, words of 64 that travel together.
HEAD, FILTER_BITS, KEY_BITS, PART = 5e-7, 26, 16, 1 << 12
#: Tokens a task counts, and keys it lists, before it sends them on; grams of a block in counting, tokens in scoring, where few are listed.
HELD, LISTED, BLOCK_GRAMS, BLOCK_TOKENS = 1_500_000, 300_000, 1_000_000, 2_000_000
#: Bytes of texts taken at once; of these, bytes hashed at once, whose sums and powers stay in a processor's cache.
TEXTS, HASHED = 1 << 20, 1 << 15

#: Key of the end of a text, which also stands before each text.
END = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
#: A value per byte, upper-case letters like lower-case ones.
_VALUES = np.random.default_rng(9).integers(1, 2 ** 63, 256).astype(np.uint64)
_VALUES[65:91] = _VALUES[97:123]


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of grams that go on with one more word."""
    return _mixed(key + word * END)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.ones(count, np.uint64)
    have, step = 1, base
    while have < count:  # base ** (have + i) = base ** have * base ** i
        more = min(have, count - have)
        out[have:have + more] = out[:more] * np.uint64(step)
        have, step = have + more, step * step % 2 ** 64
    return out


class Hasher:
    """Keys of the words in bytes of text: a polynomial over the bytes, modulo ``2 ** 64``, mixed.

    Prefix sums give the polynomial of any stretch, and the inverse of the base (which is
    odd) moves it to the front, so no word is looked at by itself.
    """

    def __init__(self):
        self.power = self.inverse = np.ones(0, np.uint64)

    def _table(self, count: int) -> None:
        if len(self.power) < count:
            self.power, self.inverse = _powers(_BASE, count), _powers(pow(_BASE, -1, 2 ** 64), count)

    def words(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the words of ``data`` and where they start; no word crosses one of the ``breaks``."""
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        word = _IN_WORD[data]
        begins, stops = word.copy(), word.copy()
        np.greater(word[1:], word[:-1], out=begins[1:])
        np.greater(word[:-1], word[1:], out=stops[:-1])
        inner = breaks[(breaks > 0) & (breaks < len(data))]
        begins[inner], stops[inner - 1] = word[inner], word[inner - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        keys = np.empty(len(starts), np.uint64)
        first = 0
        while first < len(starts):  # words that begin within so many bytes, and reach as far as they do
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + HASHED, "right")))
            low, high = starts[first], ends[last - 1]
            self._table(high - low + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_VALUES[data[low:high]] * self.power[:high - low], out=sums[1:])
            s, e = starts[first:last] - low, ends[first:last] - low
            keys[first:last] = _mixed((sums[e] - sums[s]) * self.inverse[s] + (e - s).astype(np.uint64))
            first = last
        return keys, starts

    def stream(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The keys of texts one after the other, the end before and after each, and the number of each one's text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        breaks = offsets - offsets[0]
        keys, starts = self.words(data, breaks[1:-1])
        counts = np.diff(np.searchsorted(starts, breaks)) + 2
        owner = np.repeat(np.arange(len(texts)), counts)
        last = np.cumsum(counts) - 1
        is_word = np.ones(len(owner), bool)
        is_word[last], is_word[last - counts + 1] = False, False
        out = np.full(len(owner), END)
        out[is_word] = keys
        return out, owner


def grams(stream: np.ndarray, longest: int) -> list[np.ndarray]:
    """Keys of the grams of 1 to ``longest`` words that begin at each place, those that leave their text included."""
    keys = [stream]
    for size in range(2, longest + 1):
        keys.append(longer(keys[-1][:-1], stream[size - 1:]))
    return keys


def inside(owner: np.ndarray, size: int) -> np.ndarray:
    """Whether the gram of ``size`` words at a place stays in its text."""
    return owner[:max(len(owner) - size + 1, 0)] == owner[size - 1:]


def _passing(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the keys that the filter lets pass: all three bits that a key names are set."""
    count, in_bytes = len(bits).bit_length() - 1 + 6, bits.view(np.uint8)
    mask = np.uint64(2 ** count - 1)
    out = None
    for shift in (64 - count, 64 - 2 * count, 0):
        slot = (key if out is None else key[out]) >> np.uint64(shift) & mask
        found = np.flatnonzero(in_bytes[(slot >> np.uint64(3)).view(np.int64)] >> (slot.astype(np.uint8) & np.uint8(7)) & np.uint8(1))
        out = found if out is None else out[found]
    return out


def _passes(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the filter lets keys pass."""
    passed = np.zeros(len(key), bool)
    passed[_passing(bits, key)] = True
    return passed


def filter_bits(count: int) -> int:
    """The power of two of bits that a filter of so many keys has."""
    return min(FILTER_BITS, max(6, int(np.ceil(np.log2(max(count, 1) * KEY_BITS)))))


def _filter_parts(bits_of: dict[int, int]):
    """What the keys of a task set in the filters of their sizes, in parts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {}
        for batch in batches:
            sizes, keys = batch.column("size").to_numpy(), batch.column("key").to_numpy().view(np.uint64)
            for size in np.unique(sizes).tolist():
                bits, key = bits_of[size], keys[sizes == size]
                mask = np.uint64(2 ** bits - 1)
                slot = np.sort(np.concatenate([key >> np.uint64(shift) & mask for shift in (64 - bits, 64 - 2 * bits, 0)]))
                at = (slot >> np.uint64(6)).view(np.int64)
                first = _first(at)
                held = filters.setdefault(size, np.zeros(2 ** (bits - 6), np.uint64))
                held[at[first]] |= np.bitwise_or.reduceat(np.uint64(1) << (slot & np.uint64(63)), first)
        for size, held in filters.items():
            parts = [(k, held[k * PART:(k + 1) * PART]) for k in range(-(-len(held) // PART))]
            parts = [(k, x.tobytes()) for k, x in parts if x.any()]
            yield pa.RecordBatch.from_pydict({"size": [size] * len(parts), "part": [k for k, _ in parts], "bits": [x for _, x in parts]},
                                             pa.schema([("size", pa.int32()), ("part", pa.int32()), ("bits", pa.binary())]))
    return work


def _filter_part(part: pa.Table) -> pa.Table:
    """All bits that tasks set in a part of a filter."""
    bits = reduce(np.bitwise_or, (np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("bits")))
    return pa.table({"size": part.column("size")[:1], "part": part.column("part")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})


def filters_of(keys: DataFrame) -> dict[int, np.ndarray]:
    """For each ``size`` the bits that three stretches of a ``key`` number, in words of 64."""
    bits_of = {r["size"]: filter_bits(r["count"]) for r in keys.groupBy("size").count().collect()}
    schema = "size int, part int, bits binary"
    rows = keys.select("size", "key").mapInArrow(_filter_parts(bits_of), schema).groupBy("size", "part").applyInArrow(_filter_part, schema).toArrow()
    out = {size: np.zeros(2 ** (bits - 6), np.uint64) for size, bits in bits_of.items()}
    for size, part, bits in zip(*[rows[c].to_pylist() for c in ("size", "part", "bits")]):
        out[size][part * PART:(part + 1) * PART] = np.frombuffer(bits, np.uint64)
    return out


def _first(keys: np.ndarray) -> np.ndarray:
    """Where equal neighbours of sorted keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])


def _sorted_places(keys: np.ndarray) -> np.ndarray:
    """Places of the keys by their leading bits, which leave room for a place: equal keys are neighbours, but for rare ones that share these bits."""
    room = np.uint64(2 ** len(keys).bit_length() - 1)
    return (np.sort(keys & ~room | np.arange(len(keys), dtype=np.uint64)) & room).view(np.int64)


def _packed(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": [b for b, _ in found], "packed": [x for _, x in found]},
                                      pa.schema([("block", pa.int32()), ("packed", pa.binary())]))


def _count_words(blocks: int):
    """Counts of words in blocks: keys and how often."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, waiting = Hasher(), [], 0

        def out() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            first = _first(keys)
            n, keys = np.diff(np.append(first, len(keys))).astype(np.uint32), keys[first]
            return _packed([(block, keys[a:b].tobytes() + n[a:b].tobytes()) for block, a, b in _blocks(keys, blocks)])

        for batch in batches:
            for part in slices(batch, "text", TEXTS):
                stream, owner = hasher.stream(part.column("text"))
                held.append(stream[1:][owner[1:] == owner[:-1]])  # the end once
                waiting += len(held[-1])
                if waiting > HELD:
                    yield out()
                    held, waiting = [], 0
        yield out()
    return work


def _merge_words(packed: pa.Table) -> pa.Table:
    """The words of a block."""
    parts = [np.frombuffer(x.as_buffer(), np.uint8) for x in packed.column("packed")]
    counts = [len(p) // 12 for p in parts]
    key = np.concatenate([p[:8 * m].view(np.uint64) for p, m in zip(parts, counts)])
    n = np.concatenate([p[8 * m:].view(np.uint32) for p, m in zip(parts, counts)])
    order = np.argsort(key)
    first = _first(key[order])
    n = np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return pa.table({"key": key[order[first]].view(np.int64), "n": n})


def _blocks(keys: np.ndarray, blocks: int) -> list[tuple[int, int, int]]:
    """Number, begin and end of the blocks of sorted keys, by their leading bits."""
    shift = np.uint64(64 - (blocks.bit_length() - 1))
    number = keys >> shift if blocks > 1 else np.zeros(len(keys), np.uint64)
    first = _first(number)
    return [(int(number[a]), int(a), int(b)) for a, b in zip(first, np.append(first[1:], len(keys)))]


def _count_grams(size: int, shorter: np.ndarray, blocks: int):
    """Counts of grams of ``size`` words in blocks: the context's keys, the last word's, and how often."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, waiting = Hasher(), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            context, word = (np.concatenate(x) for x in zip(*held))
            key = longer(context, word)
            order = _sorted_places(key)
            key = key[order]
            first = _first(key)
            n = np.diff(np.append(first, len(key))).astype(np.uint32)
            key, order = key[first], order[first]
            context, word = context[order], word[order]
            for block, a, b in _blocks(key, blocks):
                yield _packed([(block, context[a:b].tobytes() + word[a:b].tobytes() + n[a:b].tobytes())])

        for batch in batches:
            for part in slices(batch, "text", TEXTS):
                stream, owner = hasher.stream(part.column("text"))
                context = grams(stream, size - 1)[-1]
                passes = _passes(shorter, context)
                counted = inside(owner, size) & passes[:-1] & passes[1:]
                held.append((context[:-1][counted], stream[size - 1:][counted]))
                waiting += int(counted.sum())
                if waiting > HELD:
                    yield from out()
                    held, waiting = [], 0
        yield from out()
    return work


def _merge_grams(least: int):
    """The grams of a block that were seen ``least`` times, with their keys."""

    def work(packed: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), np.uint8) for x in packed.column("packed")]
        counts = [len(p) // 20 for p in parts]
        context = np.concatenate([p[:8 * m].view(np.uint64) for p, m in zip(parts, counts)])
        word = np.concatenate([p[8 * m:16 * m].view(np.uint64) for p, m in zip(parts, counts)])
        n = np.concatenate([p[16 * m:].view(np.uint32) for p, m in zip(parts, counts)])
        key = longer(context, word)
        # Most are seen too seldom even together with those that share their last bits.
        slot = (key & np.uint64(2 ** (len(key).bit_length() + 1) - 1)).view(np.int64)
        often = np.flatnonzero((np.bincount(slot, n) >= least)[slot])
        key, context, word, n = key[often], context[often], word[often], n[often]
        order = np.argsort(key)
        first = _first(key[order])
        n = np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        at = order[first][n >= least]
        return pa.table({"key": key[at].view(np.int64), "context": context[at].view(np.int64), "word": word[at].view(np.int64), "n": n[n >= least]})
    return work


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of grams without their first word: of the context without it (0 if it is a single word) and the last word."""
    for batch in batches:
        rest, word = (batch.column(x).to_numpy(zero_copy_only=False).view(np.uint64) for x in ("rest_of_context", "word"))
        suffix = np.where(rest != 0, longer(rest, word), word).view(np.int64)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "context", "n", "seen")], pa.array(suffix)],
                                         ["key", "context", "n", "seen", "suffix"])


def blocks_for(items: int, of_block: int) -> int:
    """A power of two, so that blocks of leading bits have about ``of_block`` items."""
    return 1 << max(0, int(np.ceil(np.log2(max(items, 1) / of_block))))


def grow(scratch: Scratch, training: DataFrame, words: DataFrame, total: int, vocabulary: int, least: int, depth: int | None) -> list[DataFrame]:
    """Per level a written table of ``size, key, n, gain``: what states and entries change in a text's log10 probability.

    A state adds the share that it leaves to the suffix wherever its context is followed
    by something, an entry what its own probability adds to that.
    """
    below = total + 0.5 * (vocabulary + 1)
    # Probability of the last word of each gram after the others, in the longest state so far.
    shorter = scratch.keep(words.where(F.col("n") >= least).select(
        "key", F.lit(0).cast("long").alias("suffix"), "n", ((F.col("n") + 0.5) / F.lit(below)).alias("p")), "shorter")
    found, size, blocks = [], 1, blocks_for(total, BLOCK_GRAMS)
    while depth is None or size <= depth:
        size += 1
        often = filters_of(shorter.select(F.lit(size - 1).alias("size"), "key")).get(size - 1, np.zeros(1, np.uint64))
        counted = scratch.keep(
            training.mapInArrow(_count_grams(size, often, blocks), "block int, packed binary")
            .groupBy("block").applyInArrow(_merge_grams(least), "key long, context long, word long, n long"), "grams")
        entries = scratch.keep(
            counted.join(shorter.select(F.col("key").alias("context"), F.col("suffix").alias("rest_of_context"), F.col("n").alias("seen")), "context")
            .mapInArrow(_suffixes, "key long, context long, n long, seen long, suffix long")
            .join(shorter.select(F.col("key").alias("suffix"), F.col("p").alias("q")), "suffix"), "entries")
        scratch.drop(counted, shorter)
        n, whole, q = F.col("n"), F.greatest("seen", "n") + F.lit(SUFFIX_WEIGHT), F.col("q")
        left = (whole - n) / whole
        gain = n * F.log((n / whole + left * q) / q) + F.greatest(F.col("seen") - n, F.lit(0)) * F.log(left)
        kept = scratch.keep(entries.where(gain > ENTRY_COST).select("key", "context", "n", "seen"), "kept")
        states = scratch.keep(kept.groupBy("context").agg(F.sum("n").alias("kept"), F.max("seen").alias("seen")).withColumn(
            "whole", F.greatest("seen", "kept") + F.lit(SUFFIX_WEIGHT)).select(
            "context", "seen", "whole", ((F.col("whole") - F.col("kept")) / F.col("whole")).alias("rest")), "states")
        if states.isEmpty():
            scratch.drop(entries, kept, states)
            break
        own = F.when(gain > ENTRY_COST, n / F.col("state_whole")).otherwise(F.lit(0.0)) + F.col("rest") * q
        shorter = scratch.keep(entries.join(states.select("context", F.col("whole").alias("state_whole"), "rest"), "context", "left").select(
            "key", "suffix", "n", F.coalesce(own, q).alias("p"),
            F.when(F.col("rest").isNotNull() & (gain > ENTRY_COST), F.log10(own / q) - F.log10("rest")).alias("gain")), "shorter")
        found.append(scratch.keep(
            shorter.where("gain IS NOT NULL").select(F.lit(size).alias("size"), "key", "n", "gain").unionAll(states.select(
                F.lit(size - 1).alias("size"), F.col("context").alias("key"), F.col("seen").alias("n"), F.log10("rest").alias("gain"))), "gains"))
        scratch.drop(entries, kept, states)
    scratch.drop(shorter)
    return found


class Lookup:
    """Places of keys among sorted ones, by their leading bits and few steps from there."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, min(21, int(np.ceil(np.log2(max(len(keys), 1)))) + 2))
        leading = keys >> np.uint64(64 - self.bits)
        self.first = np.searchsorted(leading, np.arange(2 ** self.bits + 1, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.diff(self.first).max(initial=0))
        self.there_bits = max(1, min(22, int(np.ceil(np.log2(max(len(keys), 1)))) + 4))
        self.there = np.zeros(2 ** self.there_bits, bool)
        self.there[(keys >> np.uint64(64 - self.there_bits)).view(np.int64)] = True

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their places."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = np.flatnonzero(self.there[(keys >> np.uint64(64 - self.there_bits)).view(np.int64)])
        asked = keys[which]
        leading = (asked >> np.uint64(64 - self.bits)).view(np.int64)
        at = self.first[leading]  # not past the end, as a key with as many leading bits is there
        missed = np.flatnonzero(self.keys[at] != asked)
        if len(missed):
            end, open_ = self.first[leading[missed] + 1], missed
            for _ in range(self.most):
                at[open_] += 1
                more = at[open_] < end
                at[open_[~more]] = -1
                open_, end = open_[more], end[more]
                wrong = self.keys[at[open_]] != asked[open_]
                open_, end = open_[wrong], end[wrong]
                if not len(open_):
                    break
            hit = np.flatnonzero(at >= 0)
            which, at = which[hit], at[hit]
        return which, at

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places, -1 for those not there."""
        out = np.full(len(keys), -1)
        which, at = self.hits(keys)
        out[which] = at
        return out


def _unique(values: pa.Table) -> tuple[np.ndarray, ...]:
    """Sorted keys, each once, and the sums of what is told of them: a word or an entry may be a state as well."""
    key = values.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    first = _first(key[order])
    return key[order[first]], *[np.add.reduceat(values.column(c).to_numpy()[order].astype(np.float64), first) if len(first) else np.zeros(0)
                                for c in ("known", "base", "gain")]


def planes(x: np.ndarray) -> bytes:
    """Numbers as all their first bytes, then all their second ones, and so on: what neighbours have alike then compresses."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def from_planes(data: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def listing(key: np.ndarray, row: np.ndarray) -> bytes:
    """Sorted keys and their rows; rows as distances from the smallest, in as few bytes as these need."""
    low = row.min()
    away = row - low
    return np.array([len(key), low], np.int64).tobytes() + planes(key) + away.astype(np.min_scalar_type(int(away.max()))).tobytes()


def listed_keys(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys and rows of a listing."""
    count, low = packed[:16].view(np.int64)
    key, away = from_planes(packed[16:16 + 8 * count], np.uint64), packed[16 + 8 * count:]
    return key, away.view(f"u{len(away) // count}").astype(np.int64) + low


_SCORED = ("block int, packed binary, row long, doc_id long, held_out boolean, n_tokens long, known long, base double, gain double")
_SCORED_ARROW = pa.schema([("block", pa.int32()), ("packed", pa.binary()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()),
                           ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("gain", pa.float64())])


def _scored(head: list[tuple[np.ndarray, ...]], others_in: dict[int, np.ndarray], end: tuple[int, float], blocks: int):
    """Sums of the shipped values of every text, which ``head`` has by size; the keys of its others, in blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, lookups = Hasher(), [Lookup(x[0]) for x in head]
        keys, rows, waiting = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            key, row = np.concatenate(keys), np.concatenate(rows)
            order = np.argsort(key)
            key, row = key[order], row[order]
            found = _blocks(key, blocks)
            yield pa.RecordBatch.from_pydict(
                {"block": [b for b, _, _ in found], "packed": [listing(key[a:z], row[a:z]) for _, a, z in found],
                 **{f.name: [None] * len(found) for f in _SCORED_ARROW if f.name not in ("block", "packed")}}, _SCORED_ARROW)

        for batch in batches:
            for part in slices(batch, "text", TEXTS):
                stream, owner = hasher.stream(part.column("text"))
                docs = part.num_rows
                sizes = np.bincount(owner, minlength=docs) - 1
                known, base, gain = np.full(docs, end[0]), np.full(docs, end[1]), np.zeros(docs)
                ids = part.column("row").to_numpy()
                for size, key in enumerate(grams(stream, len(head)), 1):
                    # The end after a text is no context, and is counted apart.
                    stays = inside(owner, max(size, 2))
                    key, of = key[:len(stays)][stays], owner[:len(stays)][stays]
                    which, found = lookups[size - 1].hits(key)
                    place = of[which]
                    known_of, base_of, gain_of = head[size - 1][1:]
                    gain += np.bincount(place, gain_of[found], docs)
                    if size == 1:
                        known = known + np.bincount(place, known_of[found], docs).astype(np.int64)
                        base += np.bincount(place, base_of[found], docs)
                    if size not in others_in:
                        continue
                    hit = np.zeros(len(key), bool)
                    hit[which] = True
                    other = _passing(others_in[size], key)
                    other = other[~hit[other]]
                    keys.append(key[other])
                    rows.append(ids[of[other]])
                    waiting += len(keys[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(docs, pa.int32()), pa.nulls(docs, pa.binary()), part.column("row"), part.column("doc_id"), part.column("held_out"),
                     pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(gain)], schema=_SCORED_ARROW)
                if waiting > LISTED:
                    yield from out()
                    keys, rows, waiting = [], [], 0
        yield from out()
    return work


def _by_row(rows: np.ndarray, known: np.ndarray, base: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, ...]:
    """One sum for each row."""
    if len(rows) and (reach := int(rows.max()) - (low := int(rows.min())) + 1) <= 4 * len(rows) + 1_000:  # neighbours, counted without sorting
        place = rows - low
        found = np.flatnonzero(np.bincount(place, minlength=reach))
        return found + low, *[np.bincount(place, x, reach)[found] for x in (known, base, gain)]
    found, place = np.unique(rows, return_inverse=True)
    return found, *[np.bincount(place, x, len(found)) for x in (known, base, gain)]


def packed_sums(row: np.ndarray, known: np.ndarray, base: np.ndarray, gain: np.ndarray) -> bytes:
    """Sums of rising rows; rows as steps, which are small."""
    return planes(np.diff(row, prepend=0)) + planes(known.astype(np.uint32)) + base.tobytes() + gain.tobytes()


def sums_of(packed: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows and sums that were packed."""
    n = len(packed) // 28
    return (np.cumsum(from_planes(packed[:8 * n], np.int64)), from_planes(packed[8 * n:12 * n], np.uint32),
            packed[12 * n:20 * n].view(np.float64), packed[20 * n:].view(np.float64))


def _looked_up(ranges: int):
    """Sums per row of the values of a block's keys, packed by ranges of rows."""

    def work(block: tuple, listed: pa.Table, values: pa.Table) -> pa.Table:
        keys, *columns = _unique(values)
        lookup, sums = Lookup(keys), []
        for part in listed.column("packed"):
            key, row = listed_keys(np.frombuffer(part.as_buffer(), np.uint8))
            which, at = lookup.hits(key)
            sums.append(_by_row(row[which], *[c[at] for c in columns]))
        out: dict[str, list] = {"range": [], "packed": []}
        if sums:
            found = [np.concatenate(x) for x in zip(*sums)]  # a row is in one listing of a block
            order = np.argsort(found[0], kind="stable")  # of sorted runs
            spread = _mixed(found[0][order].view(np.uint64))
            by_range = np.argsort((spread >> np.uint64(64 - (ranges.bit_length() - 1)) if ranges > 1 else np.zeros(len(spread), np.uint64)).astype(
                np.min_scalar_type(ranges)), kind="stable")
            found = [x[order[by_range]] for x in found]
            for number, a, z in _blocks(spread[by_range], ranges):
                out["range"].append(number)
                out["packed"].append(packed_sums(*[x[a:z] for x in found]))
        return pa.table({"range": pa.array(out["range"], pa.int32()), "packed": pa.array(out["packed"], pa.binary())})
    return work


def _summed(packed: pa.Table) -> pa.Table:
    """The sums of a range of rows over all blocks."""
    parts = [sums_of(np.frombuffer(x.as_buffer(), np.uint8)) for x in packed.column("packed")]
    row, known, base, gain = _by_row(*[np.concatenate(x) for x in zip(*parts)])
    return pa.table({"row": row, "known": known.astype(np.int64), "base": base, "gain": gain})


def score(docs: DataFrame, least: int = LEAST, depth: int | None = DEPTH, head: float = HEAD) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``row, doc_id, text``."""
    fifth = fold(F.col("doc_id"))
    rows = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(fifth == 1, F.lit(False)).alias("held_out"), "text", (fifth != 1).alias("learn"))
    training = rows.where("learn").select("text")
    with Scratch(docs.sparkSession, "suffix-tree") as scratch:
        # Twice as many blocks as tasks, so that a block has half of what a task counts.
        words = scratch.keep(training.mapInArrow(_count_words(blocks_for(2 * training.rdd.getNumPartitions(), 1)), "block int, packed binary")
                             .groupBy("block").applyInArrow(_merge_words, "key long, n long"), "words")
        total, vocabulary = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        below = total + 0.5 * (vocabulary + 1)
        unknown = float(np.log10(0.5 / below))
        levels = grow(scratch, training, words, total, vocabulary, max(least, 1), depth)

        # Words are their own gain over an unknown word; the end before a text is a context only.
        end = int(np.array(END).view(np.int64))
        is_word = F.col("key") != end
        base = F.when(is_word, F.log10((F.col("n") + 0.5) / F.lit(below)) - unknown).otherwise(0.0)
        table = words.select(F.lit(1).alias("size"), "key", "n", is_word.cast("long").alias("known"), base.alias("base"), F.lit(0.0).alias("gain"))
        # What is told of a key has the same count, and is added up where it is looked up.
        values = scratch.keep(reduce(DataFrame.unionAll, [g.select("size", "key", "n", F.lit(0).cast("long"), F.lit(0.0), "gain") for g in levels],
                                     table), "values")
        ends = words.where(F.col("key") == end).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        at_end = (1 if ends else 0, float(np.log10((ends + 0.5) / below)) - unknown if ends else 0.0)
        scratch.drop(words, *levels)  # the values have all of it
        shipped = values.where(F.col("n") >= head * total).select("size", "key", "known", "base", "gain").toArrow()
        arrays = [_unique(shipped.filter(pc.equal(shipped["size"], size))) for size in range(1, len(levels) + 2)]
        others = values.where(F.col("n") < head * total)
        blocks = blocks_for(total, BLOCK_TOKENS)
        scored = scratch.keep(rows.select("row", "doc_id", "held_out", "text").mapInArrow(
            _scored(arrays, filters_of(others), at_end, blocks), _SCORED), "scored")
        in_block = F.shiftrightunsigned("key", 64 - (blocks.bit_length() - 1)).cast("int") if blocks > 1 else F.lit(0)
        found = scored.where("block IS NOT NULL").select("block", "packed").groupBy("block").cogroup(
            others.select(in_block.alias("block"), "key", "known", "base", "gain").groupBy("block")).applyInArrow(
            _looked_up(blocks), "range int, packed binary").groupBy("range").applyInArrow(
            _summed, "row long, known long, base double, gain double")
        texts = scored.where("block IS NULL").drop("block", "packed")
        summed = texts.unionByName(found, allowMissingColumns=True).groupBy("row").agg(
            *[F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")], *[F.sum(c).alias(c) for c in ("known", "base", "gain")])
        base_score = F.col("base") + F.col("n_tokens") * F.lit(unknown)
        result = stored(summed.select(
            "doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
            base_score.alias("base_score"), (base_score + F.col("gain")).alias("score")), "scores", free=True)
    return result


by_value(__name__)
