"""Approximate nearest neighbours by multi-index hashing, largest inner product first.

Codes.  Candidates are laid into bands of similar length; in a band each vector gets one
more component that makes all equally long, and queries get a zero there, so that the
angle falls as the product rises.  On a sample of ``SAMPLE`` vectors of a band rotations
are learned that bring the vectors close to the corners of a cube; the signs after
rotation are the 64 bits of a code.  A code is split into four substrings of 16 bits.

Index.  Each substring has a table of its own.  A bucket holds the rows that agree in the
leading bits of that substring, so many that a bucket has about ``BLOCK`` rows; fuller
buckets are parted.  Every row stands in all four tables.

Search.  First a query looks through its own buckets, whose best products bound what the
k-th best can be, thus the angle, thus the Hamming radius within which all but a few of
the nearest lie: as many differing bits as that angle lets expect, and ``margin``
deviations more, measured on the sample.  Two codes within radius r differ in at most
r // 4 bits of some substring, or r // 4 - 1 in those after the first r % 4 + 1; so all
buckets whose leading bits differ by no more are visited, and every code within the
radius is found.  Would that be more buckets than one table has, the first table is
visited whole, which finds the same.  What is found is ranked by its float vectors.
A query without k products yet takes the radius 64, which is all candidates.

Equal vectors are searched for, and found, once; of those with equal vectors the
k + 1 smallest ids can be among the nearest of any query, so no more are kept with them.
Buckets, queries of a bucket and results travel in blocks of bounded size.

Defined results
  NULL, zero, empty vectors, or with NULL or non-finite components   take no part; nor do
                            those whose squared length is beyond a double's range
  NULL id                   neither asked nor found
  repeated ids              rows of their own; a query leaves out only its own row
  equal scores              smaller id first
  vectors of other length   are no candidates of a query
  fewer than k candidates   all of them
  empty table               no rows
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.llm.shared import by_value, stored

K, BITS, TABLES = 20, 64, 4
WIDTH = BITS // TABLES
#: Vectors of a band that rotations are learned on; rounds of learning; rows and queries in a block.
SAMPLE, ROUNDS, BLOCK, QUERIES = 2048, 20, 4096, 1024
#: Parts of buckets that one task meets a block of queries with; queries of which a task holds the best.
PARTS, HELD = 64, 100_000
#: Share of the sample's near pairs that must lie within the radius of their angle.
CERTAIN = 0.97

PACKED = "cell int, t int, prefix int, part int, units binary, ids binary, vectors binary, codes binary"
FOUND = "q long, u long, id long, score double"


@dataclass
class Cell:
    """A length of vectors and a band of their norms."""

    dim: int
    longest: float
    rows: int
    rotations: list[np.ndarray]
    margin: float = 0.0

    @property
    def prefix_bits(self) -> int:
        return min(WIDTH, max(0, int(np.ceil(np.log2(max(self.rows, 1) / BLOCK)))))

    def codes(self, vectors: np.ndarray, as_queries: bool) -> np.ndarray:
        """Codes in one unsigned number each; the first substring is in the highest bits."""
        norms = np.sqrt((vectors ** 2).sum(axis=1))
        last = np.zeros(len(vectors)) if as_queries else np.sqrt(np.maximum(1 - (norms / self.longest) ** 2, 0))
        points = np.hstack([vectors / (norms[:, None] if as_queries else self.longest), last[:, None]])
        signs = np.hstack([points @ r > 0 for r in self.rotations])[:, :BITS]
        return np.packbits(signs, axis=1).view(">u8").astype(np.uint64).ravel()


def learn(points: np.ndarray, seed: int) -> np.ndarray:
    """A rotation of the points' main directions that brings them close to the corners of a cube."""
    _, _, main = np.linalg.svd(points, full_matrices=True)
    bits = min(BITS, points.shape[1])
    main = main[:bits].T
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    low = points @ main
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(np.where(low @ rotation > 0, 1.0, -1.0).T @ low)
        rotation = (left @ right).T
    return main @ rotation


def expected(cosine: np.ndarray, margin: float) -> np.ndarray:
    """Differing bits of codes at an angle, and so many deviations more."""
    p = np.arccos(np.clip(cosine, -1, 1)) / np.pi
    return BITS * p + margin * np.sqrt(BITS * p * (1 - p))


def make_cell(dim: int, longest: float, rows: int, sample: np.ndarray) -> Cell:
    lifted = np.hstack([sample / longest, np.sqrt(np.maximum(1 - (sample ** 2).sum(axis=1) / longest ** 2, 0))[:, None]])
    cell = Cell(dim, longest, rows, [learn(lifted, seed) for seed in range(-(-BITS // (dim + 1)))])
    asked = sample[:256]
    cosine = (asked @ sample.T) / np.sqrt((asked ** 2).sum(axis=1))[:, None] / longest
    differ = np.bitwise_count(cell.codes(asked, True)[:, None] ^ cell.codes(sample, False)).astype(float)
    near = cosine >= np.quantile(cosine, 0.9)
    p = np.clip(np.arccos(np.clip(cosine[near], -1, 1)) / np.pi, 1e-3, None)
    cell.margin = max(1.0, float(np.quantile((differ[near] - BITS * p) / np.sqrt(BITS * p * (1 - p).clip(1e-3)), CERTAIN)))
    return cell


def within(radius: np.ndarray) -> np.ndarray:
    """Bits that may differ in each table, of codes within a radius; -1 where the table need not be asked."""
    whole, rest = np.divmod(radius, TABLES)
    return np.where(np.arange(TABLES) <= rest[:, None], whole[:, None], whole[:, None] - 1)


def substrings(codes: np.ndarray) -> np.ndarray:
    """The substrings of each code, a column per table."""
    shifts = np.array([BITS - WIDTH * (t + 1) for t in range(TABLES)], np.uint64)
    return (codes[:, None] >> shifts & np.uint64(2 ** WIDTH - 1)).astype(np.int64)


def matrix(lists: pd.Series, dim: int) -> np.ndarray:
    return np.array(lists.tolist(), np.float64).reshape(len(lists), dim)


def _indexed(cells: dict[int, Cell]):
    """Rows with their code and the prefix of each table."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, group in batch.groupby("cell"):
                cell = cells[int(number)]
                codes = cell.codes(matrix(group["vector"], cell.dim), False)
                prefixes = substrings(codes) >> (WIDTH - cell.prefix_bits)
                yield group.assign(code=codes.view(np.int64), prefixes=list(prefixes.astype(np.int32)))
    return work


def _visits(cells: dict[int, Cell], home: bool):
    """The buckets that queries visit: their own, or all that their radius asks for.

    ``mode`` is -1 in the first case, otherwise the radius, plus 100 if the first table is visited whole.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, cell in cells.items():
                group = batch[batch["dim"] == cell.dim]
                if not home and len(group):
                    norms = np.sqrt((matrix(group["vector"], cell.dim) ** 2).sum(axis=1))
                    cosine = group["worst"].fillna(-np.inf).to_numpy() / (norms * cell.longest)
                    group, cosine = group[cosine <= 1 + 1e-9], cosine[cosine <= 1 + 1e-9]
                if not len(group):
                    continue
                codes = cell.codes(matrix(group["vector"], cell.dim), True)
                bits = cell.prefix_bits
                own = substrings(codes) >> (WIDTH - bits)
                every = np.arange(2 ** bits)
                if home:
                    modes, allowed = np.full(len(group), -1), np.zeros((len(group), TABLES), int)
                else:
                    modes = np.minimum(np.floor(expected(cosine, cell.margin)), BITS).astype(int)
                    modes[~np.isfinite(cosine)] = BITS
                    allowed = within(modes)
                step = max(1, 2 ** 20 // 2 ** bits)
                for start in range(0, len(group), step):
                    at = slice(start, start + step)
                    apart = np.bitwise_count(own[at, :, None] ^ every) <= allowed[at, :, None]
                    whole = (apart.sum(axis=(1, 2)) >= 2 ** bits) & (not home)
                    apart[whole, 0], apart[whole, 1:] = True, False
                    i, t, prefix = np.nonzero(apart)
                    yield pd.DataFrame({
                        "cell": int(number), "t": t, "prefix": prefix, "unit": group["unit"].to_numpy()[at][i],
                        "id": group["id"].to_numpy()[at][i], "mode": (modes[at] + 100 * whole)[i],
                        "code": codes.view(np.int64)[at][i], "vector": group["vector"].to_numpy()[at][i],
                        "worst": group["worst"].fillna(-np.inf).to_numpy()[at][i]})
    return work


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    out = group[["cell", "t", "prefix", "part"]].head(1)
    vectors = np.array(group["vector"].tolist(), np.float64)
    out = out.assign(units=[group["unit"].to_numpy(np.int64).tobytes()], ids=[group["id"].to_numpy(np.int64).tobytes()],
                     vectors=[vectors.tobytes()], codes=[group["code"].to_numpy(np.int64).tobytes()])
    if "mode" in group:
        out = out.assign(modes=[group["mode"].to_numpy(np.int64).tobytes()], worst=[group["worst"].to_numpy(np.float64).tobytes()])
    return out


def retrieved(t: int, bits: int, modes: np.ndarray, asked: np.ndarray, offered: np.ndarray) -> np.ndarray:
    """Which codes of a bucket of table ``t`` each query takes, none that an earlier table gives it too."""
    apart = asked[:, None] ^ offered
    part = [np.bitwise_count(apart >> np.uint64(BITS - WIDTH * (s + 1)) & np.uint64(2 ** WIDTH - 1)) for s in range(t + 1)]
    home, whole = modes < 0, modes >= 100
    radius = np.where(whole, modes - 100, modes)
    take = home[:, None] | (np.bitwise_count(apart) <= radius[:, None])
    allowed = within(np.maximum(radius, 0))
    for s in range(t):  # homes share the prefix, probes differ by no more than is allowed
        prefix = apart >> np.uint64(BITS - WIDTH * s - bits) & np.uint64(2 ** bits - 1) if bits else np.zeros_like(apart)
        earlier = np.where(home[:, None], prefix == 0, part[s] <= allowed[:, s, None])
        take &= ~earlier
    reach = np.where(home | whole, WIDTH, allowed[:, t])
    return take & (part[t] <= reach[:, None])


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products, the components added in their order, so that equal vectors score equally everywhere."""
    total = np.zeros(len(vectors))
    for x, column in zip(query, vectors.T):
        total += x * column
    return total


class Best:
    """The best found so far of every query of a task."""

    def __init__(self, k: int):
        self.k, self.found = k, {}

    def worst(self, queries: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The score below which nothing can be among a query's best."""
        own = [self.found[q][0][-1] if q in self.found and len(self.found[q][0]) == self.k else -np.inf for q in queries.tolist()]
        return np.maximum(known, own)

    def add(self, query: int, score: np.ndarray, ids: np.ndarray, units: np.ndarray) -> None:
        if query in self.found:
            old = self.found[query]
            score, ids, units = (np.concatenate([x, y]) for x, y in zip(old, (score, ids, units)))
        best = np.lexsort((units, ids, -score))[:self.k]
        self.found[query] = score[best], ids[best], units[best]

    def frame(self) -> pd.DataFrame:
        counts = [len(x[0]) for x in self.found.values()]
        score, ids, units = (np.concatenate(x) for x in zip(*self.found.values()))
        return pd.DataFrame({"q": np.repeat(np.fromiter(self.found, np.int64, len(counts)), counts), "u": units, "id": ids, "score": score})


def _search(cells: dict[int, Cell], k: int):
    """Meetings of a block of queries with a part of a bucket; a task returns the best of each query once."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(k)
        for batch in batches:
            for row in batch.itertuples():
                cell = cells[int(row.cell)]
                asked, units, ids = (np.frombuffer(x, np.int64) for x in (row.q_units, row.units, row.ids))
                queries = np.frombuffer(row.q_vectors, np.float64).reshape(len(asked), cell.dim)
                vectors = np.frombuffer(row.vectors, np.float64).reshape(len(units), cell.dim)
                modes, known = np.frombuffer(row.q_modes, np.int64), np.frombuffer(row.q_worst, np.float64)
                take = retrieved(int(row.t), cell.prefix_bits, modes, np.frombuffer(row.q_codes, np.uint64),
                                 np.frombuffer(row.codes, np.uint64))
                # Rounded products tell what may enter; those that do are computed again, term by term.
                slack = 1e-12 * cell.dim * np.sqrt((queries ** 2).sum(axis=1)) * cell.longest
                least = best.worst(asked, known) - slack
                if take.mean() > 0.05:
                    take &= queries @ vectors.T >= least[:, None]
                for i in np.flatnonzero(take.any(axis=1)):
                    at = np.flatnonzero(take[i])
                    rough = vectors[at] @ queries[i]
                    at, rough = at[rough >= least[i]], rough[rough >= least[i]]
                    if len(at) > k:
                        at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - slack[i]]
                    if len(at):
                        best.add(int(asked[i]), exact(queries[i], vectors[at]), ids[at], units[at])
            if len(best.found) > HELD:
                yield best.frame()
                best = Best(k)
        if best.found:
            yield best.frame()
    return work


def parted(rows: DataFrame, size: int) -> DataFrame:
    """Rows of a bucket dealt to parts of about ``size``; fuller buckets have more."""
    counts = rows.groupBy("cell", "t", "prefix").agg(F.ceil(F.count("*") / size).alias("parts"))
    return rows.join(counts, ["cell", "t", "prefix"]).withColumn(
        "part", F.pmod(F.xxhash64("unit"), F.col("parts")).cast("int")).drop("parts")


def search(vectors: DataFrame, is_query: str, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` of ``vec_id, embedding``; ``is_query`` is a condition on ``vec_id``."""
    spark = vectors.sparkSession
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    rows = stored(
        vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(
            "embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("vector"), F.monotonically_increasing_id().alias("row"))
        .where("vec_id IS NOT NULL").withColumn("norm", F.sqrt(square)).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
        .withColumns({"key": F.sha2(F.col("vector").cast("string"), 256), "asked": F.expr(is_query)}), "vectors", free=True)
    # Bands meet between powers of two, so that vectors of length one fall into one band.
    units = rows.groupBy("key").agg(F.min(F.struct("vec_id", "row", "vector", "norm")).alias("first"), F.max("asked").alias("asked"))
    units = stored(units.select(
        "key", F.col("first.row").alias("unit"), F.col("first.vec_id").alias("id"), F.col("first.vector").alias("vector"), F.col("first.norm").alias("norm"), "asked",
        F.size("first.vector").alias("dim"), F.floor(F.log2("first.norm") + 0.5).cast("int").alias("band")), "units", free=True)
    sizes = units.groupBy("dim", "band").agg(
        F.count("*").alias("n"), F.max("norm").alias("longest"), F.count_if("asked").alias("asked")).orderBy("dim", "band").collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], empty)
    by_digest = W.partitionBy("dim", "band").orderBy("key")
    drawn: dict[tuple, list] = {}
    for r in units.select("dim", "band", "vector", F.row_number().over(by_digest).alias("at")).where(F.col("at") <= SAMPLE).collect():
        drawn.setdefault((r["dim"], r["band"]), []).append((r["at"], r["vector"]))
    cells = {i: make_cell(s["dim"], s["longest"], s["n"], np.array([v for _, v in sorted(drawn[s["dim"], s["band"]])], np.float64))
             for i, s in enumerate(sizes)}
    number = F.create_map(*[F.lit(x) for i, s in enumerate(sizes) for x in (f"{s['dim']} {s['band']}", i)])

    coded = units.select("unit", "id", "vector", number[F.concat_ws(" ", "dim", "band")].alias("cell")).mapInPandas(
        _indexed(cells), "unit long, id long, vector array<double>, cell int, code long, prefixes array<int>")
    index = stored(
        parted(coded.select("unit", "id", "vector", "cell", "code", F.posexplode("prefixes").alias("t", "prefix")), BLOCK)
        .groupBy("cell", "t", "prefix", "part").applyInPandas(_pack, PACKED), "index", free=True)

    asked_of = {}
    for x in sizes:
        asked_of[x["dim"]] = asked_of.get(x["dim"], 0) + x["asked"]
    q_parts = F.create_map(*[F.lit(x) for i, c in cells.items() for x in (i, max(1, -(-asked_of[c.dim] // QUERIES)))])
    chunks = F.create_map(*[F.lit(x) for i, c in cells.items() for x in (i, max(1, -(-TABLES * (2 ** c.prefix_bits + c.rows // BLOCK) // PARTS)))])

    def visit(queries: DataFrame, home: bool) -> DataFrame:
        visits = queries.mapInPandas(
            _visits(cells, home), "cell int, t int, prefix int, unit long, id long, mode int, code long, vector array<double>, worst double")
        # A query is in the block of its number wherever it goes, so one task can meet it with many buckets.
        blocks = visits.withColumn("part", F.pmod(F.xxhash64("unit"), q_parts[F.col("cell")]).cast("int")).groupBy(
            "cell", "t", "prefix", "part").applyInPandas(_pack, PACKED + ", modes binary, worst binary")
        blocks = blocks.select("cell", "t", "prefix", F.col("part").alias("q_part"), *[F.col(c).alias(f"q_{c}") for c in (
            "units", "vectors", "codes", "modes", "worst")])
        chunk = F.pmod(F.xxhash64("t", "prefix", "part"), chunks[F.col("cell")])
        pairs = blocks.join(index, ["cell", "t", "prefix"]).repartition("cell", "q_part", chunk)
        best = W.partitionBy("q").orderBy(F.desc("score"), "id", "u")
        return stored(pairs.mapInPandas(_search(cells, k + 1), FOUND).withColumn("at", F.row_number().over(best))
                      .where(F.col("at") <= k + 1).drop("at"), "found", free=True)

    asked = units.where("asked").select("unit", "id", "vector", "dim", F.lit(None).cast("double").alias("worst"))
    seen = visit(asked, True)
    worst = seen.groupBy("q").agg(F.min("score").alias("worst"), F.count("*").alias("n")).select(
        F.col("q").alias("unit"), F.when(F.col("n") > k, F.col("worst")).alias("worst"))
    found = seen.unionAll(visit(asked.drop("worst").join(worst, "unit", "left"), False)).groupBy("q", "u").agg(F.max("score").alias("score"))

    # Back from distinct vectors to rows.
    same = W.partitionBy("key").orderBy("vec_id", "row")
    members = rows.select("key", "vec_id", "row", F.row_number().over(same).alias("at")).where(F.col("at") <= k + 1).join(
        units.select("key", F.col("unit").alias("u")), "key").select("u", "vec_id", "row")
    ahead = W.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row")
    listed = found.join(members, "u").withColumn("at", F.row_number().over(ahead)).where(F.col("at") <= k + 1)
    queries = rows.where("asked").join(units.select("key", F.col("unit").alias("q")), "key").select(
        "q", F.col("vec_id").alias("query_id"), F.col("row").alias("own"))
    kept = queries.join(listed, "q").where("row <> own")
    order = W.partitionBy("own").orderBy("at")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


by_value(__name__)
