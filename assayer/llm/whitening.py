"""Whitening of embeddings by shifted CholeskyQR.

Components are turned into integers x.  The fit list is each distinct x vector once;
with n vectors and sums S per dimension, rows are centred exactly as (n*x - S) / n.
The matrix A of centred rows is made orthogonal without ever standing in one place:
a pass over the rows sums their Gram matrix, its Cholesky factor R is solved against
every row in the next pass, and so on until the Gram matrix is close to the identity.
The first factor is taken of the Gram matrix plus a small multiple of the identity, so
that it exists however badly conditioned A is; so is a later one that does not exist
otherwise.  The product of the factors is the R of A = QR, and its singular value
decomposition gives A's: right vectors are the components, squared values over n the
eigenvalues.  Small eigenvalues keep their digits, which the eigenvectors of A'A lose.

A task returns one matrix, in rows that are summed by Spark per dimension; the driver
holds matrices of dimension x dimension only, and no vectors.

Defined results
  NULL vector or one with NULL or non-finite entries   dropped
  NULL id; repeated ids     rows like others; equal vectors count once in the fit
  vectors of other length   are whitened among themselves; the driver holds one matrix for each length
  entries beyond 2**52      stop there, before they are counted from 1000000
  deviations beyond 64 bits NULL
  constant or dependent dimensions   components without variance (below 1e-12 of the largest deviation) are left out
  one distinct vector, empty vectors, empty table   no rows
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.shared import by_value, stored

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Largest entry of a Gram matrix minus the identity at which its own factor is the last; most passes.
NEAR, PASSES = 1e-6, 12
#: Entries are split at so many bits to be summed exactly.
LOW_BITS = 20


@dataclass
class Fit:
    """What is known of the vectors of one length."""

    n: int
    sums: list[int]
    factors: list[np.ndarray] = field(default_factory=list)
    composed: np.ndarray | None = None
    trace: float = 0.0
    values: np.ndarray | None = None
    components: np.ndarray | None = None
    identity_error: float | None = None

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """``n*x - S``, exact."""
        reach = max(self.n * int(np.abs(x).max(initial=0)), max(map(abs, self.sums), default=0))
        kind = np.int64 if reach < 2 ** 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.numerators(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of squared numerators."""
        rows = self.numerators(x)
        if rows.dtype == object or float(np.abs(rows).max(initial=0)) ** 2 * max(rows.shape[1], 1) >= 2 ** 62:
            sums = (rows.astype(object) ** 2).sum(axis=1)
            return [int(s) if s < 2 ** 63 else None for s in sums]
        return (rows ** 2).sum(axis=1).tolist()

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values)[:, None]).T


def integers(vector: Column) -> Column:
    """``floor(64 * c) + 1000000`` of every entry; NULL for a vector that is dropped."""
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    edge = F.lit(2.0 ** 52)
    return F.when(usable, F.transform(vector, lambda c: F.floor(
        F.least(F.greatest(c.cast("double") * SCALE, -edge), edge)) + OFFSET))


def solve(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of an upper triangle, column by column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of a batch by the length of their ``x``, and these as a matrix."""
    lengths = pc.list_value_length(batch.column("x"))
    for dim in pc.unique(lengths).to_pylist():
        part = batch.filter(pc.equal(lengths, dim))
        yield dim, part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)


def _gram(fits: dict[int, Fit], made: Callable[[Fit, np.ndarray], np.ndarray]):
    """Per task and length the rows of the Gram matrix of what is made of the vectors, below them their sums."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in by_length(batch):
                if dim in fits:
                    rows = made(fits[dim], x)
                    part = np.vstack([rows.T @ rows, rows.sum(axis=0)])
                    sums[dim] = sums[dim] + part if dim in sums else part
        for dim, matrix in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"dim": [dim] * len(matrix), "i": list(range(len(matrix))), "sums": [r.tobytes() for r in matrix]},
                pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("sums", pa.binary())]))
    return work


def _added(group: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(s, np.float64) for s in group["sums"]], axis=0)
    return group.head(1).assign(sums=[total.tobytes()])


def gram(vectors: DataFrame, fits: dict[int, Fit], made: Callable[[Fit, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """For each length the Gram matrix of all rows, below it their sums."""
    kind = "dim int, i int, sums binary"
    rows = vectors.mapInArrow(_gram(fits, made), kind).groupBy("dim", "i").applyInPandas(_added, kind).collect()
    found: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["dim"], r["i"])):
        found.setdefault(r["dim"], []).append(np.frombuffer(r["sums"], np.float64))
    return {dim: np.array(matrix) for dim, matrix in found.items()}


def solved(fit: Fit, x: np.ndarray) -> np.ndarray:
    rows = fit.centred(x)
    for factor in fit.factors:
        rows = solve(rows, factor)
    return rows


def factor_of(square: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor; columns of zeros stay what they are."""
    dim = len(square)
    live = np.flatnonzero(np.diag(square) > 0)
    out, part = np.eye(dim), square[np.ix_(live, live)]
    if len(live) == 0:
        return out
    shift = 11 * (n * dim + dim * (dim + 1)) * np.finfo(float).eps / 2 * np.trace(part)
    for extra in ([] if shifted else [0.0]) + [shift * 8 ** i for i in range(12)]:
        try:
            out[np.ix_(live, live)] = np.linalg.cholesky(part + extra * np.eye(len(live))).T
            return out
        except np.linalg.LinAlgError:
            continue
    raise ArithmeticError("no Cholesky factor")


def advance(fit: Fit, square: np.ndarray) -> bool:
    """Take up the Gram matrix of the rows solved so far; whether it was the last."""
    dim = len(square)
    if not fit.factors:
        fit.trace, fit.composed = float(np.trace(square)) / fit.n, np.eye(dim)
    live = np.diag(square) > 0
    off = np.abs(square - np.diag(live.astype(float))).max(initial=0)
    factor = factor_of(square, fit.n, shifted=not fit.factors)
    fit.composed = factor @ fit.composed
    fit.factors.append(factor)
    if off > NEAR and len(fit.factors) < PASSES:
        return False
    fit.composed[~live] = 0.0  # nothing lies in these columns of Q
    return True


def decompose(fit: Fit, most: int) -> None:
    _, singular, right = np.linalg.svd(fit.composed)
    kept = singular > 64 * len(singular) * np.finfo(float).eps * max(singular.max(initial=0), 1e-300)
    fit.values, fit.components = (singular[kept] ** 2 / fit.n)[:most], right[kept][:most]


def fitted(vectors: DataFrame, most: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each length of ``x``, which ``vectors`` hold once each."""
    high, low = F.shiftright("v", LOW_BITS), F.col("v").bitwiseAND(F.lit(2 ** LOW_BITS - 1))
    sums = vectors.select(F.size("x").alias("dim"), F.posexplode("x").alias("i", "v")).groupBy("dim", "i").agg(
        F.count("*").alias("n"), F.sum(high).alias("high"), F.sum(low).alias("low")).collect()
    fits: dict[int, Fit] = {}
    for r in sorted(sums, key=lambda r: (r["dim"], r["i"])):
        fits.setdefault(r["dim"], Fit(r["n"], [])).sums.append((r["high"] << LOW_BITS) + r["low"])
    open_ = dict(fits)
    while open_:
        squares = gram(vectors, open_, solved)
        open_ = {dim: fit for dim, fit in open_.items() if not advance(fit, squares[dim][:dim])}
    for fit in fits.values():
        decompose(fit, most)
    fits = {dim: fit for dim, fit in fits.items() if len(fit.values)}
    if fits:
        for dim, matrix in gram(vectors, fits, Fit.whitened).items():
            fit, mean = fits[dim], matrix[-1] / fits[dim].n
            off = matrix[:-1] / fit.n - np.outer(mean, mean) - np.eye(len(mean))
            fit.identity_error = float(np.abs(off).max())
    for fit in fits.values():
        fit.factors, fit.composed = [], None
    return fits


def _projected(fits: dict[int, Fit]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, x in by_length(batch):
                if dim not in fits:
                    continue
                fit = fits[dim]
                k, rows = len(fit.values), part.num_rows
                again = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, fit.n, np.int64)), pa.array(fit.deviations(x), pa.int64()).take(again),
                    pa.array(fit.whitened(x).ravel()), pa.array(np.tile(fit.values / fit.trace, rows)),
                    pa.array(np.full(rows * k, fit.identity_error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return work


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """A row per row of ``vec_id, embedding`` and component, of which there are ``most`` at most."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("x")).where("x IS NOT NULL")
    fits = fitted(stored(rows.select("x").distinct(), "fit", free=True), most)
    return rows.mapInArrow(_projected(fits), "vec_id long, component int, n long, deviation long, whitened double, "
                           "explained double, identity_error double")


by_value(__name__)
