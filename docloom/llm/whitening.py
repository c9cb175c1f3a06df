"""Operator 12: embedding whitening with an exact scatter by residue numbers.

1. Quantised rows. Each entry c becomes x = floor(1024 * c) + 100000, and each row
   gets one more entry 1, so that the scatter of the rows also holds their sums
   and their number.
2. Residue scatter. For each of several primes below 2 ** ``PRIME_BITS`` a task
   adds up the products of its rows' residues by matrix products of doubles. These
   are exact: ``GEMM_ROWS`` products of two residues stay below 2 ** 53, and are
   reduced before the next ones. A task gives one matrix for each prime, however
   many rows it has read; Spark adds the matrices up.
3. Reconstruction. The sums' residues, a matrix for each prime, are the only
   numbers that reach the driver. There are as many primes as the largest possible
   sum needs, so the Chinese remainder theorem gives the scatter in whole numbers,
   and the covariance is rounded once, at its end.
4. Eigenvectors of the covariance in double precision; each row is projected in a
   last pass, from its exact differences from the mean.
5. ``identity_error`` is measured: the covariance of the whitened rows themselves.

Defined results: rows whose vector is null or holds a null or a non-finite entry
are left out; a null id is returned as null, repeated ids and rows count and are
returned each. Shorter vectors count as padded with zeros (x = 100000), empty ones
too. Entries beyond 2 ** ``ENTRY_BITS`` are clipped to it. ``deviation`` is exact
below 2 ** 63 and clipped to 2 ** 63 - 1 beyond. A component whose eigenvalue is
0, or not larger than ``FLAT`` of the largest, has the value 0.0 for all rows and no part in
``identity_error``; ``explained`` is 0 where the trace is. Vectors of fewer than
``components`` entries give as many components as they have. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .topk import matrix_of, widen

SCALE, SHIFT = 1024.0, 100_000
#: Primes lie below 2 ** 20, so 2 ** 12 products of residues add up below 2 ** 52.
PRIME_BITS, GEMM_ROWS = 20, 1 << 12
#: Entries are whole doubles and exact up to here.
ENTRY_BITS = 52
#: Share of the largest eigenvalue up to which one is no spread but rounding.
FLAT = 1e-13


def quantised(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * c) + 100000 as longs, clipped."""
    limit = float(1 << ENTRY_BITS)
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors.astype(np.float64) * SCALE)
    return np.clip(scaled + SHIFT, -limit, limit).astype(np.int64)


def primes_below(bits: int) -> Iterator[int]:
    """Primes from 2 ** bits downwards."""
    for n in range((1 << bits) - 1, 1, -1):
        if n == 2 or n % 2 and all(n % d for d in range(3, int(n**0.5) + 1, 2)):
            yield n


def enough_primes(bound: int) -> list[int]:
    """Primes whose product tells all whole numbers from -bound to bound apart."""
    found, product = [], 1
    for p in primes_below(PRIME_BITS):
        if product > 2 * bound:
            break
        found.append(p)
        product *= p
    return found


def residue_scatter(rows: np.ndarray, primes: list[int], held: np.ndarray | None = None) -> np.ndarray:
    """Sums of products (prime, i, j) of the rows' residues, modulo each prime, added to ``held``."""
    width = rows.shape[1]
    held = np.zeros((len(primes), width, width), np.int64) if held is None else held
    for at in range(0, len(rows), GEMM_ROWS):
        part = rows[at : at + GEMM_ROWS]
        for k, p in enumerate(primes):
            r = (part % p).astype(np.float64)
            held[k] = (held[k] + (r.T @ r).astype(np.int64)) % p
    return held


def reconstruct(residues: np.ndarray, primes: list[int]) -> np.ndarray:
    """The whole numbers, as Python's, of least size that have these residues (prime, ...)."""
    product = 1
    for p in primes:
        product *= p
    total = np.zeros(residues.shape[1:], object)
    for r, p in zip(residues, primes, strict=True):
        rest = product // p
        total = (total + r.astype(object) * (rest * pow(rest, -1, p))) % product
    return np.where(total > product // 2, total - product, total)


class Fit:
    """Number, sums and components of the fit list."""

    def __init__(self, scatter: np.ndarray, components: int):
        """``scatter``: exact sums of products of the rows and a last entry 1."""
        self.n = int(scatter[-1, -1])
        self.sums = [int(s) for s in scatter[:-1, -1]]
        d = len(self.sums)
        # n * scatter - sums * sums is exact; one division rounds it
        self.covariance = np.array([[(self.n * int(scatter[i, j]) - self.sums[i] * self.sums[j]) / self.n**2 for j in range(d)] for i in range(d)]).reshape(d, d)
        values, vectors = np.linalg.eigh(self.covariance)
        order = np.argsort(-values, kind="stable")[:components]
        self.values, self.vectors = np.maximum(values[order], 0.0), vectors[:, order]
        trace = float(np.trace(self.covariance))
        self.explained = self.values / trace if trace > 0 else np.zeros(len(order))
        flat = self.values <= FLAT * max(self.values.max(initial=0.0), 0.0)
        self.scales = np.where(flat, 0.0, 1.0 / np.sqrt(np.where(flat, 1.0, self.values)))
        self.spread = np.flatnonzero(~flat).tolist()

    def apply(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Deviations and whitened components of quantised rows."""
        apart = _exact_differences(rows, self.n, self.sums)
        near = apart.astype(np.float64)
        return _square_sums(apart, near), (near / self.n) @ self.vectors * self.scales


def _exact_differences(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S: longs where they fit, else Python's whole numbers."""
    most = n * int(np.abs(rows).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 2**62:
        return rows * n - np.array(sums, np.int64)
    return rows.astype(object) * n - np.array(sums, object)


def _square_sums(apart: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Sums of squares, exact below 2 ** 63 and clipped beyond.

    Longs wrap around modulo 2 ** 64, so where the sum of doubles shows that the true one is a long, the wrapped one is it.
    """
    rough = (near**2).sum(axis=1)
    if apart.dtype != object:
        out = (apart.view(np.uint64) ** 2).sum(axis=1, dtype=np.uint64).view(np.int64)
        close = np.flatnonzero((rough > 2.0**62) & (rough < 2.0**64))
    else:
        out, close = np.zeros(len(apart), np.int64), np.flatnonzero(rough < 2.0**64)
    out[rough >= 2.0**64] = 2**63 - 1
    for i in close:
        out[i] = min(2**63 - 1, sum(int(v) ** 2 for v in apart[i]))
    return out


def fit_whitening(rows: DataFrame, components: int = 8) -> Fit | None:
    """The fit of all ``rows`` (embedding); None if there are none."""
    e = F.col("embedding")
    # an entry's size as a double, with room for its rounding
    largest = F.aggregate(e, F.lit(0.0), lambda most, c: F.greatest(most, F.abs(c.cast("double"))))
    n, width, most = rows.agg(F.count(F.lit(1)), F.max(F.size(e)), F.max(largest)).first()
    if not n:
        return None
    entry = int(min(float(1 << ENTRY_BITS), most * SCALE + SHIFT + 2))
    primes = enough_primes(n * entry**2)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            x = quantised(widen(matrix_of(batch.column(0)), width))
            held = residue_scatter(np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1), primes, held)
        if held is not None:
            for k in range(len(primes)):
                for i in range(width + 1):  # the matrix is symmetric
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int32()), pa.array([i], pa.int32()), pa.array([held[k, i, i:].tolist()], pa.list_(pa.int64()))],
                        names=["prime", "i", "sums"],
                    )

    parts = rows.select("embedding").mapInArrow(scatter, "prime int, i int, sums array<long>")
    each = parts.select("prime", "i", F.posexplode("sums").alias("off", "s"))
    # residues are below 2 ** 20: the sums of 2 ** 43 tasks are longs
    total = each.groupBy("prime", "i", "off").agg(F.sum("s").alias("s"))
    table = total.toArrow()  # a row for each prime and entry of the scatter, whatever the number of rows
    prime, i, off, s = (table.column(c).to_numpy() for c in ("prime", "i", "off", "s"))
    residues = np.zeros((len(primes), width + 1, width + 1), np.int64)
    residues[prime, i, i + off] = residues[prime, i + off, i] = s % np.array(primes, np.int64)[prime]
    return Fit(reconstruct(residues, primes), min(components, width))


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("embedding"))
    whole = ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = rows.filter(F.col("embedding").isNotNull() & whole)
    fit = fit_whitening(rows, components)
    kind = dict(rows.dtypes)["vec_id"]
    if fit is None or not fit.explained.size:
        schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema)
    width = len(fit.sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GEMM_ROWS):
                part = batch.slice(at, GEMM_ROWS)
                deviation, white = fit.apply(quantised(widen(matrix_of(part.column(1)), width)))
                columns = [part.column(0), pa.array(deviation), *[pa.array(c) for c in white.T]]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "deviation", *names])

    names = [f"w{k}" for k in range(len(fit.explained))]
    schema = f"vec_id {kind}, deviation long, " + ", ".join(f"{c} double" for c in names)
    white = cut(rows.mapInArrow(project, schema), "white")
    pairs = [(a, b) for a in fit.spread for b in fit.spread if a <= b]
    # the covariance of the whitened rows, centred, each entry against the identity's
    off = [F.abs(F.covar_pop(names[a], names[b]) - F.lit(float(a == b))) for a, b in pairs]
    error = white.agg(F.greatest(*off, F.lit(0.0)).alias("e")).first().e if len(off) > 1 else (white.agg(off[0].alias("e")).first().e if off else 0.0)
    each = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.col(c).alias("whitened"), F.lit(float(fit.explained[k])).alias("explained")) for k, c in enumerate(names)])
    return white.select("vec_id", "deviation", F.explode(each).alias("c")).select(
        "vec_id", "c.component", F.lit(fit.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error")
    )
