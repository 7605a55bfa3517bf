"""Whitening of embeddings by matrix-free block Lanczos.

The covariance matrix is never formed. A pass over the vectors multiplies it with a
block of directions: every task centres its vectors and returns its share of
X'(XQ). The driver keeps the basis, orthogonalises each new block twice against all
of it, replaces directions that vanish by fresh random ones, and stops when the
residuals of the wanted pairs are at rounding level or the basis spans the space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged
from ledgerloom.llm.vectors import finite, matrix, scaled, totals

RESULT = "vec_id {id}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
#: Deviations are summed from halves of n * x - S of 25 bits each.
HALF = 25


@dataclass(frozen=True)
class Whitening:
    components: int = 8
    block: int = 16  # directions multiplied in one pass, at least ``components`` of them
    tolerance: float = 1e-13  # of residuals, against the largest eigenvalue
    seed: int = 12


def grown(basis: np.ndarray, block: np.ndarray, least: float, draw: Callable[[], np.ndarray]) -> np.ndarray:
    """Orthonormal directions for ``basis``: the columns of ``block``, each cleared of all that went before, twice.

    A column of which no more than ``least`` is left is a breakdown: a random direction
    takes its place. No more come than the space has room for.
    """
    new = basis
    for column in block.T:
        if new.shape[1] == new.shape[0]:
            break
        for _ in range(2):
            column = column - new @ (new.T @ column)
        while (norm := np.linalg.norm(column)) <= least:
            column, least = draw(), 1e-6
            for _ in range(2):
                column = column - new @ (new.T @ column)
        column = column / norm
        column -= new @ (new.T @ column)
        new = np.column_stack([new, column / np.linalg.norm(column)])
    return new[:, basis.shape[1] :]


def lanczos(times: Callable[[np.ndarray], np.ndarray], dim: int, settings: Whitening = Whitening()) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues, unit eigenvectors as columns, passes) of the ``components`` largest of a symmetric matrix.

    ``times`` multiplies the matrix with a block of columns. Signs are such that a
    vector's largest entry is positive.
    """
    rng = np.random.default_rng(settings.seed)
    draw = lambda: rng.standard_normal(dim)
    k, width = min(settings.components, dim), min(max(settings.block, settings.components), dim)
    basis, image, passes = np.empty((dim, 0)), np.empty((dim, 0)), 0
    fresh = grown(basis, rng.standard_normal((dim, width)), 0.0, draw)
    while True:
        basis, image, passes = np.column_stack([basis, fresh]), np.column_stack([image, times(fresh)]), passes + 1
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        left = np.linalg.norm(image @ turn - basis @ turn * values, axis=0)
        if basis.shape[1] == dim or left.max() <= settings.tolerance * max(values[0], 0.0):
            break
        fresh = grown(basis, image[:, -fresh.shape[1] :], 1e-10 * max(values[0], 0.0), draw)
    vectors = basis @ turn
    vectors /= np.linalg.norm(vectors, axis=0)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return values, vectors * np.where(signs == 0, 1, signs), passes


def whiten(vectors: DataFrame, scale: float = 1024.0, shift: int = 100_000, id_col: str = "vec_id", vec_col: str = "embedding", settings: Whitening = Whitening()) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries become x = floor(scale * c) + shift. Rows whose vector is null or holds null
    or non-finite entries are left out and counted nowhere; all others count, repeated
    ones each for itself, and a null id stays null. Vectors shorter than the longest are
    filled up with entries of 0 (x = shift). ``deviation`` is exact: the sum of (n * x - S)^2.
    Components whose eigenvalue is at rounding level against the total variance can't be
    scaled to unit variance and are left out, so fewer than ``components`` come where the
    vectors span fewer directions, and none for an empty table, a single vector or equal
    vectors. Equal eigenvalues give some orthonormal pair of their directions. Other
    columns are not read. n times the span of all x must stay under 2^50, else ArithmeticError
    (and x within a long, else Spark's own).
    The driver holds a basis of ``dim`` x ``dim`` numbers at most.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    spark = vectors.sparkSession
    vector = F.col(vec_col).cast("array<double>")
    rows = staged(vectors.where(finite(vector)).select(F.col(id_col).alias("vec_id"), scaled(vector, scale, shift).alias("x")), "whitening-vectors")
    n, dim, low, high = rows.agg(F.count("*"), F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if not n or not dim:
        return spark.createDataFrame([], RESULT.format(id=kind))
    low, high = min(low, shift), max(high, shift)
    if n * (high - low) >= 1 << 2 * HALF or n * max(-low, high) >= 2**62:
        raise ArithmeticError("n times the span of x is 2^50 or more")
    xs = lambda batch: matrix(batch.column(0), dim, shift)
    sums = totals(rows.select("x"), lambda b: xs(b).sum(axis=0), (dim,), int)
    centred = lambda x: (n * x - sums) / n  # noqa: E731  whole numbers until the one division

    def times(block: np.ndarray) -> np.ndarray:
        def share(batch: pa.RecordBatch) -> np.ndarray:
            c = centred(xs(batch))
            return c.T @ (c @ block)

        return totals(rows.select("x"), share, block.shape) / n

    values, directions, _ = lanczos(times, dim, settings)
    # The trace of the covariance matrix is what the deviations add up to, over n^3.
    trace = totals(rows.select("x"), lambda b: np.square(centred(xs(b))).sum(keepdims=True)[0], (1,))[0] / n
    sound = values > 1e-12 * trace
    values, directions = values[sound], directions[:, sound]
    if not len(values):
        return spark.createDataFrame([], RESULT.format(id=kind))
    root = np.sqrt(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dim, shift)
            y = n * x - sums
            high, low = y >> HALF, y & ((1 << HALF) - 1)
            squares = [(high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1)]
            z = (y / n) @ directions / root
            z = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, squares), z], names=["vec_id", "hh", "hl", "ll", "z"])

    found = rows.mapInArrow(project, f"vec_id {kind}, hh long, hl long, ll long, z array<double>")
    power = lambda c, bits: F.col(c).cast("decimal(19,0)") * F.lit(1 << bits).cast("decimal(17,0)")
    exact = (power("hh", 2 * HALF) + power("hl", HALF + 1) + F.col("ll")).cast("decimal(38,0)")
    found = staged(found.select("vec_id", exact.alias("deviation"), "z"), "whitening-projected")
    out, k = found.select("z"), len(values)
    mean = totals(out, lambda b: matrix_of_doubles(b.column(0), k).sum(axis=0), (k,)) / n
    spread = lambda b: (z := matrix_of_doubles(b.column(0), k) - mean).T @ z
    error = float(np.abs(totals(out, spread, (k, k)) / n - np.eye(k)).max())
    shares: Column = F.array(*[F.lit(float(v) / trace) for v in values])
    return found.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )


def matrix_of_doubles(column: pa.Array, k: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, k)
