"""Embedding whitening (operator 11): leading components by Chebyshev-filtered subspace iteration over Spark passes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.vectors import Block, read_blocks, vector_blocks

SCALE = 64
COMPONENTS, GUARD, DEGREE = 32, 16, 12
#: Residual of a certified pair, and the looser one at which it may stop gaining, in units of the largest eigenvalue.
CERTIFIED, SETTLED = 1e-13, 1e-10
#: Largest ratio between the amplifications of two wanted directions in one filter: keeps the block well conditioned.
SPREAD = 1e10
#: Components below this share of the largest eigenvalue are rounding: they have no variance to divide by.
NO_VARIANCE = 1e-13
ROUNDS = 100

MATRIX = "place int, value double"
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

Product = Callable[[np.ndarray], np.ndarray]


def _sum_matrices(parts: DataFrame, rows: int, columns: int) -> np.ndarray:
    """Sum of the matrices that tasks give as (place, value): added up by Spark, one number per place comes here."""
    total = np.zeros(rows * columns)
    for place, value in parts.groupBy("place").agg(F.sum("value")).collect():
        total[place] = value
    return total.reshape(rows, columns)


def _matrix_batch(matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(matrix.size), pa.int32()), pa.array(matrix.ravel(), pa.float64())], ["place", "value"])


def _moments(blocks: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Exact number of vectors and sums per dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for block in read_blocks(batches):
            n += len(block.matrix)
            wide = block.matrix if block.matrix.dtype.itemsize < 8 else block.matrix.astype(object)
            sums = [a + int(b) for a, b in zip(sums, wide.sum(axis=0, dtype=None if wide.dtype == object else np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([str(s) for s in sums])], ["row", "n", "total"])

    parts = blocks.mapInArrow(add, "row int, n long, total string").select("row", "n", F.col("total").cast("decimal(38,0)").alias("total"))
    found = {r.row: r for r in parts.groupBy("row").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    return (found[0].n, [int(found[j].total) for j in range(dim)]) if found else (0, [0] * dim)


def _centred_product(blocks: DataFrame, mean: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """V q for the covariance V of the vectors of ``blocks``: one distributed pass, centred before multiplying."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(q)
        for block in read_blocks(batches):
            centred = block.matrix - mean
            total += centred.T @ (centred @ q)
        yield _matrix_batch(total)

    return _sum_matrices(blocks.mapInArrow(multiply, MATRIX), *q.shape) / n


class LowEnd:
    """A Lanczos run that rides on the passes of the block: an estimate from below of the smallest eigenvalue."""

    def __init__(self, dim: int, rng: np.random.Generator) -> None:
        start = rng.standard_normal(dim)
        self.basis, self.alpha, self.beta = [start / np.linalg.norm(start)], [], []

    @property
    def vector(self) -> np.ndarray:
        return self.basis[-1]

    def take(self, product: np.ndarray) -> None:
        if len(self.alpha) == len(self.basis):  # the run has ended
            return
        self.alpha.append(float(self.vector @ product))
        rest = product.copy()
        for _ in range(2):
            for v in self.basis:
                rest -= (v @ rest) * v
        norm = float(np.linalg.norm(rest))
        self.beta.append(norm)
        if norm > 1e-8 * max(abs(a) for a in self.alpha) and len(self.basis) < len(rest):
            self.basis.append(rest / norm)

    def bound(self) -> float:
        if len(self.alpha) < 3:
            return 0.0
        t = np.diag(self.alpha) + np.diag(self.beta[:-1], 1) + np.diag(self.beta[:-1], -1)
        values, vectors = np.linalg.eigh(t)
        return max(0.0, float(values[0] - self.beta[-1] * abs(vectors[-1, 0])))


def leading_components(product: Product, dim: int, wanted: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns) of a covariance known by its products only, by falling eigenvalue.

    A block of ``wanted + guard`` directions is filtered by a Chebyshev polynomial of the
    covariance that is small between the low end of the spectrum and the smallest Ritz value
    of the block and grows fast above, made orthonormal (QR) and turned to Ritz pairs
    (Rayleigh-Ritz). It ends when every wanted pair is certified: the norm of V u - e u bounds
    the error of e, and stands at rounding level.
    """
    wanted = min(wanted, dim)
    width = min(dim, wanted + guard)
    rng = np.random.default_rng(11)
    low = LowEnd(dim, rng)
    block = np.linalg.qr(rng.standard_normal((dim, width)))[0]

    def times(matrix: np.ndarray) -> np.ndarray:
        out = product(np.column_stack([matrix, low.vector]))
        low.take(out[:, -1])
        return out[:, :-1]

    last = math.inf
    for _ in range(ROUNDS):
        image = times(block)
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        top = float(values[0])
        residual = float(np.linalg.norm(image - block * values, axis=0)[:wanted].max())
        if residual <= CERTIFIED * top or top <= 0 or (residual <= SETTLED * top and residual > last / 2):
            return np.maximum(values[:wanted], 0.0), block[:, :wanted]
        last = residual
        high = max(float(values[-1]), 1e-15 * top)
        bottom = min(low.bound(), 0.95 * high)
        half, centre = (high - bottom) / 2, (high + bottom) / 2
        reach = (top - centre) / half
        growth = math.log(reach + math.sqrt(max(reach * reach - 1, 1e-12)))
        steps = max(1, min(degree, int(math.log(SPREAD) / growth)))
        # Scaled so that the direction of the largest eigenvalue keeps its length.
        first = sigma = half / max(top - centre, 1e-300)
        before, now = block, (image - centre * block) * (sigma / half)
        for _ in range(steps - 1):
            after = 1 / (2 / first - sigma)
            before, now = now, (times(now) - centre * now) * (2 * after / half) - before * (sigma * after)
            sigma = after
        lengths = np.linalg.norm(now, axis=0)
        block = np.linalg.qr(now / np.where(lengths > 0, lengths, 1.0))[0]
    raise RuntimeError(f"components not certified after {ROUNDS} rounds, residual {residual / top:.2e}")


def _identity_error(blocks: DataFrame, mean: np.ndarray, n: int, turn: np.ndarray) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from one more pass over the rows."""
    k = turn.shape[1]
    if not k:
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for block in read_blocks(batches):
            white = (block.matrix - mean) @ turn
            total[:k] += white.T @ white
            total[k] += white.sum(axis=0)
        yield _matrix_batch(total)

    total = _sum_matrices(blocks.mapInArrow(add, MATRIX), k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def _deviations(block: Block, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2 per vector, exact; null where it does not fit a long."""
    rough = ((block.matrix.astype(float) * n - np.array(sums, float)) ** 2).sum(axis=1)
    if rough.max(initial=0.0) < 2.0**62:
        apart = block.matrix.astype(np.int64) * n - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    exact = (sum((n * int(x) - s) ** 2 for x, s in zip(row, sums)) for row in block.matrix)
    return [e if e < 1 << 63 else None for e in exact]


def whiten(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per kept vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error).

    Entries c become whole numbers floor(64 c); the shift by 1,000,000 of the contract changes
    neither covariance nor deviations. The vectors are written once as packed blocks, and every
    pass reads those: tasks hold one block and a matrix of dimensions x (components + guard)
    numbers, which is all that is summed, sent out or brought back, however many rows there are.

    Vectors that are null or hold null or non-finite entries are dropped, and so are those
    whose length is not the most frequent one (the longer of two equally frequent ones), since
    they have no place in one covariance. Null ids and repeated rows are kept, each row counts.
    With fewer dimensions than components there are as many components as dimensions. A
    component without variance has null ``whitened``; ``identity_error`` covers the others and
    is null if there are none. A ``deviation`` beyond a long is null. Entries beyond 2^53 / 64
    count as that. An empty table gives an empty result; other columns are ignored.
    """
    spark = table.sparkSession
    blocks, dim = vector_blocks(table, SCALE, id_col, vec_col)
    n, sums = _moments(blocks, dim) if dim else (0, [])
    if not n:
        return spark.createDataFrame([], RESULT)
    mean = np.array([s / n for s in sums])
    values, vectors = leading_components(lambda q: _centred_product(blocks, mean, n, q), dim, components)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _matrix_batch(np.array([[sum(float(((b.matrix - mean) ** 2).sum()) for b in read_blocks(batches)) / n]]))

    trace = float(_sum_matrices(blocks.mapInArrow(squares, MATRIX), 1, 1)[0, 0])
    varied = values > NO_VARIANCE * max(values[0], 1e-300)
    turn = vectors[:, varied] / np.sqrt(values[varied])
    error = _identity_error(blocks, mean, n, turn)
    share = values / trace if trace > 0 else np.zeros_like(values)
    k = len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in read_blocks(batches):
            rows = len(block.matrix)
            white = np.full((rows, k), np.nan)
            white[:, varied] = (block.matrix - mean) @ turn
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    block.ids.take(each),
                    pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    pa.array(np.full(rows * k, n), pa.int64()),
                    pa.array(_deviations(block, n, sums), pa.int64()).take(each),
                    pa.array(white.ravel(), pa.float64(), from_pandas=True),
                    pa.array(np.tile(share, rows), pa.float64()),
                    pa.array([error] * (rows * k), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return blocks.mapInArrow(project, RESULT)
