"""Whitening of embeddings along the leading eigenvectors of their covariance, found by Jacobi-Davidson.

The covariance matrix is never formed. All that touches the data are passes that
multiply it with a block of vectors: each task centres its rows, multiplies twice and
adds up, and Spark sums the partial blocks, so what reaches the driver has the size of
the block (dimensions x vectors) and never depends on the rows. On the driver live the
search space and its products: Rayleigh-Ritz in the space gives the current pairs,
converged leading pairs are locked, and for the others the projected correction
equations are solved by MINRES, all of them together, so that an inner step of all
equations is one pass. The solutions extend the space until every residual has reached
double precision.

Entries are whole numbers, so count, sums and total variance are exact, and centring
subtracts a whole number and a fraction below one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.llm.common import columns_or_raise
from veilgauge.session import materialise

COMPONENTS = 32
#: Vectors carried beyond the wanted ones.
GUARD = 8
INNER_STEPS = 8
INNER_TOLERANCE = 0.05
MAX_ROUNDS = 200
#: A residual counts as double precision below this share of the largest eigenvalue ...
RESIDUAL = 64 * np.finfo(float).eps
#: ... or, where sums of many rows can't be told any better, below this one once it stops falling.
STALLED = 1e-12
#: Directions with less than this share of the largest eigenvalue hold no variance that could be scaled to one.
NO_VARIANCE = 1e-10
SCALE, SHIFT = 64, 1_000_000
MOST_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Fitted:
    """Vectors, sums per dimension, eigenvalues in falling order, their unit eigenvectors as columns, total variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int

    @property
    def floors(self) -> np.ndarray:
        """Whole part of the mean; what is left of it is below one."""
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n / self.n for s in self.sums])


def whole_numbers(vector: Column) -> Column:
    """The vector in 64ths as longs from a shift on; null where it is null or has a null or non-finite entry."""
    wide = F.transform(vector, lambda c: c.cast("double"))
    usable = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(usable, F.transform(wide, lambda c: F.floor(c * SCALE).cast("long") + SHIFT))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow batch as one matrix of longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _summed(table: DataFrame, per_batch: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of a vector of `size` numbers over all batches: added up per task, then by Spark."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                now = per_batch(_matrix(batch.column(0)))
                total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["cell", "amount"])

    parts = table.select("x").mapInArrow(partial, "cell int, amount double")
    found = parts.groupBy("cell").agg(F.sum("amount").alias("amount")).toArrow()
    out = np.zeros(size)
    out[found.column("cell").to_numpy()] = found.column("amount").to_numpy()
    return out


def _sums(table: DataFrame, dimensions: int) -> list[tuple[int, int]]:
    """Exact sum and sum of squares (both off the shift) of every dimension.

    A task adds up in longs while they surely suffice, then hands over decimals.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * dimensions
        squares = [0] * dimensions
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0)) - SHIFT
            if float(np.abs(x).max()) ** 2 * len(x) >= 2.0 ** 62:
                x = x.astype(object)
            sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0))]
            squares = [a + int(b) for a, b in zip(squares, (x * x).sum(axis=0))]
        decimals = [pa.array(v, pa.decimal128(38, 0)) for v in (sums, squares)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dimensions), pa.int32()), *decimals], names=["cell", "total", "squares"])

    parts = table.select("x").mapInArrow(partial, "cell int, total decimal(38,0), squares decimal(38,0)")
    rows = parts.groupBy("cell").agg(F.sum("total").alias("total"), F.sum("squares").alias("squares")).collect()
    return [(int(r["total"]), int(r["squares"])) for r in sorted(rows, key=lambda r: r["cell"])]


def _minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Solutions of one symmetric system per column, all stepped together; `apply` multiplies every column."""
    norm = lambda y: np.sqrt((y * y).sum(axis=0))
    safe = lambda v: np.where(v > 0, v, 1.0)
    first = beta = norm(b)
    x, w, w_before = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    r_before, r, y = b, b, b
    beta_before = np.ones_like(beta)
    cosine, sine = -np.ones_like(beta), np.zeros_like(beta)
    dbar, epsilon, phibar = np.zeros_like(beta), np.zeros_like(beta), beta
    for step in range(steps):
        active = (phibar > tolerance * first) & (beta > 0)
        if not active.any():
            break
        v = np.where(active, y / safe(beta), 0.0)
        y = apply(v)
        if step:
            y = y - beta / beta_before * r_before
        alpha = (v * y).sum(axis=0)
        y = y - alpha / safe(beta) * r
        r_before, r, beta_before, beta = r, y, safe(beta), norm(y)
        epsilon_before = epsilon
        delta, gbar = cosine * dbar + sine * alpha, sine * dbar - cosine * alpha
        epsilon, dbar = sine * beta, -cosine * beta
        gamma = np.maximum(np.hypot(gbar, beta), np.finfo(float).tiny)
        cosine, sine = gbar / gamma, beta / gamma
        phi, phibar = cosine * phibar, sine * phibar
        w_before, w = w, (v - epsilon_before * w_before - delta * w) / gamma
        x = np.where(active, x + phi * w, x)
    return x


def _orthogonal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal basis of what a block adds to an orthonormal basis."""
    for _ in range(2):
        block = block - against @ (against.T @ block)
        lengths = np.sqrt((block * block).sum(axis=0))
        block = block[:, lengths > 1e-300] / lengths[lengths > 1e-300]
        if not block.size:
            return block
        left, size, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, size > 1e-10 * size[0]]
    return block


def jacobi_davidson(products: Callable[[np.ndarray], np.ndarray], dimensions: int, wanted: int,
                    seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest eigenvalues (falling), unit eigenvectors and residual norms of a symmetric matrix known by its products only."""
    wanted = min(wanted, dimensions)
    width = min(dimensions, wanted + GUARD)
    widest = min(dimensions, 4 * width)
    space = _orthogonal(np.random.default_rng(seed).standard_normal((dimensions, width)), np.zeros((dimensions, 0)))
    image = products(space)
    locked = locked_image = np.zeros((dimensions, 0))
    history: list[float] = []
    for _ in range(MAX_ROUNDS):
        small = space.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = space @ turn, image @ turn
        residual = images - vectors * values
        sizes = np.sqrt((residual * residual).sum(axis=0))
        left = wanted - locked.shape[1]
        top = max([values[0], *(locked * locked_image).sum(axis=0)], default=0.0) if left else 0.0
        worst = float(sizes[:left].max(initial=0.0))
        history.append(worst)
        stalled = len(history) > 3 and worst > 0.5 * history[-3]
        bound = max(STALLED if stalled else 0.0, RESIDUAL) * top
        # Only leading pairs are locked: one that lies below an open pair may still turn out not to be wanted.
        open_pairs = np.flatnonzero(sizes[:left] > bound)
        done = int(open_pairs[0]) if len(open_pairs) else left
        locked = np.hstack([locked, vectors[:, :done]])
        locked_image = np.hstack([locked_image, images[:, :done]])
        if done == left:
            break
        space, image, residual = vectors[:, done:], images[:, done:], residual[:, done:]
        values, left = values[done:], left - done
        if space.shape[1] + locked.shape[1] + 1 > max(widest, width + locked.shape[1]):
            space, image = space[:, :width], image[:, :width]
        chosen = np.flatnonzero(sizes[done:done + left] > RESIDUAL * top)
        held = np.hstack([locked, space[:, :left]])
        shifts = values[chosen]

        def projected(block: np.ndarray) -> np.ndarray:
            block = block - held @ (held.T @ block)
            block = products(block) - block * shifts
            return block - held @ (held.T @ block)

        side = -residual[:, chosen]
        side = side - held @ (held.T @ side)
        steps = _minres(projected, side, INNER_STEPS, INNER_TOLERANCE)
        fresh = _orthogonal(np.hstack([steps, residual[:, chosen]]) if steps.shape[1] < left else steps,
                            np.hstack([locked, space]))
        room = dimensions - locked.shape[1] - space.shape[1]
        fresh = fresh[:, :room]
        if not fresh.size:
            if len(history) > 8 and history[-1] > STALLED * top:
                raise ArithmeticError("the search space can't be extended although residuals are still large")
            continue
        space, image = np.hstack([space, fresh]), np.hstack([image, products(fresh)])
    else:
        raise ArithmeticError(f"residuals still at {history[-1]} after {MAX_ROUNDS} rounds")
    # Locked pairs carry rounding of their own; one turn within them makes them orthogonal and sorted.
    basis, triangle = np.linalg.qr(locked)
    basis_image = np.linalg.solve(triangle.T, locked_image.T).T
    small = basis.T @ basis_image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = basis @ turn
    residual = basis_image @ turn - vectors * values
    return values, vectors, np.sqrt((residual * residual).sum(axis=0))


def fit(table: DataFrame, n: int, components: int = COMPONENTS) -> Fitted | None:
    """Leading eigenpairs of the covariance of all rows of `table` (column ``x``, long vectors of one length)."""
    lengths = table.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if not n or not lengths["high"]:
        return None
    if lengths["low"] != lengths["high"]:
        raise ValueError(f"vectors have {lengths['low']} to {lengths['high']} dimensions; whitening needs one length")
    dimensions = lengths["high"]
    exact = _sums(table, dimensions)
    trace = sum(n * q - s * s for s, q in exact) / n / n
    sums = [s + n * SHIFT for s, _ in exact]
    blank = Fitted(n, sums, np.zeros(0), np.zeros((dimensions, 0)), trace, np.zeros(0), 0)
    if not trace:
        return blank
    floors, rest, passes = blank.floors, blank.rest, [0]

    def products(block: np.ndarray) -> np.ndarray:
        passes[0] += 1

        def centred(x: np.ndarray) -> np.ndarray:
            c = (x - floors) - rest
            return (c.T @ (c @ block)).ravel()

        return _summed(table, centred, block.size).reshape(block.shape) / n

    values, vectors, residuals = jacobi_davidson(products, dimensions, components)
    kept = values > NO_VARIANCE * values[0]
    vectors = vectors[:, kept] * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])[kept]
    return Fitted(n, sums, values[kept], vectors, trace, residuals[kept], passes[0])


def _identity_error(table: DataFrame, project: Callable[[np.ndarray], np.ndarray], n: int, k: int) -> float:
    """Largest entry of the covariance of the whitened rows minus the identity; centred first, in a pass of its own."""
    mean = _summed(table, lambda x: project(x).sum(axis=0), k) / n

    def outer(x: np.ndarray) -> np.ndarray:
        z = project(x) - mean
        return (z.T @ z).ravel()

    return float(np.abs(_summed(table, outer, k * k).reshape(k, k) / n - np.eye(k)).max())


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector: id, ``n``, ``deviation`` (long), ``whitened``, ``explained`` (arrays) and ``identity_error``.

    Vectors that are null or hold a null or non-finite entry are left out; they count
    nowhere. Rows that repeat a vector or an id all count and are all returned; a null
    id stays null. Equal eigenvalues leave their eigenvectors free to turn among each
    other, and every row gets the same choice. Directions without variance (below
    `NO_VARIANCE` of the largest) are no components, so a single vector, or copies of
    one, have none: ``whitened`` is empty and ``identity_error`` 0. An empty table
    gives an empty table. Vectors of different lengths are an error, as is an entry
    beyond the range of long. ``deviation`` is exact; it is null where it exceeds a
    long. Columns of the input other than the two named are not read.
    """
    columns_or_raise(vectors, id_column, vector)
    numbers = vectors.select(F.col(f"`{id_column}`").alias("id"), whole_numbers(F.col(f"`{vector}`")).alias("x"))
    table, n = materialise(numbers.where("x is not null"))
    fitted = fit(table, n, components)
    names = ["id", "n", "deviation", "whitened", "explained", "identity_error"]
    dtype = table.schema["id"].dataType.simpleString()
    schema = f"id {dtype}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if fitted is None:
        return table.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    k = len(fitted.values)
    floors, rest, sums = fitted.floors, fitted.rest, fitted.sums
    scaled = fitted.vectors / np.sqrt(fitted.values)
    explained = (fitted.values / fitted.trace).tolist() if k else []

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - floors) - rest) @ scaled

    error = _identity_error(table, project, n, k) if k else 0.0
    left_over = np.array([s % n for s in sums], dtype=object)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column(1))
            away = x - floors
            if (float(np.abs(away).max()) + 1) ** 2 * n * n * x.shape[1] < 2.0 ** 62:
                gap = n * away - left_over.astype(np.int64)
                deviation = (gap * gap).sum(axis=1).tolist()
            else:
                gap = n * away.astype(object) - left_over
                deviation = [int(v) if v <= MOST_LONG else None for v in (gap * gap).sum(axis=1)]
            white = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * k, pa.int32()), pa.array(project(x).ravel()))
            shares = pa.array([explained] * m, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n] * m, pa.int64()), pa.array(deviation, pa.int64()), white, shares,
                                              pa.array([error] * m)], names=names)

    return table.select("id", "x").mapInArrow(rows, schema).withColumnRenamed("id", id_column)
