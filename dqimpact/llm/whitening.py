"""Whitened principal components of vectors, from a distributed covariance and refined eigenvectors.

Entries become whole numbers first, so counts, sums and deviations are exact.  Each task sums products of
its vectors, taken from a common whole-number centre next to the mean; what leaves a task has the size of
the dimension squared.  The eigenvectors of the covariance are found in single precision and corrected by
the iterations of Ogita and Aishima, which need matrix products in higher precision only.  Where
eigenvalues lie closer together than the present error, the iterations cannot tell their vectors apart;
such a cluster is solved on its own, in its own subspace and scaled to its own width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqimpact.llm.store import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
# An entry beyond this has no whole number of 64 bits.
LARGEST = float(1 << 56)
# Eigenvalues below this share of the trace are rounding.
NEGLIGIBLE = 1e-13
MOST_STEPS = 20
BATCH_VECTORS = 4_000
LONG = 2**63 - 1


def whole_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, x: the vectors that can be used, as whole numbers."""
    quoted = F.col(f"`{vector}`").cast("array<double>")
    usable = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < LARGEST) & ~F.isnan(c))
    kept = rows.select(F.col(f"`{key}`").cast("long").alias("key"), quoted.alias("v"))
    kept = kept.filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(F.coalesce(usable, F.lit(False)))
    return kept.select("key", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_VECTORS):
            part = batch.slice(start, BATCH_VECTORS)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def exact_sums(vectors: DataFrame, width: int) -> list[int]:
    """The sum of every dimension."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width, object)
        for _, x in _matrices(batches, 0, width):
            small = len(x) * max(int(x.max()), -int(x.min())) <= LONG
            sums += (x if small else x.astype(object)).sum(axis=0).astype(object)
        texts = pa.array([str(s) for s in sums])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), texts], names=["place", "total"])

    parts = vectors.select("x").mapInArrow(summed, "place int, total string")
    totals = parts.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return [int(row["total"]) for row in totals.orderBy("place").collect()]


def _products(parts: DataFrame, width: int) -> np.ndarray:
    """Sum up (i, j, value) of the upper triangle; as many rows as a triangle has are fetched."""
    found = np.zeros((width, width))
    for row in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        found[row["i"], row["j"]] = found[row["j"], row["i"]] = row["value"]
    return found


def _triangle(products: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(len(products))
    return pa.RecordBatch.from_arrays(
        [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(products[i, j])], names=["i", "j", "value"]
    )


def centred_products(vectors: DataFrame, centre: np.ndarray) -> np.ndarray:
    """The sum of products of the vectors less the centre."""
    width = len(centre)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((width, width))
        for _, x in _matrices(batches, 0, width):
            y = (x - centre).astype(np.float64)
            whole += y.T @ y
        yield _triangle(whole)

    return _products(vectors.select("x").mapInArrow(summed, "i int, j int, value double"), width)


def _clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Places of neighbouring eigenvalues that lie no further than `apart` from the next."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > apart) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.longdouble, np.longdouble]:
    """One correction: new vectors, eigenvalues, the bound below which gaps are not resolved, the error found."""
    r = np.eye(x.shape[1], dtype=x.dtype) - x.T @ x
    s = x.T @ (a @ x)
    # Vectors stay orthogonal only if rounding is the same on both sides of the diagonal.
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(np.diag(s))
    size = np.abs(values).max()
    apart = 2 * (np.linalg.norm(off.astype(np.float64)) + size * np.linalg.norm(r.astype(np.float64)))
    gap = values[None, :] - values[:, None]
    near = np.abs(gap) <= apart
    e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
    error = np.maximum(np.abs(r).max(), np.abs(off).max() / np.maximum(size, np.finfo(np.float64).tiny))
    return x + x @ e, values, apart, error


def _solved(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Vectors of one cluster, turned inside their subspace to the eigenvectors of the matrix in it."""
    basis, _ = np.linalg.qr(x.astype(np.float64))
    # One more product in higher precision makes the basis orthogonal again.
    basis = basis.astype(np.longdouble)
    basis = basis @ (1.5 * np.eye(x.shape[1], dtype=np.longdouble) - basis.T @ basis / 2)
    middle = np.trace(basis.T @ (a @ basis)) / x.shape[1]
    inside = basis.T @ (a @ basis - middle * basis)
    width = np.abs(inside).max()
    if width == 0:
        return basis
    _, turned = np.linalg.eigh(((inside + inside.T) / (2 * width)).astype(np.float64))
    return basis @ turned.astype(np.longdouble)


def refined_eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, to double precision and better."""
    a = matrix.astype(np.longdouble)
    size = np.abs(a).max()
    if not len(a) or size == 0:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / size
    _, start = np.linalg.eigh(a.astype(np.float32))
    x, least = start.astype(np.longdouble), np.inf
    limit = 8 * len(a) * np.finfo(np.longdouble).eps
    for _ in range(MOST_STEPS):
        moved, values, apart, error = _step(a, x)
        # Rounding ends the fall of the error before the limit is met.
        if error <= limit or (error >= least and error < 1e-17):
            break
        least, x = min(error, least), moved
        for cluster in _clusters(values, apart):
            x[:, cluster] = _solved(a, x[:, cluster])
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    signs = np.where(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])] < 0, -1, 1)
    return (values[order] * size).astype(np.float64), (x * signs).astype(np.float64)


def _numerators(x: np.ndarray, centre: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    """n * x - S in whole numbers, where S = n * centre + rest."""
    y = x - centre
    small = n * (max(int(y.max(initial=0)), -int(y.min(initial=0))) + 1) <= LONG
    return n * y - rest.astype(np.int64) if small else n * y.astype(object) - rest


def _deviations(numerators: np.ndarray) -> pa.Array:
    """Sums of squares; null beyond 64 bits."""
    most = max(int(abs(numerators).max(initial=0)), 1)
    if most * most * numerators.shape[1] <= LONG:
        return pa.array((numerators * numerators).sum(axis=1).astype(np.int64))
    wide = numerators.astype(object)
    return pa.array([int(s) if s <= LONG else None for s in (wide * wide).sum(axis=1)], pa.int64())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every vector and component.

    Defined results for odd rows: a vector that is null or empty, or holds a null, a non-finite entry or one
    of 2^56 or more, is left out, as are vectors of another length than the most frequent one (of equally
    frequent lengths, the longest); rows that share a key, or have none, are kept side by side; a
    component without variance has no whitened value; a deviation beyond 64 bits is null; further columns
    are left out.  All tasks get the components: `components` times the dimension numbers.
    """
    vectors = stored(whole_vectors(rows, key, vector), "vectors")
    lengths = vectors.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    main = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    width, n = (main["width"], main["n"]) if main else (1, 0)
    vectors = vectors.filter(F.size("x") == width)
    if n:
        sums = exact_sums(vectors, width)
        centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
        rest = np.array([s - n * int(c) for s, c in zip(sums, centre, strict=True)], object)
        mean = (rest / n).astype(np.longdouble)
        covariance = centred_products(vectors, centre).astype(np.longdouble) / n - np.outer(mean, mean)
        values, axes = refined_eigenvectors(covariance)
        trace = float(np.trace(covariance))
    else:
        centre, rest, values, axes, trace = np.zeros(1, np.int64), np.zeros(1, object), np.zeros(1), np.eye(1), 0.0
    count = min(components, width)
    values, axes = values[:count], axes[:, :count]
    sound = values > NEGLIGIBLE * trace
    weights = axes / np.where(sound, np.sqrt(np.maximum(values, 0)), np.inf)
    explained = values / trace if trace > 0 else np.zeros(count)

    def projected(numerators: np.ndarray) -> np.ndarray:
        return (numerators / n).astype(np.float64) @ weights

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros((count, count))
        for _, x in _matrices(batches, 0, width):
            made = projected(_numerators(x, centre, rest, n))
            whole += made.T @ made
        yield _triangle(whole)

    error = 0.0
    if sound.any():
        found = _products(vectors.select("x").mapInArrow(products, "i int, j int, value double"), count) / n
        error = float(np.abs(found - np.eye(count))[np.ix_(sound, sound)].max())

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, 1, width):
            numerators = _numerators(x, centre, rest, n)
            made, many = projected(numerators), len(x)
            repeated = pa.array(np.repeat(np.arange(many), count))
            yield pa.RecordBatch.from_arrays(
                [
                    pc.take(part.column(0), repeated),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), many)),
                    pa.array(np.full(many * count, n, np.int64)),
                    pc.take(_deviations(numerators), repeated),
                    pa.array(made.ravel(), mask=np.tile(~sound, many)),
                    pa.array(np.tile(explained, many)),
                    pa.array(np.full(many * count, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    return vectors.select("key", "x").mapInArrow(rows_of, schema)
