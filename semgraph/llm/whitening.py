"""Whitening of embeddings on their leading principal components.

Sums and the centred covariance are added up over the cluster: every task adds its rows into one matrix,
the rows of these matrices meet by number, and only the finished matrix (dimensions squared) reaches the
driver. There Householder reflections make it tridiagonal, Sturm counts bisect for the leading eigenvalues,
and inverse iteration finds their vectors, made orthogonal again where eigenvalues lie close together.
Mean and components (dimensions times components) then travel with the projection to every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semgraph.llm.common import Queries, free_name, table
from semgraph.session import materialize

QUERIES = Queries()

EPS = float(np.finfo(float).eps)
LONG_MAX = 2**63 - 1
#: Eigenvalues up to this share of the largest count as zero.
NO_SPREAD = 1e-12


# Symmetric eigenproblem -----------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of a tridiagonal matrix similar to the symmetric ``matrix``, and the unit
    vectors of the Householder reflections that lead to it; the k-th acts on the places after ``k``."""
    a = np.array(matrix, float)
    reflectors = []
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        length = np.linalg.norm(v)
        v[0] += length if v[0] >= 0 else -length
        size = np.linalg.norm(v)
        if size == 0:
            reflectors.append(v)
            continue
        v /= size
        p = a[k + 1:, k + 1:] @ v
        w = p - (v @ p) * v
        a[k + 1:, k + 1:] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
        reflectors.append(v)
    return a.diagonal().copy(), a.diagonal(-1).copy(), reflectors


def count_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each of ``at``: the negative terms of the Sturm recurrence."""
    least = EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0), 1e-300)
    q = diagonal[0] - at
    count = (q < 0).astype(int)
    for d, e in zip(diagonal[1:], off):
        q = d - at - e * e / np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection of all at once."""
    reach = np.concatenate([np.abs(off), [0]]) + np.concatenate([[0], np.abs(off)])
    low = np.full(k, (diagonal - reach).min() - EPS)
    high = np.full(k, (diagonal + reach).max() + EPS)
    wanted = len(diagonal) - np.arange(1, k + 1)
    for _ in range(2000):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        under = count_below(diagonal, off, middle) <= wanted
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return low + (high - low) / 2


def solve_tridiagonal(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """``(T - shift) y = right`` by elimination with row swaps; pivots of zero become tiny."""
    n = len(diagonal)
    least = EPS * max(np.abs(diagonal).max(), np.abs(off).max(initial=0), 1e-300)
    rows = np.zeros((n, 3))  # of the upper factor: the diagonal and two places right of it
    y = right.copy()
    rows[:, 0] = diagonal - shift
    rows[:-1, 1] = off
    for i in range(n - 1):
        following = np.array([off[i], rows[i + 1, 0], rows[i + 1, 1]])
        if abs(off[i]) > abs(rows[i, 0]):
            rows[i], following = following, rows[i].copy()
            y[i], y[i + 1] = y[i + 1], y[i]
        if abs(rows[i, 0]) < least:
            rows[i, 0] = least
        factor = following[0] / rows[i, 0]
        rows[i + 1] = [following[1] - factor * rows[i, 1], following[2] - factor * rows[i, 2], 0]
        y[i + 1] -= factor * y[i]
    if abs(rows[-1, 0]) < least:
        rows[-1, 0] = least
    for i in range(n - 1, -1, -1):
        known = rows[i, 1] * y[i + 1] if i + 1 < n else 0.0
        known += rows[i, 2] * y[i + 2] if i + 2 < n else 0.0
        y[i] = (y[i] - known) / rows[i, 0]
    return y


def leading_vectors(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns; the
    largest entry of each is positive."""
    n, k = len(matrix), min(k, len(matrix))
    scale = float(np.abs(matrix).max(initial=0))
    if k == 0 or scale == 0:
        return np.zeros(k), np.eye(n)[:, :k]
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, k)
    spread = max(np.abs(diagonal).max(), np.abs(off).max(initial=0))
    rng, found, cluster = np.random.default_rng(0), [], 0
    shift = np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * spread:
            cluster = j
        shift = min(value, shift - 4 * EPS * spread)  # equal eigenvalues get shifts of their own
        y = rng.standard_normal(n)
        for _ in range(6):
            y = solve_tridiagonal(diagonal, off, shift, y / np.linalg.norm(y))
            y /= np.linalg.norm(y)
            for _ in range(2):
                for other in found[cluster:]:
                    y -= (other @ y) * other
                y /= np.linalg.norm(y)
        found.append(y)
    vectors = np.stack(found, axis=1)
    for at in range(len(reflectors) - 1, -1, -1):
        v = reflectors[at]
        vectors[at + 1:] -= 2 * np.outer(v, v @ vectors[at + 1:])
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
    return values * scale, vectors


# Statistics over the cluster ------------------------------------------------------------------


def whole_vectors(vector: Column) -> Column:
    """Whether a vector and all its entries are there and finite."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, entry), F.lit(False))


def integer_vectors(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * entry)`` of each entry, ``array<long>``."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    if len(set(lengths.tolist())) > 1:
        raise ValueError("vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), int(lengths[0]) if len(lengths) else 0)


@dataclass(frozen=True)
class Whitening:
    """``n`` fitted vectors, their ``sums``, the ``components`` as columns with falling ``eigenvalues``,
    the ``trace`` of the covariance, and the largest entry of the whitened covariance less the identity."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact: as 64-bit numbers if they fit, else as Python's."""
        sums = np.array(self.sums, object)
        most = max([abs(s) for s in self.sums], default=0) + self.n * int(np.abs(x.astype(float)).max(initial=0))
        if most < 2**62:
            return self.n * x - sums.astype(np.int64)
        return self.n * x.astype(object) - sums

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of the squared ``offsets`` of each row, exact; None if it is no 64-bit number."""
        off = self.offsets(x)
        if off.dtype == np.int64 and int(np.abs(off).max(initial=0)) ** 2 * max(1, off.shape[1]) <= LONG_MAX:
            return (off * off).sum(1).tolist()
        exact = (off.astype(object) ** 2).sum(1) if off.shape[1] else [0] * len(off)
        return [int(v) if v <= LONG_MAX else None for v in exact]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.offsets(x).astype(float) / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)


def column_sums(fitted: DataFrame) -> list[int]:
    """Sum of each dimension over ``fitted(x)``, exact."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] | None = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                safe = int(np.abs(x.astype(float)).max(initial=0)) * len(x) < 2**62
                part = x.sum(0).tolist() if safe else [sum(c) for c in x.T.tolist()]
                if total is not None and len(total) != len(part):
                    raise ValueError("vectors of different lengths")
                total = part if total is None else [s + t for s, t in zip(total, part)]
        if total is not None:
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()),
                                   pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["dim", "total"])

    found = (fitted.mapInArrow(sums, "dim int, total decimal(38, 0)").groupBy("dim")
             .agg(F.sum("total").alias("total"), F.count("*").alias("tasks")).orderBy("dim").collect())  # a row per dimension
    if len({row.tasks for row in found}) > 1:
        raise ValueError("vectors of different lengths")
    return [int(row.total) for row in found]


def covariance(fitted: DataFrame, model: Whitening) -> np.ndarray:
    """Covariance of ``fitted(x)`` around the mean of ``model``, divisor ``n``.

    A task holds one matrix; row ``i`` of all matrices is added up in one task, one at a time."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                off = model.centred(_matrix(batch.column("x")))
                total = off.T @ off if total is None else total + off.T @ off
        if total is not None:
            yield _numbered(dict(enumerate(total)))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("row").to_pylist(), _matrix(batch.column("entries"))):
                total[i] = total[i] + row if i in total else row
        yield _numbered(total)

    schema = "row int, entries array<double>"
    rows = fitted.mapInArrow(products, schema).repartition("row").mapInArrow(added, schema).collect()
    return np.array([row.entries for row in sorted(rows, key=lambda r: r.row)]).reshape(len(rows), -1) / model.n


def _numbered(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(rows.keys(), pa.int32()),
                            pa.array([r.tolist() for r in rows.values()], pa.list_(pa.float64()))], names=["row", "entries"])


def identity_error(fitted: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened ``fitted(x)`` less the identity."""
    k = len(model.eigenvalues)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1) * k)
        for batch in batches:
            if batch.num_rows:
                white = model.whiten(_matrix(batch.column("x")))
                total += np.concatenate([white.sum(0), (white.T @ white).ravel()])
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["place", "total"])

    found = (fitted.mapInArrow(moments, "place int, total double").groupBy("place").agg(F.sum("total").alias("total"))
             .orderBy("place").collect())  # a row per entry
    values = np.array([row.total for row in found]) / model.n
    mean, second = values[:k], values[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def fit_whitening(vectors: DataFrame, column: str = "x", k: int = 4) -> Whitening:
    """Whitening of the distinct values of ``column`` (``array<long>``, without nulls).

    Copies are combined in the map tasks before they are shuffled. All vectors must have one length, else
    ValueError. Components without spread (see ``NO_SPREAD``) are left out, so that fewer distinct vectors
    than ``k + 1`` give fewer components, and one vector or none gives none. The matrix of a task takes
    8 bytes times the dimensions squared.
    """
    fitted = materialize(vectors.select(F.col(column).alias("x")).distinct())
    n, sums = fitted.count(), column_sums(fitted)
    model = Whitening(n, tuple(sums), np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    if not sums:
        return model
    spread = covariance(fitted, model)
    values, components = leading_vectors(spread, k)
    kept = values > NO_SPREAD * max(values.max(initial=0), 0)
    model = Whitening(n, model.sums, components[:, kept], values[kept], float(np.trace(spread)))
    if not kept.any():
        return model
    return Whitening(*(getattr(model, f) for f in ("n", "sums", "components", "eigenvalues", "trace")),
                     identity_error(fitted, model))


def project(vectors: DataFrame, model: Whitening, column: str = "x") -> DataFrame:
    """``vectors`` with ``deviation`` and ``whitened`` (``array<double>``, one number per component) appended."""

    @F.arrow_udf("struct<deviation: bigint, whitened: array<double>>")
    def white(x: pa.Array) -> pa.Array:
        rows = _matrix(x)
        return pa.StructArray.from_arrays(
            [pa.array(model.deviations(rows), pa.int64()), pa.array(model.whiten(rows).tolist(), pa.list_(pa.float64()))],
            names=["deviation", "whitened"])

    taken = vectors.columns
    whole = free_name(taken, "projected")
    return vectors.withColumn(whole, white.asNondeterministic()(F.col(f"`{column}`"))).select(
        *[F.col(f"`{c}`") for c in taken], F.col(f"`{whole}`.deviation").alias(free_name(taken, "deviation")),
        F.col(f"`{whole}`.whitened").alias(free_name(taken, "whitened")))


def whiten(rows: DataFrame, vector: str = "embedding", k: int = 4, scale: int = 256) -> tuple[DataFrame, Whitening]:
    """``rows`` with ``x`` (the integer vector), ``deviation`` and ``whitened``, and the fitted model.

    Rows whose vector is null or holds nulls, NaN or infinities are left out; all others stay, repeated ones
    too, and count once in the fit. Other columns stay; appended ones get underscores before names that are
    taken. An empty table gives no rows. A vector whose length differs from the others' is a ValueError.
    """
    x = free_name(rows.columns, "x")
    whole = rows.filter(whole_vectors(F.col(f"`{vector}`"))).withColumn(x, integer_vectors(F.col(f"`{vector}`"), scale))
    model = fit_whitening(whole, x, k)
    return project(whole, model, x), model


@QUERIES.add("op13_whitening")
def op13(spark, sf):
    rows, model = whiten(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    shares = [float(e / model.trace) for e in model.eigenvalues]
    return (rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(F.array(*[F.lit(s) for s in shares or [0.0]]), F.col("at") + 1).alias("explained"),
                    F.lit(model.identity_error).alias("identity_error")))
