"""Whitening of embeddings by distributed centred covariance.

Entries become whole numbers x = floor(scale * c) + offset, so counts and sums
are exact. The covariance is summed over the vectors less the whole part of
their mean; products of such small whole numbers are exact, the fraction of the
mean is taken off in rational arithmetic, and one rounding is left. Tasks hand
over one matrix each, summed by Spark. The matrix of a vector's width is then
decomposed on the driver (``eigen``), and all vectors are projected.
"""

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelark.llm.common import quoted, without
from framelark.llm.eigen import leading_pairs

SCALE, OFFSET = 1024, 100_000
#: Bounds the matrix that the driver holds; wider vectors fail the job.
MOST_WIDTH = 2048
ROWS = 4096
ADDED = ("n", "deviation", "whitened", "explained", "identity_error")


class Whitening(NamedTuple):
    """``n`` vectors with exact sums ``total``; eigenvalues and component columns."""

    n: int
    total: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray

    def shift(self) -> np.ndarray:
        """Whole parts of the means."""
        return np.array([s // self.n for s in self.total], np.int64)

    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.total], np.int64)


def usable(vector: Column) -> Column:
    """Not null, not empty, all entries finite."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def _matrices(column: pa.Array, scale: int, offset: int) -> Iterator[np.ndarray]:
    """The whole numbers of a batch, rows of one width, a bounded number at a time."""
    sizes = np.diff(column.offsets.to_numpy(False))
    edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges[:-1], edges[1:]):
        for at in range(a, b, ROWS):
            rows = column.slice(at, min(ROWS, b - at))
            cells = np.floor(scale * rows.flatten().to_numpy(False).astype(float))
            if not (np.abs(cells) < 2.0**62).all():
                raise OverflowError("an entry times the scale is beyond 64 bits")
            yield cells.astype(np.int64).reshape(len(rows), -1) + offset


def _gram(x: np.ndarray) -> np.ndarray:
    """Exact sums of products of whole numbers, as Python integers."""
    top = int(np.abs(x).max(initial=0))
    if top * top * len(x) < 1 << 53:
        y = x.astype(float)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T @ y


def _vectors(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.col(column).cast("array<double>").alias("v"))


def _sums(rows: DataFrame, column: str, scale: int, offset: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for x in _matrices(batch.column(0), scale, offset):
                state = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
                state[0] += len(x)
                fits = int(np.abs(x).max(initial=0)) < 1 << 40
                state[1] += (x if fits else x.astype(object)).sum(axis=0).astype(object)
        for width, (n, total) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([width], pa.int32()), pa.array([n], pa.int64()),
                 pa.array([total.tolist()], pa.list_(pa.decimal128(38, 0)))],
                names=["width", "n", "total"])

    parts = _vectors(rows, column).mapInArrow(run, "width int, n long, total array<decimal(38,0)>")
    widths = parts.groupBy("width").agg(F.sum("n").alias("n")).orderBy("width").limit(5).collect()
    if not widths:
        return 0, []
    if len(widths) > 1:
        raise ValueError(f"vectors of several widths: {[r['width'] for r in widths]}")
    if widths[0]["width"] > MOST_WIDTH:
        raise ValueError(f"vectors wider than {MOST_WIDTH}: {widths[0]['width']}")
    sums = parts.select(F.posexplode("total").alias("i", "s")).groupBy("i").agg(
        F.sum("s").alias("s")).collect()
    return widths[0]["n"], [int(r["s"]) for r in sorted(sums, key=lambda r: r["i"])]


def _covariance(
    rows: DataFrame, column: str, scale: int, offset: int, n: int, total: Sequence[int],
) -> np.ndarray:
    """Over all vectors, divisor n; exact but for the last rounding."""
    width = len(total)
    shift = np.array([s // n for s in total], np.int64)
    i, j = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in batches:
            for x in _matrices(batch.column(0), scale, offset):
                more = _gram(x - shift)
                part = more if part is None else part + more
        if part is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                 pa.array(part[i, j].tolist(), pa.decimal128(38, 0))], names=["i", "j", "p"])

    cells = _vectors(rows, column).mapInArrow(run, "i int, j int, p decimal(38,0)").groupBy(
        "i", "j").agg(F.sum("p").alias("p")).collect()
    out = np.zeros((width, width))
    rest = [s % n for s in total]
    for r in cells:
        a, b = r["i"], r["j"]
        out[a, b] = out[b, a] = (n * int(r["p"]) - rest[a] * rest[b]) / (n * n)
    return out


def fit(
    vectors: DataFrame, column: str = "embedding", components: int = 8, scale: int = SCALE,
    offset: int = OFFSET,
) -> Whitening | None:
    """The whitening of all usable vectors; None if there is none.

    Components whose eigenvalue is 0 but for rounding cannot be scaled to unit
    variance and are left out.
    """
    rows = vectors.where(usable(F.col(column)))
    n, total = _sums(rows, column, scale, offset)
    if not n:
        return None
    matrix = _covariance(rows, column, scale, offset, n, total)
    values, parts = leading_pairs(matrix, components)
    real = values > 64 * len(total) * np.finfo(float).eps * max(values[0], 0.0)
    return Whitening(n, total, float(np.trace(matrix)), values[real], parts[:, real])


def _projected(x: np.ndarray, w: Whitening) -> np.ndarray:
    centred = (x - w.shift()) - w.rest() / w.n
    return centred @ (w.components / np.sqrt(w.values))


def _deviation(x: np.ndarray, w: Whitening) -> np.ndarray:
    """Sums of (n x - S)^2, exact; beyond 64 bits the job fails."""
    near = x - w.shift()
    top = (int(np.abs(near).max(initial=0)) + 1) * w.n
    if top * top * x.shape[1] < 1 << 63:
        apart = w.n * near - w.rest()
        return (apart * apart).sum(axis=1)
    apart = w.n * near.astype(object) - w.rest().astype(object)
    out = (apart * apart).sum(axis=1)
    if max(out) >= 1 << 63:
        raise OverflowError("a deviation is beyond 64 bits")
    return out.astype(np.int64)


def identity_error(
    vectors: DataFrame, whitening: Whitening, column: str = "embedding", scale: int = SCALE,
    offset: int = OFFSET,
) -> float:
    """Largest entry of the whitened vectors' covariance less the identity."""
    k = len(whitening.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.zeros(k + k * k)
        for batch in batches:
            for x in _matrices(batch.column(0), scale, offset):
                y = _projected(x, whitening)  # centred: the mean is the vectors' own
                part += np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(part)), pa.int32()), pa.array(part)], names=["i", "s"])

    rows = vectors.where(usable(F.col(column)))
    sums = _vectors(rows, column).mapInArrow(run, "i int, s double").groupBy("i").agg(
        F.sum("s").alias("s")).collect()
    flat = np.array([r["s"] for r in sorted(sums, key=lambda r: r["i"])]) / whitening.n
    mean, square = flat[:k], flat[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(
    vectors: DataFrame, column: str = "embedding", components: int = 8, scale: int = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """The usable rows with all their columns, plus ``n``, ``deviation``,
    ``whitened`` ARRAY<DOUBLE>, ``explained`` ARRAY<DOUBLE> and ``identity_error``.

    Rows whose vector is null, empty or holds a null or an entry that is not
    finite are left out. Repeated rows count as often as they come. Arrays are
    shorter than ``components`` where the vectors span fewer dimensions, and
    empty if all are equal. Vectors of several widths fail the job, and so do
    entries and deviations beyond 64 bits. Input columns named like an added
    one are replaced; without a usable row the result is empty.
    """
    at = "`" + column.replace("`", "``") + "`"
    whitening = fit(vectors, at, components, scale, offset)
    carried = without(vectors, *ADDED)
    names = [f"c{i}" for i in range(len(carried.columns))]
    rows = vectors.where(usable(F.col(at))).select(
        F.col(at).cast("array<double>").alias("v"),
        *[F.col(c).alias(n) for c, n in zip(quoted(carried), names)])
    kinds = ["n long", "deviation long", "whitened array<double>", "explained array<double>",
             "identity_error double"]
    schema = ", ".join([*[f"{n} {f.dataType.simpleString()}" for n, f in zip(names, carried.schema)], *kinds])
    error = identity_error(vectors, whitening, at, scale, offset) if whitening else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            parts = list(_matrices(batch.column(0), scale, offset))
            y = np.concatenate([_projected(x, whitening) for x in parts])
            k = y.shape[1]
            bounds = pa.array(np.arange(len(y) + 1) * k, pa.int32())
            explained = np.tile(whitening.values / whitening.trace if k else [], len(y))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(np.full(len(y), whitening.n)),
                 pa.array(np.concatenate([_deviation(x, whitening) for x in parts])),
                 pa.ListArray.from_arrays(bounds, pa.array(y.ravel())),
                 pa.ListArray.from_arrays(bounds, pa.array(explained, pa.float64())),
                 pa.array(np.full(len(y), error))],
                names=[*names, *[kind.split()[0] for kind in kinds]])

    out = rows.mapInArrow(run, schema) if whitening else vectors.sparkSession.createDataFrame([], schema)
    return out.select(
        *[F.col(n).alias(c) for n, c in zip(names, carried.columns)], *ADDED)
