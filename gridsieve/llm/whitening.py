"""Whitened embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Only sums and products of the width of a vector leave the tasks; the factor, of that size, is turned on the
driver.  The norms of the turned columns give the eigenvalues, the normalised columns the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.sizing import written

SCALE, SHIFT = 64, 1_000_000
MAX_ENTRIES = 1 << 26  # of all scatter matrices together: 512 MB of doubles
MAX_LONG = float(2**63)


def grid(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """A vector as longs ``floor(scale * entry) + shift``, or null where it or one of its entries is not usable."""
    number = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(number, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(number, lambda c: F.floor(c * scale) + F.lit(shift).cast("long")))


@dataclass
class Axes:
    """What the fit list of one width gives: ``components`` in columns, by falling eigenvalue."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S/n`` with whole numbers taken off first, so that only the last subtraction rounds."""
        whole, rest = self.sums // self.n, self.sums % self.n
        return (x - whole).astype(float) - rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of ``(n*x - S)**2``."""
        whole, rest = self.sums // self.n, self.sums % self.n
        near = x - whole  # n*x - S = n*near - rest, without the large common part
        if not near.size:
            return [0] * len(x)
        if (float(np.abs(near).max()) * self.n + self.n) ** 2 * x.shape[1] < MAX_LONG:
            off = self.n * near - rest
            return (off * off).sum(axis=1).tolist()
        # beyond a long the cast to the output type is an error, not another number
        return [sum((self.n * int(a) - int(b)) ** 2 for a, b in zip(row, rest, strict=True)) for row in near]


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``factor, order``: ``matrix[order][:, order] = factor @ factor.T``, with as many columns as the rank."""
    rest, n = matrix.astype(float).copy(), len(matrix)
    order, factor = np.arange(n), np.zeros((n, n))
    least = n * np.finfo(float).eps * max(rest.diagonal().max(initial=0.0), 0.0)
    for k in range(n):
        pivot = k + int(np.argmax(rest.diagonal()[k:]))
        if rest[pivot, pivot] <= least:
            return factor[:, :k], order
        for rows in (rest, factor, order):
            rows[[k, pivot]] = rows[[pivot, k]]
        rest[:, [k, pivot]] = rest[:, [pivot, k]]
        factor[k, k] = np.sqrt(rest[k, k])
        factor[k + 1 :, k] = rest[k + 1 :, k] / factor[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def turned(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor with its columns turned in pairs until all are orthogonal (one-sided Jacobi).

    A sweep is a tournament: in each of its rounds all columns are paired and turned at once.
    """
    columns, tol = factor.T.copy(), 4 * np.finfo(float).eps
    r = len(columns)
    seats = list(range(r + r % 2))  # with an odd number one column rests in each round
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            pairs = [(a, b) for a, b in zip(seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]) if max(a, b) < r]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            p, q = (np.array(side) for side in zip(*pairs, strict=True))
            one, two = columns[p], columns[q]
            a, b, c = ((u * v).sum(axis=1) for u, v in ((one, one), (two, two), (one, two)))
            off = np.abs(c) / np.sqrt(a * b)
            worst = max(worst, off.max())
            turn = off > tol
            if not turn.any():
                continue
            p, q, one, two, a, b, c = (v[turn] for v in (p, q, one, two, a, b, c))
            zeta = (b - a) / (2 * c)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = 1 / np.hypot(1.0, t)
            sin = cos * t
            columns[p], columns[q] = cos[:, None] * one - sin[:, None] * two, sin[:, None] * one + cos[:, None] * two
        if worst <= tol:
            break
    return columns.T


def principal(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues above zero and, in columns, their unit eigenvectors."""
    factor, order = pivoted_cholesky(covariance)
    if not factor.shape[1]:
        return np.zeros(0), np.zeros((len(covariance), 0))
    columns = turned(factor)
    values = (columns * columns).sum(axis=0)
    best = np.argsort(-values, kind="stable")[:k]
    components = np.empty((len(covariance), len(best)))
    components[order] = columns[:, best] / np.sqrt(values[best])
    return values[best], components


def _stacked(batch: pa.RecordBatch, name: str = "_x") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``width, rows, x``: the vectors of a batch by width."""
    lists = batch.column(batch.schema.get_field_index(name))
    starts = np.asarray(lists.offsets)
    flat, starts = np.asarray(lists.values), starts[: len(lists) + 1]
    widths = np.diff(starts)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        yield width, rows, flat[starts[rows][:, None] + np.arange(width)]


def _products(fit: DataFrame, axes: dict[int, Axes] | None, whiten: bool) -> dict[int, np.ndarray]:
    """By width: sums (without axes), or sums of products of centred or of whitened vectors.

    Each task adds up its own rows; the tasks' matrices meet row by row, so that no task or group grows
    with the number of vectors.
    """
    kind = pa.int64() if axes is None else pa.float64()
    schema = pa.schema([("width", pa.int32()), ("i", pa.int32()), ("v", pa.list_(kind))])
    ddl = f"width int, i int, v array<{'long' if axes is None else 'double'}>"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, x in _stacked(batch):
                if axes is None:
                    own = np.concatenate([[len(x)], x.sum(axis=0)])[None, :]
                else:
                    z = axes[width].whitened(x) if whiten else axes[width].centred(x)
                    own = z.T @ z
                held[width] = held[width] + own if width in held else own
        yield from _rows(((w, i), row) for w, m in held.items() for i, row in enumerate(m))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for width, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[width, i] = held.get((width, i), 0) + np.array(v)
        yield from _rows(held.items())

    def _rows(items) -> Iterator[pa.RecordBatch]:
        for (width, i), row in items:
            yield pa.RecordBatch.from_pylist([{"width": width, "i": i, "v": row.tolist()}], schema)

    met = fit.select("_x").mapInArrow(add, ddl).repartition("width", "i").mapInArrow(meet, ddl)
    found: dict[int, dict[int, list]] = {}
    for row in met.collect():  # at most MAX_ENTRIES numbers
        found.setdefault(row["width"], {})[row["i"]] = row["v"]
    return {w: np.array([rows[i] for i in sorted(rows)]) for w, rows in found.items()}


def fit_axes(vectors: DataFrame, vector_col: str = "embedding", k: int = 16, scale: int = SCALE, shift: int = SHIFT) -> dict[int, Axes]:
    """The axes of each width of usable vectors, from each distinct vector once; none for an empty table.

    Vectors are rounded down to the grid of ``grid`` first.  Null vectors, and those with null or not finite
    entries, are left out; vectors of different widths are fitted apart, and those without entries have no
    components.  Components with an eigenvalue of 0 (up to rounding) are left out.  Entries beyond the range of a
    long, and deviations beyond it, are an error.
    """
    distinct = vectors.select(grid(F.col(f"`{vector_col}`"), scale, shift).alias("_x")).where("_x IS NOT NULL").distinct()
    fit = written(distinct)
    widths = [r[0] for r in fit.select(F.size("_x")).distinct().limit(600).collect()]  # 600 widths are too many
    if sum(w * w for w in widths) > MAX_ENTRIES:
        raise ValueError(f"scatter matrices of widths up to {max(widths)} hold over {MAX_ENTRIES} entries")
    none = np.zeros(0), np.zeros((0, 0))
    axes = {w: Axes(int(m[0, 0]), m[0, 1:].astype(np.int64), *none, 0.0) for w, m in _products(fit, None, False).items()}
    for width, scatter in _products(fit, axes, whiten=False).items():
        own = axes[width]
        own.trace = float(scatter.trace()) / own.n
        own.eigenvalues, own.components = principal((scatter + scatter.T) / (2 * own.n), k)
    for width, products in _products(fit, axes, whiten=True).items():
        error = products / axes[width].n - np.eye(len(products))
        axes[width].identity_error = float(np.abs(error).max(initial=0.0))
    return axes


def whiten(
    vectors: DataFrame, axes: dict[int, Axes], vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT
) -> DataFrame:
    """``vectors`` without unusable rows, with ``n, deviation`` (long), ``whitened, explained`` (arrays) and ``identity_error``.

    Equal vectors, and repeated rows, each get their own row.  A vector of a width that was not fitted counts as
    unusable.  Other columns go through untouched; columns with the names of the new ones are replaced.
    """
    new = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    names = [f.split()[0] for f in new.split(", ")]
    kept = [c for c in vectors.columns if c not in names]
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.lit(0).alias("end"))
    ready = vectors.select(grid(F.col(f"`{vector_col}`"), scale, shift).alias("_x"), row.alias("row")).where("_x IS NOT NULL")
    lists = pa.list_(pa.float64())
    kinds = [pa.int64(), pa.int64(), lists, lists, pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, rows, x in _stacked(batch):
                if width not in axes:
                    continue
                own, count = axes[width], len(rows)
                explained = (own.eigenvalues / own.trace).tolist() if len(own.eigenvalues) else []
                columns = [[own.n] * count, own.deviation(x), own.whitened(x).tolist(), [explained] * count, [own.identity_error] * count]
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(rows)), *arrays], ["row", *names])

    schema = ready.select("row", *(F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in new.split(", "))).schema
    done = ready.mapInArrow(run, schema)
    return done.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)), *names)


def by_component(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row per vector and component, counted from 1."""
    each = whitened.select(id_col, "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("_i", "_w"))
    return each.select(
        id_col, (F.col("_i") + 1).cast("int").alias("component"), "n", "deviation", F.col("_w").alias("whitened"),
        F.col("explained")[F.col("_i")].alias("explained"), "identity_error",
    )
