"""Ridge on wide feature vectors from a Gram matrix in tiles.

With d features the moments of a group are a d x d matrix: as columns of an aggregate they end at a
few dozen features.  Here features are one array column.  A task keeps the centred moments of
each (group, fold) it meets, in numpy, and sends them as tiles of ``TILE`` x ``TILE``; tiles of one place
are merged one by one where they arrive, so no task holds more than a matrix per fold for one tile.
Leave-fold-out moments are merged from the other folds' tiles (never subtracted), and each
fit then gathers its own tiles: 8 d^2 bytes in one task, whatever the number of rows.

Rows that are mostly zeros come as places and values (``sparse``): only these are computed, moved and summed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coobs.plans.joins import bounded, salted_join

TILE = 64
#: Sparse rows that are summed at once.
DENSE_ROWS = 4096
#: Bytes of moments that a task holds before it sends them on.
HELD = 128 << 20
#: Bytes of fits that may be broadcast.
BROADCAST = 64 << 20
FULL = -1


class Moments:
    """Number, means and centred products of some rows; ``j`` tells a second set of columns."""

    __slots__ = ("n", "i", "j", "m")

    def __init__(self, n: float, i: np.ndarray, j: np.ndarray, m: np.ndarray):
        self.n, self.i, self.j, self.m = n, i, j, m

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        centred = x - mean
        return cls(float(len(x)), mean, mean, centred.T @ centred)

    def add(self, other: Moments) -> None:
        total = self.n + other.n
        if other.n == 0:
            return
        if self.n == 0:
            self.n, self.i, self.j, self.m = other.n, other.i.copy(), other.j.copy(), other.m.copy()
            return
        di, dj = other.i - self.i, other.j - self.j
        self.m = self.m + other.m + (self.n * other.n / total) * np.outer(di, dj)
        self.i, self.j = self.i + di * (other.n / total), self.j + dj * (other.n / total)
        self.n = total


def matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows; null entries are zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = pc.fill_null(pc.list_flatten(column).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def sparse(places: Column, values: Column) -> Column:
    """A row's values other than zero and their places from 0, each named once; others than those of the width count as zeros."""
    return F.struct(places.cast("array<int>").alias("at"), values.cast("array<double>").alias("of"))


def _cells(column: pa.StructArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of what sparse rows hold, in the order of rows."""
    at, of = column.field("at"), column.field("of")
    row = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False))
    place = pc.fill_null(pc.list_flatten(at), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    value = pc.fill_null(pc.list_flatten(of), 0.0).to_numpy(zero_copy_only=False)
    inside = (place >= 0) & (place < width)
    return row[inside], place[inside], value[inside]


def sparse_moments(column: pa.StructArray, y: np.ndarray, width: int) -> Moments:
    """Moments of sparse rows and their target, without their zeros where that is cheaper and loses no digits.

    Raw sums less n times the means cancel only for columns that are rarely zero, and these are few
    in rows of few values; such rows are filled up and centred first.
    """
    n = len(y)
    row, place, value = _cells(column, width)
    length = np.bincount(row, minlength=n)
    if 4 * (length**2).sum() > n * width**2 or 2 * np.bincount(place, minlength=width).max(initial=0) > n:
        x = np.zeros((n, width + 1))
        x[row, place] = value
        x[:, -1] = y
        return Moments.of(x)
    mean = np.append(np.bincount(place, value, width) / n, y.mean())
    first = np.cumsum(length) - length
    many = length[row]  # every value meets those of its row
    left = np.repeat(np.arange(len(row)), many)
    right = np.arange(len(left)) + np.repeat(first[row] - (np.cumsum(many) - many), many)
    m = np.empty((width + 1, width + 1))
    m[:-1, :-1] = np.bincount(place[left] * width + place[right], value[left] * value[right], width**2).reshape(width, width)
    m[:-1, :-1] -= n * np.outer(mean[:-1], mean[:-1])
    off = y - mean[-1]
    m[:-1, -1] = m[-1, :-1] = np.bincount(place, value * off[row], width)
    m[-1, -1] = off @ off
    return Moments(float(n), mean, mean, m)


TILES = "g string, fold int, bi int, bj int, n double, i array<double>, j array<double>, m array<double>"


def _tile_rows(g: str | None, fold: int, s: Moments) -> list[tuple]:
    edges = range(0, len(s.i), TILE)
    return [
        (g, fold, a // TILE, b // TILE, s.n, s.i[a : a + TILE], s.j[b : b + TILE], s.m[a : a + TILE, b : b + TILE].ravel())
        for a in edges
        for b in edges
        if a <= b
    ]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["g", "fold", "bi", "bj", "n", "i", "j", "m"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), *[pa.list_(pa.float64())] * 3]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)


def _held(parts: Iterator[tuple[tuple, Moments]]) -> Iterator[pa.RecordBatch]:
    """Moments of a task per key, sent on as tiles when they grow too large and at the end."""
    held: dict[tuple, Moments] = {}
    size = 0
    for key, part in parts:
        if key in held:
            held[key].add(part)
        else:
            held[key] = part
            size += part.m.nbytes
        if size > HELD:
            for (g, fold), s in held.items():
                yield _batch(_tile_rows(g, fold, s))
            held, size = {}, 0
    for (g, fold), s in held.items():
        yield _batch(_tile_rows(g, fold, s))


def _by_key(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
    where: dict[tuple, list[int]] = {}
    for at, key in enumerate(zip(batch.column("g").to_pylist(), batch.column("fold").to_pylist())):
        where.setdefault(key, []).append(at)
    for key, at in where.items():
        yield key, np.array(at)


def _dense_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Moments]]:
    for batch in batches:
        x = matrix(batch.column("x"))
        for key, at in _by_key(batch):
            yield key, Moments.of(x[at])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _held(_dense_parts(batches))


def _sparse_partial(width: int):
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Moments]]:
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for key, at in _by_key(batch):
                for lo in range(0, len(at), DENSE_ROWS):
                    mine = at[lo : lo + DENSE_ROWS]
                    yield key, sparse_moments(batch.column("x").take(pa.array(mine)), y[mine], width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _held(parts(batches))

    return partial


def _pooled(left_out: bool):
    """Merge the tiles of one place as they arrive; give those without each fold, and of all."""

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds: dict[int, Moments] = {}
        for batch in batches:
            for r in batch.select(["fold", "n", "i", "j", "m"]).to_pylist():
                i, j = np.array(r["i"]), np.array(r["j"])
                part = Moments(r["n"], i, j, np.array(r["m"]).reshape(len(i), len(j)))
                if r["fold"] in folds:
                    folds[r["fold"]].add(part)
                else:
                    folds[r["fold"]] = part
        g, bi, bj = (k.as_py() for k in key)
        for out in [*(sorted(folds) if left_out else []), FULL]:
            first = next(iter(folds.values()))
            total = Moments(0.0, np.zeros_like(first.i), np.zeros_like(first.j), np.zeros_like(first.m))
            for fold in sorted(folds):
                if fold != out:
                    total.add(folds[fold])
            yield _batch([(g, out, bi, bj, total.n, total.i, total.j, total.m.ravel())])

    return merge


FITS = "g string, fold int, n double, alpha double, intercept double, coef array<double>"


def solve_wide(n: float, mean: np.ndarray, m: np.ndarray, alpha: float, standardise: bool) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) with a free intercept; the last column is the target."""
    g, c = m[:-1, :-1], m[:-1, -1]
    scale = np.ones(len(c))
    if standardise:
        sd = np.sqrt(np.maximum(np.diag(g), 0.0) / n)
        scale = np.where(sd > 0, sd, 1.0)
    a = g / np.outer(scale, scale) + alpha * np.eye(len(c))
    try:
        low = np.linalg.cholesky(a)
        coef = np.linalg.solve(low.T, np.linalg.solve(low, c / scale))
    except np.linalg.LinAlgError:  # without a penalty columns may depend on each other
        coef = np.linalg.lstsq(a, c / scale, rcond=None)[0]
    coef = coef / scale
    return float(mean[-1] - coef @ mean[:-1]), coef


def _fits(alpha: float, standardise: bool, min_rows: int):
    def fit(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = [r for b in batches for r in b.to_pylist()]
        width = sum(len(r["i"]) for r in tiles if r["bi"] == r["bj"])
        mean, m, n = np.zeros(width), np.zeros((width, width)), tiles[0]["n"]
        for r in tiles:
            a, b, p, q = r["bi"] * TILE, r["bj"] * TILE, len(r["i"]), len(r["j"])
            block = np.array(r["m"]).reshape(p, q)
            m[a : a + p, b : b + q] = block
            m[b : b + q, a : a + p] = block.T
            mean[a : a + p] = r["i"]
        if n < min_rows:
            return
        intercept, coef = solve_wide(n, mean, m, alpha, standardise)
        types = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
        values = [key[0].as_py(), key[1].as_py(), n, alpha, intercept, coef]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["g", "fold", "n", "alpha", "intercept", "coef"])

    return fit


def packed(features: Sequence[str]) -> Column:
    """Feature columns as one array; nulls are zeros."""
    return F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features])


def wide_ridge(rows: DataFrame, group: str, fold: str | None, x: Column, y: Column, *, alpha: float = 1.0, standardise: bool = True, min_rows: int = 5, width: int | None = None) -> DataFrame:
    """(``group``, ``fold``, ``n``, ``alpha``, ``intercept``, ``coef``) of one ridge per group, ``fold`` -1, and
    with ``fold`` one more without each fold.

    ``x`` is an array of one length for all rows or, with ``width``, a ``sparse`` row of it.  Rows without a target teach nothing; groups with fewer
    than ``min_rows`` others give no fit.
    """
    known = rows.where(y.isNotNull())
    keys = [F.col(f"`{group}`").cast("string").alias("g"), (F.col(f"`{fold}`") if fold else F.lit(0)).cast("int").alias("fold")]
    if width is None:
        tiles = known.select(*keys, F.concat(x, F.array(y.cast("double"))).alias("x")).mapInArrow(_partial, TILES)
    else:
        tiles = known.select(*keys, x.alias("x"), y.cast("double").alias("y")).mapInArrow(_sparse_partial(width), TILES)
    pooled = tiles.groupBy("g", "bi", "bj").applyInArrow(_pooled(fold is not None), TILES)
    fits = pooled.groupBy("g", "fold").applyInArrow(_fits(alpha, standardise, min_rows), FITS)
    return fits.withColumnRenamed("g", group)


def dot(x: Column, coef: Column) -> Column:
    """Sum of products of two arrays, nulls as zeros."""
    return F.aggregate(F.zip_with(x, coef, lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)


def sparse_dot(x: Column, coef: Column) -> Column:
    """The same for a ``sparse`` row."""
    return F.aggregate(F.zip_with(x["at"], x["of"], lambda i, v: F.coalesce(F.get(coef, i) * v, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)


def with_wide_linear(
    rows: DataFrame, fits: DataFrame, on: Sequence[str], x: Column, out: str, max_rows: int, width: int, is_sparse: bool = False
) -> DataFrame:
    """Apply fits to the array (or ``sparse`` row) ``x``.  They are broadcast while ``max_rows`` of them stay below
    a size in bytes, and else meet the rows in a join that splits hot keys."""
    small = fits.select(*on, "intercept", "coef")
    if max_rows * (width + 8) * 8 <= BROADCAST:
        joined = rows.join(bounded(small, max_rows), list(on), "left")
    else:
        joined = salted_join(rows, small, list(on))
    product = (sparse_dot if is_sparse else dot)(x, F.col("coef"))
    return joined.withColumn(out, F.col("intercept") + product).drop("intercept", "coef")
