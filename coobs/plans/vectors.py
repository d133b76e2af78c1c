"""Moments of thousands of features held as one array column.

A row per value and feature, or an aggregate column per feature, ends at some hundred features.  Here a
task keeps element-wise moments of each (group, fold) in numpy and sends them in blocks of
``BLOCK`` features, which are merged one by one where they arrive; the statistics of all other folds are
merged from their blocks, never subtracted.  Null entries are missing for their feature alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coobs.plans.joins import salted_join
from coobs.plans.ranking import top_k

BLOCK = 1024
#: Bytes of moments a task holds before it sends them on, and of statistics that may be broadcast.
HELD, BROADCAST = 64 << 20, 64 << 20
PARTS = ("n", "x", "xx", "y", "yy", "xy")  # numbers, means and centred sums per feature
STATS = "g string, fold int, block int, " + ", ".join(f"{p} array<double>" for p in PARTS)


def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One row per entry of ``PARTS``; not-a-number marks a missing value."""
    if not np.isnan(x.sum()):  # nothing is missing (or infinities meet, which the longer way treats alike)
        mx, my = x.mean(axis=0), y.mean()
        dx, dy, one = x - mx, y - my, np.ones(x.shape[1])
        return np.stack([len(y) * one, mx, np.einsum("ij,ij->j", dx, dx), my * one, dy @ dy * one, dy @ dx])
    known = ~np.isnan(x)
    n = known.sum(axis=0).astype(float)
    some = np.maximum(n, 1)
    mx, my = np.where(known, x, 0.0).sum(axis=0) / some, (known * y[:, None]).sum(axis=0) / some
    dx, dy = np.where(known, x - mx, 0.0), known * (y[:, None] - my)
    return np.stack([n, mx, (dx * dx).sum(axis=0), my, (dy * dy).sum(axis=0), (dx * dy).sum(axis=0)])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    dx, dy, w = b[1] - a[1], b[3] - a[3], a[0] * b[0] / some
    dx, dy = np.where(w > 0, dx, 0.0), np.where(w > 0, dy, 0.0)
    mean = lambda i: np.where(a[0] == 0, b[i], np.where(b[0] == 0, a[i], a[i] + (b[i] - a[i]) * b[0] / some))
    return np.stack([n, mean(1), a[2] + b[2] + w * dx * dx, mean(3), a[4] + b[4] + w * dy * dy, a[5] + b[5] + w * dx * dy])


def _rows(cells: list[tuple]) -> pa.RecordBatch:
    """(g, fold, block, moments) as a batch."""
    columns = [pa.array([c[i] for c in cells], t) for i, t in ((0, pa.string()), (1, pa.int32()), (2, pa.int32()))]
    columns += [pa.array([c[3][i] for c in cells], pa.list_(pa.float64())) for i in range(len(PARTS))]
    return pa.RecordBatch.from_arrays(columns, names=["g", "fold", "block", *PARTS])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, np.ndarray] = {}

    def sent():
        for (g, fold), m in held.items():
            yield _rows([(g, fold, b, m[:, b * BLOCK : (b + 1) * BLOCK]) for b in range(-(-m.shape[1] // BLOCK))])
        held.clear()

    for batch in batches:
        batch = batch.filter(pc.and_(pc.is_valid(batch.column("x")), pc.is_valid(batch.column("y"))))
        if not batch.num_rows:
            continue
        x = _numbers(batch.column("x")).reshape(batch.num_rows, -1)
        y = batch.column("y").to_numpy(zero_copy_only=False)
        where: dict[tuple, list[int]] = {}
        for at, key in enumerate(zip(batch.column("g").to_pylist(), batch.column("fold").to_pylist())):
            where.setdefault(key, []).append(at)
        for key, at in where.items():
            part = moments(x[at], y[at])
            held[key] = merged(held[key], part) if key in held else part
        if sum(m.nbytes for m in held.values()) > HELD:
            yield from sent()
    yield from sent()


def _others(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per fold the moments of all other folds, for one block of features."""
    folds: dict[int, np.ndarray] = {}
    for batch in batches:
        for r in batch.select(["fold", *PARTS]).to_pylist():
            part = np.array([r[p] for p in PARTS])
            folds[r["fold"]] = merged(folds[r["fold"]], part) if r["fold"] in folds else part
    for out in sorted(folds):
        total = None
        for fold in sorted(folds):
            if fold != out:
                total = folds[fold] if total is None else merged(total, folds[fold])
        if total is not None:
            yield _rows([(key[0].as_py(), out, key[1].as_py(), total)])


def leave_fold_out_vectors(rows: DataFrame, x: Column, y: Column | None = None, group: Column | None = None) -> DataFrame:
    """(``g``, ``fold``, ``block``, moments) of the rows of every other fold, per block of features.

    ``x`` is an array of one length; rows whose ``y`` is null teach nothing.
    """
    given = rows.select(
        (F.lit("") if group is None else group.cast("string")).alias("g"), F.col("fold").cast("int").alias("fold"),
        x.alias("x"), (F.lit(0.0) if y is None else y.cast("double")).alias("y"),
    )
    parts = given.mapInArrow(_partial, STATS)  # a filter on ``x`` would compute it twice
    return parts.groupBy("g", "block").applyInArrow(_others, STATS)


def screen_vectors(rows: DataFrame, x: Column, y: Column, group: str, k: int) -> DataFrame:
    """(group, ``fold``, ``feature`` its place from 0, ``abs_corr``, ``rank``): the k features most correlated with ``y``
    on the other folds' rows.  A constant feature counts as 0; ties go to the first.  A block sends its k best alone."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for r in batch.to_pylist():
                n, xx, yy, xy = (np.array(r[p]) for p in ("n", "xx", "yy", "xy"))
                with np.errstate(divide="ignore", invalid="ignore"):
                    corr = np.where((np.sqrt(xx / n) > 1e-9) & (yy > 0), np.abs(xy) / np.sqrt(xx * yy), 0.0)
                for j in np.lexsort((np.arange(len(corr)), -corr))[:k]:
                    for column, v in zip(out, (r["g"], r["fold"], r["block"] * BLOCK + int(j), float(corr[j]))):
                        column.append(v)
            types = [pa.string(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["g", "fold", "feature", "abs_corr"])

    stats = leave_fold_out_vectors(rows, x, y, F.col(f"`{group}`"))
    few = stats.mapInArrow(best, "g string, fold int, feature int, abs_corr double")
    return top_k(few.withColumnRenamed("g", group), [group, "fold"], [F.desc("abs_corr"), F.asc("feature")], k)


def standardise_vectors(rows: DataFrame, x: str, width: int, max_folds: int, out: str = "z", flat: float = 1e-6, limit: float = 10.0) -> DataFrame:
    """``out``: z of each feature from the other folds' rows, clipped to +-limit; null where flat or missing."""
    stats = leave_fold_out_vectors(rows, F.col(f"`{x}`"))
    per_block = stats.select("fold", "block", "x", F.zip_with("xx", "n", lambda m, n: F.sqrt(F.greatest(F.try_divide(m, n), F.lit(0.0)))).alias("sd"))
    whole = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", c))), lambda b: b[c]))
    per_fold = per_block.groupBy("fold").agg(whole("x").alias("_mu"), whole("sd").alias("_sd"))  # one row a fold, ``width`` numbers each
    if max_folds * width * 16 > BROADCAST:
        joined = salted_join(rows, per_fold, ["fold"])
        z = _scores(None, flat, limit)(F.col("fold").cast("int"), F.col(f"`{x}`"), F.col("_mu"), F.col("_sd"))
        return joined.select(*[F.col(f"`{c}`") for c in rows.columns if c != out], z.alias(out))
    # a few folds' numbers go to every task once, not beside every row
    few = per_fold.limit(max_folds + 1).toArrow()
    if few.num_rows > max_folds:
        raise ValueError(f"more than {max_folds} folds in a table bounded by them")
    stats = {f: (_numbers(few["_mu"].slice(i, 1)), _numbers(few["_sd"].slice(i, 1))) for i, f in enumerate(few["fold"].to_pylist())}
    z = _scores(rows.sparkSession.sparkContext.broadcast(stats), flat, limit)(F.col("fold").cast("int"), F.col(f"`{x}`"))
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != out], z.alias(out))


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """All entries of lists one after another; nulls are not-a-number."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(pc.list_flatten(column).cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)


def _scores(stats: Broadcast | None, flat: float, limit: float):
    """z of whole batches, in numpy: an expression per element costs many times as much.  Means and deviations are those
    of the row's fold in ``stats``, else follow as two more columns."""

    @F.arrow_udf("array<double>")
    def z(fold: pa.Array, x: pa.Array, *given: pa.Array) -> pa.Array:
        length = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
        known = x.is_valid().to_numpy(zero_copy_only=False)
        if given:
            known &= given[0].is_valid().to_numpy(zero_copy_only=False)
            v = _numbers(x.take(pa.array(np.flatnonzero(known))))
            m, s = (_numbers(g.take(pa.array(np.flatnonzero(known)))) for g in given)
        else:
            folds, places = np.array(sorted(stats.value)), pc.fill_null(fold, -1).to_numpy(zero_copy_only=False)
            known &= np.isin(places, folds)
            v = _numbers(x.take(pa.array(np.flatnonzero(known))))
            at = np.searchsorted(folds, places[known])
            m, s = (np.stack([stats.value[k][i] for k in folds])[at].ravel() if len(at) else np.zeros(0) for i in (0, 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = np.clip((v - m) / s, -limit, limit)
        offsets = np.append(0, np.cumsum(np.where(known, length, 0))).astype(np.int32)
        lists = pa.array(scores, mask=~(s > flat) | np.isnan(scores))
        return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~known, False)), lists)

    return z
