"""Ridge fits from aggregated moments.

The rows are aggregated once into moments per (property, fold[, inner fold]); every fit,
penalty search and inner validation error is then a small dense solve on those cells.
The solves run in ``applyInPandas`` per property on K x inner rows, whatever the data size.
A few columns are SQL aggregates; more of them are summed as one product per batch, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coobs.plans.gram import HELD, Moments, packed, with_wide_linear
from coobs.plans.joins import bounded
from coobs.plans.moments import fold_moments, mean_of, moment_of

MAX_COLUMNS = 24  # 24 predictors are 325 moments; beyond that they are tiles (plans.gram)
MAX_CELLS = 64 * 8
BLOCK_COLUMNS = 6  # from here on an aggregate per pair of columns costs more than a product per batch


class Cells:
    """Moments of several cells as arrays; pools any subset of them."""

    def __init__(self, pdf: pd.DataFrame, features: Sequence[str], y: str):
        cols = [*features, y]
        p = len(cols)
        self.n = pdf["n"].to_numpy(float)
        self.mean = pdf[[mean_of(c) for c in cols]].to_numpy(float)
        self.m = np.zeros((len(pdf), p, p))
        for i, a in enumerate(cols):
            for j in range(i, p):
                v = pdf[moment_of(a, cols[j])].to_numpy(float)
                self.m[:, i, j] = v
                self.m[:, j, i] = v

    def pool(self, mask: np.ndarray):
        """(n, mean, centred moments) over the cells of ``mask``."""
        n = self.n[mask]
        total = n.sum()
        if total == 0:
            return 0.0, np.zeros(self.mean.shape[1]), np.zeros(self.m.shape[1:])
        mean = n @ self.mean[mask] / total
        d = self.mean[mask] - mean
        return total, mean, self.m[mask].sum(0) + np.einsum("c,ci,cj->ij", n, d, d)


def solve(stats, alpha: float, standardise: bool = False):
    """(intercept, coefficients) of ridge with a free intercept."""
    n, mean, m = stats
    g, c = m[:-1, :-1], m[:-1, -1]
    scale = np.ones(len(c))
    if standardise:
        sd = np.sqrt(np.maximum(np.diag(g), 0.0) / n)
        scale = np.where(sd > 0, sd, 1.0)
    gs = g / np.outer(scale, scale)
    coef = np.linalg.lstsq(gs + alpha * np.eye(len(c)), c / scale, rcond=None)[0] / scale
    return mean[-1] - coef @ mean[:-1], coef


def sse(stats, intercept: float, coef: np.ndarray) -> float:
    """Squared error of a fit on the rows behind ``stats``."""
    n, mean, m = stats
    v = np.append(-coef, 1.0)
    off = mean[-1] - intercept - coef @ mean[:-1]
    return float(v @ m @ v + n * off * off)


def gcv_alpha(stats, alphas: Sequence[float]) -> float:
    """Penalty by generalised cross-validation: the mean-leverage form of leave-one-out,
    which needs the moments only."""
    n, _, m = stats
    lam = np.maximum(np.linalg.eigvalsh(m[:-1, :-1]), 0.0)
    best, pick = np.inf, alphas[0]
    for a in alphas:
        edf = 1.0 + float((lam / (lam + a)).sum())
        score = sse(stats, *solve(stats, a)) / max(1.0 - edf / n, 1e-9) ** 2
        if score < best:
            best, pick = score, a
    return pick


def inner_alpha(cells: Cells, train: np.ndarray, inner: np.ndarray, alphas, standardise=False, pooled=True) -> float:
    """Penalty by inner K-fold on the cells of ``train``.

    pooled: R2 of all inner predictions together; otherwise the mean of the fold R2s.
    """
    best, pick = -np.inf, alphas[0]
    parts = []
    for j in np.unique(inner[train]):
        fit, val = cells.pool(train & (inner != j)), cells.pool(train & (inner == j))
        if fit[0] > 0 and val[0] > 0:
            parts.append((fit, val))
    sst_all = cells.pool(train)[2][-1, -1]
    for a in alphas:
        errors = [sse(val, *solve(fit, a, standardise)) for fit, val in parts]
        if pooled:
            score = 1.0 - sum(errors) / sst_all if sst_all > 0 else -np.inf
        else:
            scores = [1.0 - e / val[2][-1, -1] for e, (_, val) in zip(errors, parts) if val[2][-1, -1] > 0]
            score = float(np.mean(scores)) if scores else -np.inf
        if score > best:
            best, pick = score, a
    return pick


def moment_cells(df: DataFrame, keys: Sequence[str], features: Sequence[str], y: str) -> DataFrame:
    if len(features) > MAX_COLUMNS:
        raise ValueError(f"{len(features)} predictors; the moment path takes up to {MAX_COLUMNS}")
    return (fold_moments if len(features) < BLOCK_COLUMNS else block_moments)(df, keys, [*features, y])


def block_moments(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``fold_moments``, summed in numpy: a task keeps the moments of each key it meets and sends them on
    once, and the tasks' moments of a key are merged."""
    keys, cols = list(keys), list(cols)
    p = len(cols)
    given = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[: len(keys)])
    types = pa.schema([("n", pa.float64()), ("mean", pa.list_(pa.float64())), ("m", pa.list_(pa.float64()))])

    def sent(held: dict[tuple, tuple[pa.RecordBatch, Moments]]) -> pa.RecordBatch:
        rows = pa.Table.from_batches([at for at, _ in held.values()]).combine_chunks().to_batches()[0]
        parts = [s for _, s in held.values()]
        sums = [pa.array(v, t) for v, t in zip(([s.n for s in parts], [s.i for s in parts], [s.m.ravel() for s in parts]), types.types)]
        return pa.RecordBatch.from_arrays([*rows.columns, *sums], names=[*keys, *types.names])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[pa.RecordBatch, Moments]] = {}
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols])
            known = np.ones(len(x), bool)
            for c in cols:
                known &= pc.is_valid(batch.column(c)).to_numpy(zero_copy_only=False)
            code = np.zeros(len(x), np.int64)
            for k in keys:
                d = pc.dictionary_encode(batch.column(k), null_encoding="encode")
                code = code * max(len(d.dictionary), 1) + d.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            for mine in np.split(order, first[1:]) if len(first) else []:
                at = batch.select(keys).slice(int(mine[0]), 1)
                key = tuple(c[0].as_py() for c in at.columns)
                seen = mine[known[mine]]
                part = Moments.of(x[seen]) if len(seen) else Moments(0.0, np.zeros(p), np.zeros(p), np.zeros((p, p)))
                if key in held:
                    held[key][1].add(part)
                else:
                    held[key] = at, part
            if len(held) * 8 * p * p > HELD:
                yield sent(held)
                held = {}
        if held:
            yield sent(held)

    names = [*[mean_of(c) for c in cols], *[moment_of(a, b) for i, a in enumerate(cols) for b in cols[i:]]]
    upper = np.triu_indices(p)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = Moments(0.0, np.zeros(p), np.zeros(p), np.zeros((p, p)))
        for n, mean, m in zip(pdf["n"], pdf["mean"], pdf["m"]):
            mean = np.asarray(mean, float)
            total.add(Moments(n, mean, mean, np.asarray(m, float).reshape(p, p)))
        out = pdf[keys].iloc[:1].reset_index(drop=True)
        sums = pd.DataFrame([[total.n, *total.i, *total.m[upper]]], columns=["n", *names])
        return pd.concat([out, sums], axis=1)

    parts = given.mapInArrow(blocks, f"{kinds}, n double, mean array<double>, m array<double>")
    return parts.groupBy(*keys).applyInPandas(merge, ", ".join([kinds, "n double", *[f"`{c}` double" for c in names]]))


def with_linear(
    rows: DataFrame, fits: DataFrame, on: Sequence[str], features: Sequence[str], out: str, max_rows: int
) -> DataFrame:
    """Apply fitted (intercept, coef) to the rows, joined on ``on``."""
    if len(features) > MAX_COLUMNS:
        return with_wide_linear(rows, fits, on, packed(features), out, max_rows, len(features))
    value: Column = F.col("intercept")
    for i, f in enumerate(features):
        value = value + F.col("coef")[i] * F.col(f)
    small = fits.select(*on, "intercept", "coef")
    return rows.join(bounded(small, max_rows), list(on), "left").withColumn(out, value).drop("intercept", "coef")
