"""Wide ridges from Gram tiles against dense refits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coobs import ENTITY, PROPERTY, VALUE
from coobs.operators import models
from coobs.plans import gram


def refit(x, y, alpha):
    """Standardised ridge with a free intercept, by the normal equations."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1
    z = (x - mean) / sd
    b = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return y.mean() - b @ mean, b


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n, d = 400, 150  # more than two tiles, the last one ragged
    x = rng.normal(size=(n, d)) + 1e3 * (np.arange(d) % 3)  # means far from zero
    x[:, 7] = 5.0  # constant
    y = x[:, :5] @ np.array([1, -2, 3, 0.5, 4.0]) + rng.normal(size=n)
    group, fold = np.array(["a", "b", "c"])[np.minimum(np.arange(n) % 5, 2)], np.arange(n) % 4
    rows = [(str(i), str(g), float(v), int(k), *map(float, r)) for i, (g, v, k, r) in enumerate(zip(group, y, fold, x))]
    rows += [(f"s{i}", "small", float(i), i, *[float(i)] * d) for i in range(3)]
    names = [f"f{j}" for j in range(d)]
    schema = f"{ENTITY} string, {PROPERTY} string, {VALUE} double, fold int, " + ", ".join(f"{c} double" for c in names)
    df = spark.createDataFrame(rows, schema).repartition(7)
    return df, names, x, y, group, fold


def test_fits_equal_dense_refits(table, monkeypatch):
    df, names, x, y, group, fold = table
    monkeypatch.setattr(gram, "HELD", 1)  # every batch sends its moments on
    fits = {(r[PROPERTY], r["fold"]): r for r in models.ridge_per_property(df, names, alpha=2.0, with_folds=True).collect()}
    assert set(fits) == {(g, k) for g in "abc" for k in [-1, *np.unique(fold)]}
    for (g, k), r in fits.items():
        b0, b = refit(x[(group == g) & (fold != k)], y[(group == g) & (fold != k)], 2.0)
        assert np.allclose(r["coef"], b, atol=1e-7) and abs(r["intercept"] - b0) < 1e-4


def test_wide_model_predicts_and_falls_back_to_the_mean(table):
    df, names, x, y, group, _ = table
    model = models.Ridge(tuple(names), alpha=1.0, max_groups=10)
    got = {r[ENTITY]: r["pred"] for r in model.predict(model.fit(df), df).select(ENTITY, "pred").collect()}
    for g in "abc":
        b0, b = refit(x[group == g], y[group == g], 1.0)
        assert np.allclose([got[str(i)] for i in np.flatnonzero(group == g)], b0 + x[group == g] @ b, atol=1e-6)
    assert all(got[f"s{i}"] == 1.0 for i in range(3))


def test_a_table_of_fits_too_large_to_broadcast(table, monkeypatch):
    df, names, *_ = table
    wide = df.withColumn("x", gram.packed(names))
    narrow = {r[ENTITY]: r["pred"] for r in models.wide_ridge_oof(wide, "x", len(names), max_groups=4).collect()}
    monkeypatch.setattr(gram, "BROADCAST", 0)
    joined = {r[ENTITY]: r["pred"] for r in models.wide_ridge_oof(wide, "x", len(names), max_groups=4).collect()}
    assert narrow.keys() == joined.keys() and all(a == joined[k] or abs(a - joined[k]) < 1e-9 for k, a in narrow.items() if a is not None)


def test_no_rows(spark):
    empty = spark.createDataFrame([], f"{PROPERTY} string, fold int, {VALUE} double, x array<double>")
    assert gram.wide_ridge(empty, PROPERTY, "fold", F.col("x"), F.col(VALUE)).count() == 0


def test_sparse_rows_equal_dense_rows(table, monkeypatch):
    df, names, *_ = table
    d = len(names)
    cells = F.filter(F.transform(gram.packed(names), lambda v, i: F.struct(i.alias("i"), F.when(v < 3, v).alias("v"))), lambda c: c["v"].isNotNull())
    rows = df.select(ENTITY, PROPERTY, VALUE, "fold", cells.alias("c"))
    # places out of the width count as zeros
    at = F.concat(F.transform("c", lambda c: c["i"]), F.array(F.lit(d), F.lit(-1)))
    rows = rows.withColumn("x", gram.sparse(at, F.concat(F.transform("c", lambda c: c["v"]), F.array(F.lit(9.0), F.lit(9.0)))))
    full = F.transform(gram.packed(names), lambda v: F.when(v < 3, v).otherwise(0.0))
    dense = models.wide_ridge_oof(df.withColumn("x", full), "x", d, max_groups=4)
    monkeypatch.setattr(gram, "DENSE_ROWS", 7)
    thin = models.wide_ridge_oof(rows, "x", d, max_groups=4, is_sparse=True)
    want, got = ({r[ENTITY]: r["pred"] for r in t.select(ENTITY, "pred").collect()} for t in (dense, thin))
    assert want.keys() == got.keys() and sum(v is not None for v in got.values()) == 400
    assert all((v is None and got[k] is None) or abs(v - got[k]) < 1e-6 for k, v in want.items())


def test_sparse_moments(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    n, d = 300, 40
    x = np.where(rng.random((n, d)) < 0.05, rng.normal(size=(n, d)) + 50, 0.0)
    y = rng.normal(size=n) + 1e4
    for crowded in (False, True):
        if crowded:
            x[:, 3] = 1e3 + rng.normal(size=n)  # never zero: centred before it is summed
        cells = pa.array([{"at": np.flatnonzero(r).tolist(), "of": r[np.flatnonzero(r)].tolist()} for r in x], pa.struct([("at", pa.list_(pa.int32())), ("of", pa.list_(pa.float64()))]))
        monkeypatch.setattr(gram.Moments, "of", gram.Moments.of if crowded else lambda x: pytest.fail("filled up"))
        got = gram.sparse_moments(cells, y, d)
        monkeypatch.undo()
        want = gram.Moments.of(np.column_stack([x, y]))
        assert got.n == n and np.allclose(got.i, want.i, rtol=1e-12) and np.allclose(got.m, want.m, rtol=1e-9, atol=1e-7)
