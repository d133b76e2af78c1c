"""Wide feature statistics against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coobs.plans import vectors

WIDTH = 3000


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    n = 240
    x = rng.normal(size=(n, WIDTH)) + 100 * (np.arange(WIDTH) % 2)
    x[:, 5] = 2.0  # constant
    y = x[:, 17] - 2 * x[:, 2900] + 0.1 * rng.normal(size=n)
    x[rng.random(x.shape) < 0.01] = np.nan
    fold, group = np.arange(n) % 3, np.where(np.arange(n) % 5 < 3, "a", "b")
    rows = [(i, str(g), int(k), float(v), [None if np.isnan(e) else float(e) for e in r]) for i, (g, k, v, r) in enumerate(zip(group, fold, y, x))]
    df = spark.createDataFrame(rows, "id int, property string, fold int, value double, x array<double>").repartition(6)
    return df, x, y, fold, group


def test_screen(table, monkeypatch):
    df, x, y, fold, group = table
    monkeypatch.setattr(vectors, "HELD", 1)
    got = {}
    for r in vectors.screen_vectors(df, F.col("x"), F.col("value"), "property", 7).collect():
        got.setdefault((r["property"], r["fold"]), []).append((r["rank"], r["feature"], r["abs_corr"]))
    for g in "ab":
        for k in range(3):
            mine = (group == g) & (fold != k)
            corr = np.zeros(WIDTH)
            for j in range(WIDTH):
                known = ~np.isnan(x[mine, j])
                a, b = x[mine, j][known], y[mine][known]
                corr[j] = abs(np.corrcoef(a, b)[0, 1]) if a.std() > 1e-9 else 0.0
            best = np.lexsort((np.arange(WIDTH), -corr))[:7]
            rows = sorted(got[g, k])
            assert [r[1] for r in rows] == best.tolist()
            assert [r[2] for r in rows] == pytest.approx(corr[best], rel=1e-9)


@pytest.mark.parametrize("room", [vectors.BROADCAST, 0])
def test_standardise(table, monkeypatch, room):
    df, x, _, fold, _ = table
    monkeypatch.setattr(vectors, "BROADCAST", room)
    out = vectors.standardise_vectors(df.select("id", "fold", "x"), "x", WIDTH, 3)
    assert out.columns == ["id", "fold", "x", "z"]
    for r in out.where("id % 40 = 1").collect():
        others = x[fold != r["fold"]]
        z = np.clip((x[r["id"]] - np.nanmean(others, axis=0)) / np.nanstd(others, axis=0), -10, 10)
        z[5] = np.nan
        mine = np.array([np.nan if v is None else v for v in r["z"]])
        assert np.allclose(mine, z, atol=1e-8, equal_nan=True)


def test_no_rows(table):
    df, *_ = table
    assert vectors.screen_vectors(df.limit(0), F.col("x"), F.col("value"), "property", 3).count() == 0
    assert vectors.standardise_vectors(df.limit(0), "x", WIDTH, 3).count() == 0


@pytest.mark.parametrize("room", [vectors.BROADCAST, 0])
def test_rows_without_features_or_fold(spark, monkeypatch, room):
    monkeypatch.setattr(vectors, "BROADCAST", room)
    rows = [(0, 0, [1.0, 2.0]), (1, 1, [3.0, None]), (2, 1, [5.0, 8.0]), (3, 0, None), (4, 0, [7.0, 4.0]), (5, None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id int, fold int, x array<double>").repartition(2)
    got = {r["id"]: r["z"] for r in vectors.standardise_vectors(df.where("fold IS NOT NULL"), "x", 2, 2).collect()}
    assert got == {0: [-3.0, None], 1: [-1 / 3, None], 2: [1 / 3, 5.0], 3: None, 4: [3.0, None]}


def test_features_are_computed_once_a_pass(spark):
    """A filter on the array would compute it a second time, and means beside every row would travel with it."""
    costly = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.col("id") * j + F.lit(0.5))
    df = spark.range(6).select("id", (F.col("id") % 2).cast("int").alias("fold")).withColumn("x", costly)
    for out in (vectors.leave_fold_out_vectors(df, F.col("x")), vectors.standardise_vectors(df, "x", 4, 2)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("transform(") == 1
