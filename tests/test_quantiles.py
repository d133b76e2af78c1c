"""Exact quantiles against numpy, with brackets narrowed over several rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coobs.plans import quantiles


def quantile(x, p):
    """Linear interpolation of order statistics; one of them alone is taken as it is."""
    x, at = np.sort(x), p * (len(x) - 1)
    lo, f = int(np.floor(at)), at - np.floor(at)
    return x[lo] if f == 0 or x[lo] == x[lo + 1] else x[lo] + (x[lo + 1] - x[lo]) * f


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    groups = {
        "normal": rng.normal(size=3000),
        "heavy ties": np.where(rng.random(2500) < 0.7, 1.0, rng.normal(size=2500)),
        "one value": np.full(900, 3.5),
        "skewed": rng.lognormal(0, 4, size=2000),
        "few": np.array([2.0, 1.0, 9.0]),
        "single": np.array([4.0]),
        "infinite": np.concatenate([rng.normal(size=800), [np.inf] * 3, [-np.inf] * 2]),
    }
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("normal", None), ("no value", None)]
    return groups, spark.createDataFrame(rows, "g string, v double").repartition(5)


@pytest.mark.parametrize("limit", [50_000, 40, 3])
def test_equal_to_sorting(table, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "SORTED", limit)
    groups, df = table
    wanted = {"min": 0.0, "p01": 0.01, "p50": 0.5, "p90": 0.9, "p999": 0.999, "max": 1.0}
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, ["g"], "v", wanted, len(groups) + 1).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        for name, p in wanted.items():
            assert got[g][name] == pytest.approx(quantile(x, p), rel=1e-12), (g, name)


def test_a_missed_bracket_is_widened(table, monkeypatch):
    monkeypatch.setattr(quantiles, "SORTED", 10)
    monkeypatch.setattr(quantiles, "SKETCH_K", 8)
    monkeypatch.setattr(quantiles, "MARGIN", 0.001)  # far too sure of so small a sketch
    groups, df = table
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, ["g"], "v", {"p50": 0.5}, len(groups) + 1).collect()}
    assert all(got[g]["p50"] == pytest.approx(quantile(x, 0.5), rel=1e-12) for g, x in groups.items())


def test_without_groups_and_without_rows(table):
    groups, df = table
    got = quantiles.exact_quantiles(df.where("g = 'normal'"), [], "v", {"p50": 0.5}, 1).collect()
    assert [r["p50"] for r in got] == [pytest.approx(np.median(groups["normal"]))]
    assert quantiles.exact_quantiles(df.limit(0), ["g"], "v", {"p50": 0.5}, 1).count() == 0
    nan = df.limit(0).sparkSession.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "v double")
    assert [r["m"] for r in quantiles.exact_quantiles(nan, [], "v", {"m": 0.5}, 1).collect()] == [2.0]


def test_values_are_computed_once(spark):
    """The rounds read a written table, not the values' own plan."""
    costly = spark.range(100).select(F.xxhash64("id").cast("double").alias("v"))
    plan = quantiles.exact_quantiles(costly, [], "v", {"m": 0.5}, 1)._jdf.queryExecution().toString()
    assert "xxhash64" not in plan
