"""Tree ensembles against exhaustive search, and the jobs that fit and apply them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coobs import ENTITY, PROPERTY, VALUE
from coobs.operators import models
from coobs.plans import trees


def best_cut(x, y, leaf):
    """Least squared error of one cut, over all features and places."""
    best = ((y - y.mean()) ** 2).sum()
    for j in range(x.shape[1]):
        for t in np.unique(x[:, j])[:-1]:
            a, b = y[x[:, j] <= t], y[x[:, j] > t]
            if min(len(a), len(b)) >= leaf:
                best = min(best, ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum())
    return best


def predict(ensemble, x):
    return sum(trees.applied(b, x) for b in ensemble.blobs())


@pytest.mark.parametrize("leaf", [1, 7])
def test_a_stump_is_the_best_cut(leaf):
    rng = np.random.default_rng(leaf)
    x = np.column_stack([rng.integers(0, 9, 80), rng.normal(size=80)]).astype(float)
    y = rng.normal(size=80) + 3 * (x[:, 1] > 0.3)
    made = trees.boosted(x, y, 1, 1, leaf, 1.0, 1.0, 0)
    assert ((predict(made, x) - y) ** 2).sum() == pytest.approx(best_cut(x, y, leaf), rel=1e-5)


def test_boosting_and_forest_learn(monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, (900, 3))
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2
    fresh = rng.uniform(-2, 2, (400, 3))
    want = np.sin(2 * fresh[:, 0]) + fresh[:, 1] ** 2
    for kind in ("gbt", "forest"):
        made = trees.fitted(kind, x, y, 3)
        assert len(made.roots) == {"gbt": trees.BOOSTED["mid"][0], "forest": trees.FOREST["mid"][0]}[kind]
        got = predict(made, fresh)
        assert 1 - ((got - want) ** 2).mean() / want.var() > 0.9
        again = trees.fitted(kind, x, y, 3)
        assert (predict(again, fresh) == got).all()
        monkeypatch.setattr(trees, "PART_NODES", 5000)
        assert len(made.blobs()) > 1 and np.allclose(predict(made, fresh), got, atol=1e-5)
        monkeypatch.undo()
    # every row is a leaf of its own and all rows teach, so a forest knows its rows
    assert np.allclose(predict(trees.forest(x, y, 5, 1, 0.3, 1), x), y, atol=1e-5)


@pytest.mark.parametrize("n", [100, 700, 1600])
def test_capacity_follows_the_rows(n):
    t = trees.tier(n)
    assert t == {100: "small", 700: "mid", 1600: "large"}[n]
    assert trees.BOOSTED[t][0] >= 900 and trees.FOREST[t][0] == 600


def test_constants():
    x = np.arange(8.0)[:, None]
    assert (predict(trees.fitted("gbt", x[:4], x[:4, 0], 1), x) == 1.5).all()
    assert (predict(trees.fitted("forest", x, np.full(8, 2.0), 1), x) == 2.0).all()


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for p in ("a", "b", "flat"):
        for i in range(90):
            f, g = float(rng.integers(0, 12)), float(rng.normal())
            out.append((f"e{i}", p, 7.0 if p == "flat" else f * (2 if p == "a" else -1) + g, i % 3, f, None if i == 5 else g))
    return spark.createDataFrame(out, f"{ENTITY} string, {PROPERTY} string, {VALUE} double, fold int, f double, g double")


def test_out_of_fold_and_test_predictions(spark, rows, monkeypatch):
    monkeypatch.setattr(trees, "ASK_ROWS", 7)  # several salts per group
    monkeypatch.setattr(trees, "BOOSTED", {"small": (40, 3, 2)})
    test = rows.where("fold = 0").drop(VALUE, "fold")
    got = models.per_property_oof(rows, test, ["f", "g"], ["a", "b", "flat"], folds=3)
    assert got.groupBy("split").count().where("split = 'oof'").first()["count"] == 270
    pdf = rows.fillna(0.0, subset=["f", "g"]).toPandas()
    found = {(r[ENTITY], r[PROPERTY], r["split"]): r["pred"] for r in got.collect()}
    import zlib

    for p in ("a", "b", "flat"):
        mine = pdf[pdf[PROPERTY] == p]
        fold_preds = []
        for k in range(3):
            t = mine[mine["fold"] != k].sort_values([ENTITY, PROPERTY, VALUE, "f", "g"], kind="stable")
            fit = trees.fitted("gbt", t[["f", "g"]].to_numpy(), t[VALUE].to_numpy(), zlib.crc32(f"{p}|{k}|42".encode()))
            held = mine[mine["fold"] == k]
            for e, v in zip(held[ENTITY], predict(fit, held[["f", "g"]].to_numpy())):
                assert found[e, p, "oof"] == pytest.approx(v, abs=1e-9)
            fold_preds.append(predict(fit, mine[mine["fold"] == 0][["f", "g"]].to_numpy()))
        for e, v in zip(mine[mine["fold"] == 0][ENTITY], np.mean(fold_preds, axis=0)):
            assert found[e, p, "test"] == pytest.approx(v, abs=1e-9)
    assert {v for (e, p, s), v in found.items() if p == "flat"} == {7.0}


def test_taught_rows_are_bounded(rows):
    few = models.bounded_sample(rows, [ENTITY, PROPERTY], 20, 1)
    assert {r["count"] for r in few.groupBy(PROPERTY).count().collect()} == {20}
    assert sorted(few.collect()) == sorted(models.bounded_sample(rows.repartition(5), [ENTITY, PROPERTY], 20, 1).collect())


def test_the_chosen_learner_is_the_one_that_stacks(spark):
    rng = np.random.default_rng(6)
    out = []
    for p in ("line", "step"):
        for i in range(240):
            m1, m2 = rng.normal(size=2)
            y = m1 + 0.5 * m2 if p == "line" else 4.0 * (m1 > 0) * (m2 > 0)
            out.append((f"e{i}", p, float(y + 0.05 * rng.normal()), i % 3, float(m1), float(m2)))
    df = spark.createDataFrame(out, f"{ENTITY} string, {PROPERTY} string, {VALUE} double, fold int, m1 double, m2 double")
    got = models.chosen_stack(df, ["m1", "m2"], ["line", "step"])
    pdf = got.join(df, [ENTITY, PROPERTY, "fold"]).toPandas()
    assert len(pdf) == 480
    assert set(pdf[pdf[PROPERTY] == "line"]["meta"]) == {"ridge"} and set(pdf[pdf[PROPERTY] == "step"]["meta"]) == {"trees"}
    assert (pdf["tree_score"] > pdf["ridge_score"]).equals(pdf["meta"] == "trees")
    for k in range(3):  # the ridge of an outer fold saw none of its rows
        line = pdf[pdf[PROPERTY] == "line"]
        t, v = line[line["fold"] != k], line[line["fold"] == k]
        x, mean, sd = t[["m1", "m2"]].to_numpy(), t[["m1", "m2"]].to_numpy().mean(0), t[["m1", "m2"]].to_numpy().std(0)
        z = (x - mean) / sd
        fits = [np.linalg.solve(z.T @ z + a * np.eye(2), z.T @ (t[VALUE] - t[VALUE].mean())) for a in (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)]
        preds = [t[VALUE].mean() + (v[["m1", "m2"]].to_numpy() - mean) / sd @ b for b in fits]
        assert min(np.abs(q - v["stacked"]).max() for q in preds) < 1e-9
    for p, g in pdf.groupby(PROPERTY):
        assert 1 - ((g[VALUE] - g["stacked"]) ** 2).mean() / g[VALUE].var() > 0.9
    assert models.chosen_stack(df.limit(0), ["m1", "m2"], ["line"]).count() == 0


def test_equal_rows_are_walked_once_over_all_tasks(spark, monkeypatch):
    """What reaches the ensembles does not grow with copies of a row; nulls and minus zero find their values too."""
    x = [(0.0, 1.0), (-0.0, 1.0), (2.0, None), (5.0, 3.0)]
    teach = spark.createDataFrame([("g", i, float(i % 7), float(i % 5), float(i % 7 > 3)) for i in range(60)], "g string, id int, a double, b double, y double")
    fits = trees.fit_trees(teach, ["g"], ["a", "b"], "y", ["id"], "meta", 1).cache()
    asks = spark.createDataFrame([(g, i, *x[i % 4]) for i in range(400) for g in ("g", "none")], "g string, id int, a double, b double").repartition(9)
    walked = spark.sparkContext.accumulator(0)
    apply = trees.applied

    def counted(blob, rows):
        walked.add(len(rows))
        return apply(blob, rows)

    monkeypatch.setattr(trees, "applied", counted)
    got = trees.predict_trees(asks, fits, ["g"], ["a", "b"], ["g", "id"], 2).collect()
    assert len(got) == 800 and walked.value == 3
    want = np.array([[v if v is not None else float("nan") for v in r] for r in x])
    values = apply(fits.first()["model"], want)
    assert all(r["pred"] == (values[r["id"] % 4] if r["g"] == "g" else 0.0) for r in got)


def repeated(spark, n=3000, seed=4):
    """Many rows of few combinations of features, with noise that only all rows together average out."""
    rng = np.random.default_rng(seed)
    out = []
    for p in ("a", "b"):
        for i in range(n):
            f, g = float(rng.integers(0, 6)), float(rng.integers(0, 4))
            out.append((f"e{i}", p, (f - 2) * g + float(rng.normal(0, 5)), i % 3, i % 2, f, g))
    return spark.createDataFrame(out, f"{ENTITY} string, {PROPERTY} string, {VALUE} double, fold int, inner int, f double, g double")


@pytest.mark.parametrize("kind", ["meta", "forest"])
def test_cells_teach_what_their_rows_teach(kind):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, (900, 2)).astype(float)
    y = x[:, 0] * x[:, 1] + rng.normal(size=900)
    cells, at = np.unique(x, axis=0, return_inverse=True)
    n = np.bincount(at.reshape(-1)).astype(float)
    mean = np.bincount(at.reshape(-1), y) / n
    assert np.allclose(predict(trees.fitted(kind, cells, mean, 5, n), cells), predict(trees.fitted(kind, x, y, 5), cells), atol=1e-4)


def test_weighted_quantiles_are_those_of_the_rows():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=50), rng.integers(1, 9, 50).astype(float)
    at = np.linspace(0, 1, 31)
    assert np.allclose(trees.quantiles(x, w, at), np.quantile(np.repeat(x, w.astype(int)), at))


@pytest.mark.parametrize("kind", ["gbt", "forest"])
def test_all_rows_of_a_large_property_teach(spark, monkeypatch, kind):
    made, fit = [], models.fit_trees
    monkeypatch.setattr(models, "fit_trees", lambda teach, *a: made.append((teach.cache(), fit(teach, *a).cache())) or made[-1][1])
    rows = repeated(spark)
    got = models.per_property_oof(rows, rows.drop(VALUE, "fold").limit(0), ["f", "g"], ["a", "b"], kind=kind, folds=3, teach_rows=100)
    found = {(r[ENTITY], r[PROPERTY]): r["pred"] for r in got.collect()}
    entries, fits = made[0]
    assert {r["n"] for r in fits.collect()} == {2000}  # two thirds of 3,000 rows
    assert entries.groupBy(PROPERTY, "job").count().agg(F.max("count")).first()[0] <= 6 * 4 * trees.BAGS.get(kind, 1)
    pdf = rows.toPandas()
    off = []
    for (p, k, f, g), mine in pdf.groupby([PROPERTY, "fold", "f", "g"]):
        rest = pdf[(pdf[PROPERTY] == p) & (pdf["fold"] != k) & (pdf["f"] == f) & (pdf["g"] == g)]
        off.append(found[mine[ENTITY].iloc[0], p] - rest[VALUE].mean())
    # the mean of some 80 rows with a spread of 5; 100 sampled rows of a property leave one or two in a cell
    assert np.sqrt(np.mean(np.square(off))) < (0.05 if kind == "forest" else 0.3)


def test_many_combinations_are_cut_at_quantiles_of_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 2))
    y = 3 * x[:, 0] + np.abs(x[:, 1])
    rows = spark.createDataFrame(
        [(f"e{i}", p, float(v), i % 3, float(f), float(g)) for i, ((f, g), v) in enumerate(zip(x, y)) for p in ("a", "b")],
        f"{ENTITY} string, {PROPERTY} string, {VALUE} double, fold int, f double, g double",
    )
    monkeypatch.setattr(trees, "CELL_VALUES", 3000)  # 150 combinations
    made, fit = [], models.fit_trees
    monkeypatch.setattr(models, "fit_trees", lambda teach, *a: made.append(teach.cache()) or fit(teach, *a))
    got = models.per_property_oof(rows, rows.drop(VALUE, "fold").limit(0), ["f", "g"], ["a", "b"], folds=3, teach_rows=100)
    pdf = got.join(rows, [ENTITY, PROPERTY]).toPandas()
    assert len(pdf) == 3000
    seen = made[0].groupBy(PROPERTY, "job").agg(F.sum("n").alias("n"), F.countDistinct("f", "g").alias("v")).collect()
    assert all(r["n"] == 1000 and r["v"] <= 170 for r in seen)
    assert 1 - ((pdf[VALUE] - pdf["pred"]) ** 2).mean() / pdf[VALUE].var() > 0.9


def test_cuts_of_codes_become_cuts_of_values():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2))
    x[0, 0] = np.nan
    edges = [np.quantile(x[1:, 0], [0.2, 0.5, 0.7]), np.quantile(x[:, 1], [0.1, 0.9])]
    codes = np.column_stack([np.where(np.isnan(x[:, j]), 0, np.searchsorted(e, x[:, j], "left")) for j, e in enumerate(edges)]).astype(float)
    for kind in ("gbt", "forest"):
        (blob,) = trees.fitted(kind, codes, x[:, 1] + np.nan_to_num(x[:, 0]) ** 2, 1).blobs()
        assert (trees.applied(trees.moved(blob, edges), x) == trees.applied(blob, codes)).all()


def test_the_stack_is_the_same_by_rows_and_by_cells(spark):
    df = repeated(spark, 900).drop("inner")
    by_rows = models.chosen_stack(df, ["f", "g"], ["a", "b"])
    by_cells = models.chosen_stack(df, ["f", "g"], ["a", "b"], teach_rows=10)
    both = by_rows.join(by_cells.select(ENTITY, PROPERTY, F.col("stacked").alias("s"), F.col("tree_score").alias("t"), F.col("meta").alias("m")), [ENTITY, PROPERTY]).toPandas()
    assert len(both) == 1800 and (both["meta"] == both["m"]).all() and set(both["meta"]) == {"trees"}
    assert np.allclose(both["s"], both["stacked"], atol=1e-4) and np.allclose(both["t"], both["tree_score"], atol=1e-6)
    # rows meet small tables only: none is shuffled, none is multiplied
    assert "hashpartitioning(entity" not in by_cells._jdf.queryExecution().toString() and "Generate" not in by_cells._jdf.queryExecution().toString()
