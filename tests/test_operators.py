"""Guards with negative controls, ridge paths against numpy, nearest neighbours against
brute force, missing values and writers."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from coobs.functions.numeric import clip, finite
from coobs.functions.text import canonical_text, compact_key
from coobs.operators import corpus, ensemble as E, models, relations as R, score, tables
from coobs.operators.lineage import Lineage, leak_report
from coobs.plans import ridge
from coobs.session import cut_lineage, discard, scratch_path
from coobs.sources import readers, sinks

LABELS = "entity string, property string, value double"


def frame(spark, rows, schema=LABELS):
    return spark.createDataFrame(rows, schema)


# -- guards ------------------------------------------------------------------------


def test_domain_check_names_the_offender(spark):
    df = frame(spark, [("a", "Tg", 1.0)])
    assert tables.foreign_properties(df, ["tg"]).collect()[0]["property"] == "Tg"
    with pytest.raises(Exception, match="unexpected property Tg"):
        tables.assert_domain(df, ["tg"]).collect()
    with pytest.raises(ValueError, match="missing columns"):
        readers.labelled(df, ["tg"])


def test_leak_is_real_and_guards_remove_it(spark):
    train = frame(spark, [("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0), ("c", "y", 4.0)])
    block = tables.partner_block(train, train, ["x", "y"])
    reg = Lineage().add_partners(["x", "y"], {"x": -9.0, "y": -9.0})
    rep = {r["property"]: r for r in leak_report(block, reg, ["x", "y"]).collect()}
    assert all(r["leak_exists"] and r["column_guard"] and r["row_guard"] for r in rep.values())
    # negative control: a registry that forgot a column leaves the leak in place
    blind = Lineage().add("true_x", {"y"}, -9.0).add("true_y", {"y"}, -9.0)
    bad = {r["property"]: r for r in leak_report(block, blind, ["x", "y"]).collect()}
    assert not bad["x"]["row_guard"]


def test_lineage_passes_through_predictions():
    reg = Lineage().add_partners(["x", "y"], {})
    reg.derive("pred_z", ["true_x"], labels=["z"]).derive("blend", ["pred_z", "true_y"])
    assert reg.uses["blend"] == {"x", "y", "z"}
    assert "blend" in reg.leaky("z") and "pred_z" in reg.leaky("x")


def test_missing_values(spark):
    df = spark.createDataFrame(
        [(float("nan"),), (float("inf"),), (None,), (2.0,)], "v double"
    ).select(finite(F.col("v")).alias("f"), clip(finite(F.col("v")), F.lit(0.0), F.lit(1.0)).alias("c"))
    assert [tuple(r) for r in df.collect()] == [(None, None), (None, None), (None, None), (2.0, 1.0)]


def test_keys_are_idempotent(spark):
    df = spark.createDataFrame([(" A  b,C!",), ("...",), ("",), ("Éa\n b",)], "s string")
    for key in (canonical_text, compact_key):
        assert df.where(key(key(F.col("s"))) != key(F.col("s"))).count() == 0


def test_scores(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1.0), ("a", 3.0, 3.0), ("b", 2.0, 5.0), ("b", 2.0, 1.0)], "property string, value double, pred double"
    )
    got = {r["property"]: r["r2"] for r in score.r2_by(df, ["property"]).collect()}
    assert got == {"a": 1.0, "b": None}
    with pytest.raises(Exception, match="nothing was scored"):
        score.macro_r2(score.r2_by(df.where("1 = 0"), ["property"])).collect()


def test_blend_keeps_uncovered_rows_and_zero_weight_is_identity(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, None)], "m double, e double")
    b = lambda w: [r[0] for r in df.select(R.blend(F.col("m"), F.col("e"), F.lit(w))).collect()]
    assert b(0.0) == [1.0, 1.0] and b(1.0) == [3.0, 1.0]


def test_operators_on_empty_tables(spark):
    empty = frame(spark, [])
    assert tables.wide(empty, ["x"]).count() == 0
    assert tables.reconcile(empty.withColumn("raw", F.lit("r"))).count() == 0
    assert tables.partner_block(empty, empty, ["x"]).count() == 0


# -- writers -----------------------------------------------------------------------


def test_output_is_checked_before_it_is_written(spark):
    test = spark.createDataFrame([(1,), (2,)], "id long")
    good = spark.createDataFrame([(1, 0.5), (2, 0.7)], "id long, target double")
    assert sinks.write_output(good, test, scratch_path(spark, "o")).count() == 2
    for rows in ([(1, 0.5)], [(1, 0.5), (2, None)], [(1, 0.5), (2, 1.0), (2, 1.0)], [(1, 0.5), (3, 1.0)]):
        with pytest.raises(sinks.OutputRejected):
            bad = spark.createDataFrame(rows, "id long, target double")
            sinks.write_output(bad, test, scratch_path(spark, "o"))


def test_failed_stage_is_not_reused(spark):
    root = scratch_path(spark, "st")
    fail = lambda: spark.range(3).select(F.raise_error(F.lit("boom")).alias("x"))
    with pytest.raises(Exception, match="boom"):
        sinks.run_stage(spark, root, "s", {"a": 1}, fail)
    df, reused = sinks.run_stage(spark, root, "s", {"a": 1}, lambda: spark.range(3))
    assert (df.count(), reused) == (3, False)


def test_archive_falls_back_to_empty(spark):
    got = readers.adopt_archive(spark, [("bad", lambda: spark.range(2).toDF("z"))], ["tg"])
    assert not got.ok and got.source == "none" and got.table.count() == 0


# -- ridge paths -------------------------------------------------------------------


def numpy_ridge(x, y, alpha, standardise=False):
    mu, sd = x.mean(0), x.std(0) if standardise else np.ones(x.shape[1])
    z = (x - mu) / sd
    coef = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return y.mean() - coef @ mu, coef


def test_moments_of_many_columns_are_one_product_per_batch(spark):
    """The same moments as the SQL aggregates, without one of these per pair of columns; nulls, NaN and null keys included."""
    rng = np.random.default_rng(2)
    cols = [f"x{i}" for i in range(ridge.BLOCK_COLUMNS)]
    x = (rng.normal(size=(300, len(cols) + 1)) + 1e4).tolist()
    x[7][2] = x[8][0] = None
    rows = [(None if i % 5 == 0 else f"p{i % 5}", i % 3, *r) for i, r in enumerate(x)]
    rows += [("empty", 0, *[None] * (len(cols) + 1)), ("nan", 0, *[float("nan")] * (len(cols) + 1))]
    df = spark.createDataFrame(rows, "property string, fold int, " + ", ".join(f"{c} double" for c in [*cols, "y"])).repartition(3)
    got = ridge.moment_cells(df, ["property", "fold"], cols, "y")
    assert "covar_pop" not in got._jdf.queryExecution().toString()
    want = ridge.fold_moments(df, ["property", "fold"], [*cols, "y"])
    assert got.dtypes == want.dtypes
    order = lambda d: d.toPandas().fillna({"property": "-"}).sort_values(["property", "fold"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), rtol=1e-9, atol=1e-7)


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(0)
    n = 240
    x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + [5, -100, 0]
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["entity"] = [f"e{i}" for i in range(n)]
    pdf["property"] = np.where(np.arange(n) % 3 == 0, "p", "q")
    pdf["fold"] = (np.arange(n) // 3 % 4).astype(np.int32)
    pdf["value"] = x @ [1.0, 0.2, -3.0] + rng.normal(size=n)
    return pdf, spark.createDataFrame(pdf).withColumn("fold", F.col("fold").cast("int"))


@pytest.mark.parametrize("standardise", [False, True])
def test_moment_ridge_equals_numpy(linear, standardise):
    pdf, df = linear
    feats = ["a", "b", "c"]
    cells_pdf = ridge.moment_cells(df.withColumn("y", F.col("value")), ["property", "fold"], feats, "y").toPandas()
    for p in ("p", "q"):
        mine = cells_pdf[cells_pdf.property == p].reset_index(drop=True)
        cells = ridge.Cells(mine, feats, "y")
        for k in range(4):
            b0, b = ridge.solve(cells.pool(mine.fold.to_numpy() != k), 2.0, standardise)
            part = pdf[(pdf.property == p) & (pdf.fold != k)]
            w0, w = numpy_ridge(part[feats].to_numpy(), part.value.to_numpy(), 2.0, standardise)
            assert b0 == pytest.approx(w0, rel=1e-8) and b == pytest.approx(w, rel=1e-8)
            held = pdf[(pdf.property == p) & (pdf.fold == k)]
            err = ((held.value - w0 - held[feats].to_numpy() @ w) ** 2).sum()
            assert ridge.sse(cells.pool(mine.fold.to_numpy() == k), b0, b) == pytest.approx(err, rel=1e-8)


def test_ridge_oof_and_fold_average(linear):
    pdf, df = linear
    feats = ["a", "b", "c"]
    oof, tested = models.oof_and_test(df, df, feats)
    got = oof.toPandas().set_index("entity").pred
    avg = tested.toPandas().set_index("entity").pred
    for p in ("p", "q"):
        fits = []
        for k in range(4):
            tr = pdf[(pdf.property == p) & (pdf.fold != k)]
            w0, w = numpy_ridge(tr[feats].to_numpy(), tr.value.to_numpy(), 1.0, True)
            va = pdf[(pdf.property == p) & (pdf.fold == k)]
            assert got[va.entity].to_numpy() == pytest.approx(w0 + va[feats].to_numpy() @ w, rel=1e-8)
            mine = pdf[pdf.property == p]
            fits.append(w0 + mine[feats].to_numpy() @ w)
        assert avg[mine.entity].to_numpy() == pytest.approx(np.mean(fits, 0), rel=1e-8)


def test_nested_feature_never_sees_the_row(linear):
    """Each value equals an explicit refit without the outer fold and the inner fold."""
    pdf, df = linear
    feats = ["a", "b"]
    out = E.nested_feature(df, feats, outer=1).withColumn("inner", E.inner_fold(E.INNER_FOLDS, 0)).toPandas()
    for p in ("p", "q"):
        mine = out[out.property == p]
        for j in [-1, *sorted(mine.inner.unique())]:
            train = mine[(mine.fold != 1) & ((mine.inner != j) if j >= 0 else True)]
            rows = mine[(mine.fold != 1) & (mine.inner == j)] if j >= 0 else mine[mine.fold == 1]
            stats = (len(train), *_stats(train[feats + ["value"]].to_numpy()))
            a = ridge.gcv_alpha(stats, E.PARTNER_ALPHAS)
            w0, w = numpy_ridge(train[feats].to_numpy(), train.value.to_numpy(), a)
            assert rows.ridge_feature.to_numpy() == pytest.approx(w0 + rows[feats].to_numpy() @ w, rel=1e-7)


def _stats(m):
    d = m - m.mean(0)
    return m.mean(0), d.T @ d


def test_gcv_is_mean_leverage_loo(linear):
    pdf, _ = linear
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf.value.to_numpy()
    scores = {}
    for a in E.PARTNER_ALPHAS:
        w0, w = numpy_ridge(x, y, a)
        z = x - x.mean(0)
        h = 1 / len(y) + np.einsum("ij,jk,ik->i", z, np.linalg.inv(z.T @ z + a * np.eye(3)), z)
        scores[a] = ((y - w0 - x @ w) ** 2).sum() / (1 - h.mean()) ** 2
    m = pdf[["a", "b", "c", "value"]].to_numpy()
    assert ridge.gcv_alpha((len(m), *_stats(m)), E.PARTNER_ALPHAS) == min(scores, key=scores.get)


def test_few_candidates_go_to_the_rows(linear, monkeypatch):
    """No row is shuffled for its leverage unless the candidates are many; both ways give the same sums."""
    pdf, df = linear
    df = df.withColumn("a", F.when(F.col("entity") != "e3", F.col("a")))
    feats = ["a", "b", "c"]
    candidates = E.ridge_candidates(df, feats, min_train=5)
    near = E.leave_one_out(df, candidates, feats)
    assert "CoGroup" not in near._jdf.queryExecution().toString()
    monkeypatch.setattr(E, "LEVERAGE_BYTES", 0)
    monkeypatch.setattr(E, "LEVERAGE_ROWS", 11)
    far = E.leave_one_out(df, candidates, feats)
    assert "CoGroup" in far._jdf.queryExecution().toString()
    got, want = ({(r["property"], r["fold"], r["alpha"]): r["loo"] for r in d.collect()} for d in (near, far))
    assert len(got) == 2 * 5 * 4 and got == pytest.approx(want, rel=1e-9)


def test_leave_one_out_equals_refits(linear, monkeypatch):
    """Every row left out and the ridge fitted anew, for all penalties and folds."""
    monkeypatch.setattr(E, "LEVERAGE_ROWS", 11)
    pdf, df = linear
    feats = ["a", "b", "c"]
    candidates = E.ridge_candidates(df, feats, min_train=5)
    got = {(r["property"], r["fold"], r["alpha"]): r["loo"] for r in E.leave_one_out(df, candidates, feats).collect()}
    picked = {(r["property"], r["fold"]): r for r in E.ridge_fits(df, feats, min_train=5).collect()}
    for p in ("p", "q"):
        for k in [-1, *sorted(pdf.fold.unique())]:
            train = pdf[(pdf.property == p) & (pdf.fold != k)]
            x, y = train[feats].to_numpy(), train.value.to_numpy()
            errors = {}
            for a in E.PARTNER_ALPHAS:
                errors[a] = 0.0
                for i in range(len(y)):
                    w0, w = numpy_ridge(np.delete(x, i, 0), np.delete(y, i), a)
                    errors[a] += (y[i] - w0 - x[i] @ w) ** 2
                assert got[p, k, a] == pytest.approx(errors[a], rel=1e-6)
            best = min(errors, key=errors.get)
            w0, w = numpy_ridge(x, y, best)
            assert picked[p, k]["alpha"] == best and picked[p, k]["coef"] == pytest.approx(w, rel=1e-7)


def test_stack_falls_back_to_the_mean(linear):
    pdf, df = linear
    m = df.select("entity", "property", "value", "fold", F.col("value").alias("m1"), (F.col("value") + 4).alias("m2"))
    two = E.stack(E.with_mean_spread(m, ["m1", "m2"]), ["m1", "m2"])
    assert {r["picked"] for r in two.select("picked").distinct().collect()} == {"mean"}
    three = E.with_mean_spread(m.withColumn("m3", F.col("value") * 0 + 1), ["m1", "m2", "m3"])
    out = E.stack(three, ["m1", "m2", "m3"])
    assert {r["picked"] for r in out.select("picked").distinct().collect()} == {"ridge"}
    assert out.agg(F.max(F.abs(F.col("stacked") - F.col("value")))).first()[0] < 0.5


def test_refinement_never_moves_measured_cells(spark):
    rows = [(f"e{i}", float(i), 2.0 * i + (i % 5), True, i % 2 == 0) for i in range(80)]
    fr = spark.createDataFrame(rows, "entity string, x double, y double, is_x boolean, is_y boolean")
    cat = [R.Relation("y", ("x",), lambda x: 2 * x)]
    out = {r["entity"]: r for r in R.refine_cells(fr, cat, ["x", "y"], rounds=2).collect()}
    for e, x, y, _, known in rows:
        assert out[e]["x"] == x
        assert (out[e]["y"] == y) or not known


# -- sinks -------------------------------------------------------------------------


def test_rejected_output_leaves_the_old_one(spark):
    test = spark.createDataFrame([(1,), (2,)], "id long")
    path = scratch_path(spark, "out")
    calls = spark.sparkContext.accumulator(0)

    def table(rows):
        def touch(batches):
            for b in batches:
                calls.add(b.num_rows)
                yield b

        return spark.createDataFrame(rows, "id long, target double").coalesce(1).mapInArrow(touch, "id long, target double")

    sinks.write_output(table([(1, 0.5), (2, 1.5)]), test, path)
    assert calls.value == 2  # what was checked is what is written
    for bad in ([(1, 9.0)], [(1, 9.0), (2, 9.0), (3, 9.0)], [(1, 9.0), (2, 9.0), (2, 9.0)], [(1, 9.0), (2, float("nan"))], [(1, 9.0), (2, None)], []):
        with pytest.raises(sinks.OutputRejected):
            sinks.write_output(table(bad), test, path)
        assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 0.5), (2, 1.5)]
    sinks.write_output(table([(2, 3.0), (1, 2.0)]), test, path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, 2.0), (2, 3.0)]
    folder = os.path.dirname(path)
    assert not [f for f in os.listdir(folder) if f.startswith(os.path.basename(path)) and f != os.path.basename(path)]


def test_prediction_store_replaces_only_the_models_written(spark):
    path = scratch_path(spark, "preds")
    table = lambda model, *preds: spark.createDataFrame([(i, p, model) for i, p in enumerate(preds)], "id int, pred double, model string")
    sinks.write_predictions(table("a", 1.0, 2.0), path)
    sinks.write_predictions(table("b", 3.0), path)
    for _ in range(2):
        store = sinks.write_predictions(table("a", 5.0), path)
        assert sorted((r["model"], r["pred"]) for r in store.collect()) == [("a", 5.0), ("b", 3.0)]


def test_prediction_store_does_not_sort_its_rows(spark, monkeypatch):
    """A sort by model holds a task's rows; a task of more models than it keeps open loses none of them."""
    rows = spark.range(0, 3000, 1, 2).selectExpr("id", "cast(id as double) AS pred", "concat('m', id % 6) AS model")
    monkeypatch.setattr(sinks, "OPEN_MODELS", 2)
    path = scratch_path(spark, "preds")
    store = sinks.write_predictions(rows, path)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    write = [p for p in plans if "InsertIntoHadoopFsRelationCommand" in p and path.rsplit("/", 1)[1] in p]
    assert len(write) == 1 and "Sort" not in write[0]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    assert sorted(map(tuple, store.select("id", "pred", "model").collect())) == sorted(map(tuple, rows.collect()))


# -- nearest neighbours ------------------------------------------------------------


@pytest.mark.parametrize(("growth", "step"), [(16, 1.25), (2, 1.05)])
def test_knn_equals_brute_force_with_copies_and_hot_shingles(spark, monkeypatch, growth, step):
    """A third of the rows are copies, one shingle is everywhere, some rows are empty."""
    monkeypatch.setattr(corpus, "RARE_POSTINGS", 3)
    monkeypatch.setattr(corpus, "ROUND_GROWTH", growth)
    monkeypatch.setattr(corpus, "SIZE_STEP", step)
    rng = np.random.default_rng(3)
    sets = []
    for i in range(60):
        if i % 3 == 0:
            sets.append(["s0", "s1", "s2", "c"])
        elif i == 1:
            sets.append([])
        else:
            sets.append(sorted({"s0", *(f"s{j}" for j in rng.integers(0, 30, 6))}))
    train = [(i, s, float(i % 7)) for i, s in enumerate(sets[:40])]
    asked = [(100 + i, s) for i, s in enumerate(sets[30:])]
    tr = spark.createDataFrame(train, "entity long, shingles array<string>, value double")
    qu = spark.createDataFrame(asked, "entity long, shingles array<string>")
    rounds: list = []
    nn = corpus.knn_jaccard(tr, qu, report=rounds)
    assert len(rounds) > (2 if growth == 2 else 1)
    got = {}
    for r in nn.collect():
        got.setdefault(r["entity"], []).append((r["rank"], r["neighbour"], round(r["sim"], 9)))
    k = int(np.clip(round(len(train) ** 0.4), 3, 25))
    for q, s in asked:
        sims = [(len(set(s) & set(t)) / max(len(set(s) | set(t)), 1), i) for i, t, _ in train]
        best = sorted(sims, key=lambda x: (-x[0], x[1]))[:k]
        assert sorted(got[q]) == [(n + 1, i, round(v, 9)) for n, (v, i) in enumerate(best)]


def test_knn_meets_part_by_part_and_leaves_no_tables(spark, monkeypatch):
    """Pairs on disk stay near the limit though every query shares shingles with every training set; what no step reads any more is gone."""
    monkeypatch.setattr(corpus, "PAIRS", 10)
    rng = np.random.default_rng(8)
    sets = [sorted({"s0", "s1", *(f"u{j}" for j in rng.integers(0, 400, 1 + i % 5))}) for i in range(240)]
    train = [(i, s, float(i)) for i, s in enumerate(sets[:160])]
    asked = [(1000 + i, s) for i, s in enumerate(sets[160:])]
    seen, write = [], corpus.cut_lineage

    def kept(df, name="stage"):
        out = write(df, name)
        seen.append((name, out.count() if name == "knn_met" else 0, out.inputFiles()))
        return out

    monkeypatch.setattr(corpus, "cut_lineage", kept)
    rounds: list = []
    nn = corpus.knn_jaccard(
        spark.createDataFrame(train, "entity long, shingles array<string>, value double"),
        spark.createDataFrame(asked, "entity long, shingles array<string>"), report=rounds,
    )
    got = {}
    for r in nn.collect():
        got.setdefault(r["entity"], []).append((r["rank"], r["neighbour"], round(r["sim"], 9)))
    k = int(np.clip(round(len(train) ** 0.4), 3, 25))
    for q, s in asked:
        sims = sorted(((len(set(s) & set(t)) / len(set(s) | set(t)), i) for i, t, _ in train), key=lambda x: (-x[0], x[1]))[:k]
        assert sorted(got[q]) == [(n + 1, i, round(v, 9)) for n, (v, i) in enumerate(sims)]
    met = [n for name, n, _ in seen if name == "knn_met"]
    postings = sum(len(set(s)) for _, s, _ in train)
    assert len(met) > len(rounds) and max(met) <= 4 * postings < sum(met)
    gone = {name for name, _, files in seen if files and not any(os.path.exists(f.removeprefix("file://")) for f in files)}
    assert {"knn_rows", "knn_sets", "knn_posted", "knn_queries", "knn_met", "knn_open", "knn_info"} <= gone


def test_discard_deletes_written_tables_only(spark, tmp_path):
    kept, gone = cut_lineage(spark.range(3), "a"), cut_lineage(spark.range(4), "a")
    discard(gone)
    assert kept.count() == 3 and not any(os.path.exists(f.removeprefix("file://")) for f in gone.inputFiles())
    spark.range(5).write.parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError):
        discard(spark.read.parquet(str(tmp_path / "x")))


def test_growing_tables_are_never_broadcast(spark):
    a, b = (spark.range(5).withColumnRenamed("id", "k") for _ in range(2))
    met = corpus._meet(a, b, ["k"])
    assert met.count() == 5
    assert "Broadcast" not in met._jdf.queryExecution().toString()


# -- streams -----------------------------------------------------------------------


def test_stateless_operators_run_on_a_stream(spark):
    path = scratch_path(spark, "in")
    preds = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0)], "entity string, property string, pred double")
    preds.write.parquet(path)
    labels = frame(spark, [("a", "x", 9.0)])
    stream = tables.override(spark.readStream.schema(preds.schema).parquet(path), labels)
    query = stream.writeStream.format("memory").queryName("overridden").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {r["entity"]: (r["pred"], r["source"]) for r in spark.table("overridden").collect()}
    assert got == {"a": (9.0, "measured"), "b": (2.0, "model")}


def test_partner_frame_shuffles_entities_not_cells(spark):
    pool = spark.createDataFrame([("a", "p", 1.0), ("a", "p", 3.0), ("b", "q", 5.0), ("b", "z", 9.0)], "entity string, property string, value double")
    guess = spark.createDataFrame([("a", "p", 7.0), ("a", "q", 8.0), ("x", "p", 1.0)], "entity string, property string, pred double")
    ents = spark.createDataFrame([("a",), ("b",), ("c",)], "entity string")
    out = R.partner_frame(pool, ents, guess, ["p", "q"])
    got = {(r.entity, r.property): (r.value, r.is_true) for r in out.collect()}
    none = (None, False)
    assert got == {("a", "p"): (2.0, True), ("a", "q"): (8.0, False), ("b", "p"): none, ("b", "q"): (5.0, True), ("c", "p"): none, ("c", "q"): none}
    plan = R.frame_wide(out, ["p", "q"])._jdf.queryExecution().executedPlan().toString()
    assert "property" not in " ".join(line for line in plan.splitlines() if "hashpartitioning" in line)
