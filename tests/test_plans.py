"""Skew-safe plan shapes against brute force, also under other layouts and hot keys."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from coobs.functions import sequences as S
from coobs.operators import folds
from coobs.plans import joins, moments, quantiles, ranking


def skewed(spark, n=4000):
    """A third of all rows under one key."""
    return spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("property"),
        F.concat(F.lit("e"), "id").alias("entity"),
        ((F.col("id") * 7919) % 1009 / 10.0).alias("value"),
    )


def test_hash_rank_is_a_rank_and_layout_independent(spark):
    df = skewed(spark)
    out = {}
    for parts in (1, 17):
        r = ranking.hash_rank(df.repartition(parts), ["entity"], 3, group=["property"], total="n")
        out[parts] = {x["entity"]: (x["rank"], x["n"]) for x in r.collect()}
    assert out[1] == out[17]
    hot = sorted(v[0] for k, v in out[1].items() if int(k[1:]) % 3 == 0)
    assert hot == list(range(len(hot)))


def test_folds_balanced_and_grouped_folds_do_not_straddle(spark):
    sizes = folds.property_folds(skewed(spark), k=7).groupBy("property", "fold").count().collect()
    per = {}
    for r in sizes:
        per.setdefault(r["property"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in per.values())
    rows = skewed(spark).withColumn("entity", F.concat(F.lit("g"), F.col("id") % 31))
    grouped = folds.grouped_folds(rows, k=5)
    assert grouped.count() == 4000
    assert folds.straddling(grouped, ["entity"]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 37, 4000, 5000])
def test_hash_sample_takes_exactly_the_smallest(spark, n):
    df = skewed(spark)
    got = {r["id"] for r in ranking.hash_sample(df, n, ["entity"], 5).select("id").collect()}
    h = ranking.seeded_hash(["entity"], 5)
    want = {r["id"] for r in df.orderBy(h, "entity").limit(n).collect()} if n else set()
    assert got == want


def test_salted_join_splits_the_hot_key_and_keeps_everything(spark):
    rows = skewed(spark)
    table = rows.select("property").distinct().withColumn("w", F.length("property"))
    hot = joins.hot_keys(rows, ["property"], task_rows=rows.where("property = 'hot'").count() // 3)
    assert [(r["property"], r["_salts"]) for r in hot.collect()][0][0] == "hot"
    assert all(r["_salts"] >= 2 for r in hot.collect())
    out = joins.salted_join(rows, table, ["property"], spread_by=["id"], hot=hot)
    assert out.count() == rows.count()
    assert out.where(F.col("w") != F.length("property")).count() == 0


def test_bounded_broadcast_fails_when_the_bound_is_wrong(spark):
    table = spark.range(10)
    assert joins.bounded(table, 10).count() == 10
    with pytest.raises(Exception, match="bounded by 9"):
        joins.bounded(table, 9).collect()


@pytest.mark.parametrize("kind", ["ties", "heavy", "single"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(1)
    values = {
        "ties": rng.integers(0, 4, 3001).astype(float),
        "heavy": np.exp(rng.normal(0, 4, 20_000)),
        "single": np.array([5.0]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(9)
    want = {"a": 0.0, "b": 0.013, "c": 0.25, "d": 0.5, "e": 0.999, "f": 1.0}
    got = quantiles.exact_quantiles(df, [], "v", want, 1).collect()[0]
    for name, q in want.items():
        assert got[name] == pytest.approx(np.quantile(values, q), rel=1e-12)


def test_leave_fold_out_equals_refit(spark):
    rows = skewed(spark).select(
        "property",
        (F.col("id") % 5).cast("int").alias("fold"),
        # a large offset would ruin sums of raw squares
        (F.col("value") + 1e7).alias("x"),
        F.when(F.col("id") % 11 != 0, F.col("value") * 2 + F.col("id") % 13).alias("y"),
    )
    pdf = rows.toPandas().dropna()
    rest = moments.leave_fold_out(moments.fold_moments(rows, ["property", "fold"], ["x", "y"]), ["property"], "fold", ["x", "y"])
    for r in rest.where("property = 'hot'").collect():
        part = pdf[(pdf.property == "hot") & (pdf.fold != r["fold"])]
        assert r["n"] == len(part)
        cov = np.cov(part.x, part.y, bias=True) * len(part)
        assert r["m_x_x"] == pytest.approx(cov[0, 0], rel=1e-6)
        assert r["m_x_y"] == pytest.approx(cov[0, 1], rel=1e-6)


def test_period_and_least_rotation(spark):
    words = ["".join(w) for n in range(0, 7) for w in itertools.product("ab", repeat=n)] + ["abcabcabd", "aab" * 50]
    df = spark.createDataFrame([(list(w),) for w in words], "s array<string>")
    out = df.select("s", S.smallest_period(F.col("s")).alias("p"), S.spell(S.loose_key(F.col("s"))).alias("k")).collect()
    for r in out:
        w = "".join(r["s"])
        p = next((p for p in range(1, len(w) + 1) if len(w) % p == 0 and w == w[:p] * (len(w) // p)), 0)
        u = w[:p]
        assert r["p"] == p
        assert r["k"] == min((u[i:] + u[:i] for i in range(len(u))), default="")


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = ranking.top_k(skewed(spark), ["property"], [F.desc("value")], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_fits_read_their_own_folders_alone(spark):
    """The files of a fit do not grow with the number of properties."""
    from coobs.operators import models, runs

    def rows(properties):
        data = [(f"e{i}", f"p{p}", float(i * p % 7), i % 3, float(i)) for p in range(properties) for i in range(30)]
        return spark.createDataFrame(data, "entity string, property string, value double, fold int, x double")

    def files(df):
        scans, plan = [], df._jdf.queryExecution()
        df.collect()
        todo = [plan.executedPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName() == "AdaptiveSparkPlan":
                node = node.executedPlan()
            if node.nodeName().endswith("QueryStage"):
                node = node.plan()
            if node.metrics().contains("numFiles"):
                scans.append(node.metrics().apply("numFiles").value())
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
        return sum(scans)

    seen = {}
    for n in (2, 9):
        table = runs.fold_table(rows(n))
        seen[n] = files(table.where("property = 'p1' AND fold <> 0").groupBy().sum("value"))
        assert sorted(table.collect()) == sorted(rows(n).collect())
    assert seen[2] == seen[9] == 2
    model = models.Ridge(("x",), max_groups=9)
    a = runs.cross_validate(rows(3), model, 3, ["p0", "p1", "p2"])
    b = runs.cross_validate(rows(3), model, 3, ["p0", "p1", "p2"], own_rows=False)
    key = lambda r: (r["property"], r["entity"])
    assert [round(r["pred"], 9) for r in sorted(a.collect(), key=key)] == [round(r["pred"], 9) for r in sorted(b.collect(), key=key)]


@pytest.mark.parametrize("limit", [0, 4096])
def test_least_rotation_written_out_or_scanned(spark, monkeypatch, limit):
    from coobs.functions import sequences

    monkeypatch.setattr(sequences, "WRITTEN_OUT", limit)
    words = ["", "a", "aaa", "aab", "baa", "abab", "cabcab", "zyx", "bbabba", "abaab" * 3]
    df = spark.createDataFrame([(w, list(w)) for w in words], "w string, s array<string>")
    got = {r["w"]: r["i"] for r in df.select("w", sequences.least_rotation_start(F.col("s")).alias("i")).collect()}
    for w, i in got.items():
        assert w[i:] + w[:i] == min((w[j:] + w[:j] for j in range(len(w))), default="")


def test_costly_rows_of_one_file_are_spread(spark):
    from coobs.operators import variants

    rows = spark.createDataFrame([(i, "p", 1.0, ["a", "b"]) for i in range(9)], "entity long, property string, value double, seq array<string>").coalesce(1)
    audit = variants.invariance_rows(rows, "seq", lambda s: F.array_join(s, ""), lambda s: F.size(s).cast("double"))
    assert audit.rdd.getNumPartitions() > 1 and audit.count() == 54


def test_replicas_are_shuffled_once(spark, sf_dir):
    from coobs.operators import ensemble
    from coobs.queries import fixtures

    preds = fixtures.replica_preds(spark, sf_dir, (42, 43))
    plan = ensemble.average_replicas(preds, ["entity", "property"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(entity") == 1


def test_ranks_order_behind_the_shuffle(spark):
    """The hash that orders a bucket is computed where its rows arrive; only the bucket travels."""
    plan = ranking.hash_rank(spark.range(50).select(F.col("id").cast("string").alias("k")), ["k"], 1)._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("row_number") :]
    assert "md5" in window[: window.index("RepartitionByExpression")]
