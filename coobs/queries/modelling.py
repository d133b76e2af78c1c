"""Per-property models of the ML library and the linear ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from coobs import ENTITY, PROPERTY, VALUE
from coobs.operators import models, runs
from coobs.plans.gram import sparse
from coobs.queries import fixtures as fx
from coobs.queries.registry import oracle, query, ridge2_fit, ridge2_stats, rounded, rs

KEY = [ENTITY, PROPERTY]
FEATURES = ["n_lines", "qty"]


_ST = ridge2_stats("r.value", "r.n_lines", "r.qty")
_PRED = "f.b0 + f.b1 * o.n_lines + f.b2 * o.qty"


@query(
    "mdl_1_ridge_per_property",
    oracle(
        f"SELECT o.entity, o.property, {rs(f'coalesce({_PRED}, 0.0)')} AS pred FROM order_meas o LEFT JOIN f ON f.property = o.property",
        "order_meas",
        extra={
            "st": f"SELECT r.property, {_ST} FROM order_meas r WHERE r.property <> 'tax' GROUP BY r.property",
            "f": ridge2_fit("st", "property", "1.0", standardise=True),
        },
    ),
)
def mdl_1(spark, sf_dir):
    rows = fx.order_meas(spark, sf_dir)
    model = models.Ridge(tuple(FEATURES), max_groups=len(fx.AMOUNTS))
    out = model.predict(model.fit(rows.where(F.col(PROPERTY) != "tax")), rows)
    return rounded(out.select(*KEY, "pred"))


WIDE = 200
# One column per remainder of the order: the Gram matrix is a diagonal less an outer product, so the
# ridge has a closed form (Sherman and Morrison) that needs sums alone.
_WIDE = {
    "wd": f"SELECT *, CAST(entity AS BIGINT) % {WIDE} AS c FROM order_folds",
    "jobs": "SELECT DISTINCT property, fold AS k FROM wd",
    "tot": "SELECT j.property, j.k, count(*) AS n, avg(value) AS my FROM jobs j JOIN wd w ON w.property = j.property AND w.fold <> j.k GROUP BY ALL",
    "cats": f"SELECT j.property, j.k, c FROM jobs j, (SELECT unnest(range({WIDE})) AS c)",
    "col": """SELECT t.property, t.k, t.c, any_value(n) AS n, any_value(my) AS my, count(w.value) AS nj, coalesce(sum(w.value), 0) AS sj
              FROM cats t JOIN tot USING (property, k) LEFT JOIN wd w ON w.property = t.property AND w.fold <> t.k AND w.c = t.c GROUP BY t.property, t.k, t.c""",
    "std": "SELECT *, nj / n AS p, CASE WHEN nj > 0 AND nj < n THEN sqrt(nj / n * (1 - nj / n)) ELSE 1.0 END AS s FROM col",
    "sc": "SELECT *, (sj - nj * my) / s AS cj, CASE WHEN nj > 0 THEN n * p / (s * s) + 1.0 ELSE 1.0 END AS aj, p / s AS q FROM std",
    "uv": "SELECT property, k, sum(q * cj / aj) AS u, sum(q * q / aj) AS v FROM sc GROUP BY property, k",
    "co": "SELECT sc.*, (cj / aj + q / aj * n * u / (1 - n * v)) / s AS b FROM sc JOIN uv USING (property, k)",
    "ic": "SELECT property, k, any_value(my) - sum(b * p) AS b0 FROM co GROUP BY property, k",
}


@query(
    "mdl_1_wide_ridge",
    oracle(
        f"""SELECT w.entity, w.property, w.fold, {rs('b0 + b')} AS pred FROM wd w JOIN co ON co.property = w.property AND co.k = w.fold AND co.c = w.c
            JOIN ic ON ic.property = w.property AND ic.k = w.fold""",
        "order_folds",
        extra=_WIDE,
    ),
)
def mdl_1_wide(spark, sf_dir):
    """Out-of-fold ridge on 200 columns."""
    rows = fx.order_folds(spark, sf_dir)
    c = F.col(ENTITY).cast("bigint") % WIDE
    wide = rows.withColumn("x", sparse(F.array(c), F.array(F.lit(1.0))))
    out = models.wide_ridge_oof(wide, "x", WIDE, max_groups=len(fx.AMOUNTS), is_sparse=True)
    return rounded(out.select(*KEY, "fold", "pred"))


def _split(spark, sf_dir):
    rows = fx.order_folds(spark, sf_dir, k=fx.FOLDS)
    # folds 3 and 4 play the test side, 0..2 are the cross-fitting folds: every row is used
    return rows.where("fold < 3"), rows.where("fold >= 3")


@query("mdl_2_boosted_trees")
def mdl_2(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    out = models.per_property_oof(train, test, FEATURES, fx.AMOUNTS, kind="gbt", folds=3)
    return rounded(out)


@query("mdl_3_randomised_forest")
def mdl_3(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    out = models.per_property_oof(train, test, FEATURES, fx.AMOUNTS, kind="forest", folds=3)
    return rounded(out)


def _fold_fits(rows: str) -> dict[str, str]:
    return {
        "st": f"""SELECT k.property, k.fold, {_ST} FROM (SELECT DISTINCT property, fold FROM {rows}) k
                  JOIN {rows} r ON r.property = k.property AND r.fold <> k.fold GROUP BY k.property, k.fold""",
        "f": ridge2_fit("st", "property, fold", "1.0", standardise=True),
    }


@query(
    "mdl_4_oof_driver",
    oracle(
        f"""SELECT o.entity, o.property, o.fold, 'oof' AS split, {rs('o.value')} AS value, {rs(_PRED)} AS pred
            FROM tr o JOIN f ON f.property = o.property AND f.fold = o.fold
            UNION ALL SELECT o.entity, o.property, o.fold, 'test', {rs('o.value')}, {rs(_PRED)} FROM order_folds o
            JOIN (SELECT property, avg(b0) AS b0, avg(b1) AS b1, avg(b2) AS b2 FROM f GROUP BY property) f
            ON f.property = o.property WHERE o.fold >= 3""",
        "order_folds",
        extra={"tr": "SELECT * FROM order_folds WHERE fold < 3", **_fold_fits("tr")},
    ),
)
def mdl_4(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    oof, tested = models.oof_and_test(train, test, FEATURES, max_groups=len(fx.AMOUNTS))
    both = oof.withColumn("split", F.lit("oof")).unionByName(tested.withColumn("split", F.lit("test")))
    return rounded(both.select(*KEY, "fold", "split", VALUE, "pred"))


@query(
    "run_cross_validation",
    oracle(
        f"""SELECT property, count(*) AS n_folds, {rs('avg(r2)')} AS mean_r2, {rs('stddev_pop(r2)')} AS std_r2 FROM
            (SELECT o.property, o.fold, 1 - sum((o.value - ({_PRED})) ^ 2) / (var_pop(o.value) * count(*)) AS r2
             FROM o3 o JOIN f ON f.property = o.property AND f.fold = o.fold GROUP BY o.property, o.fold) GROUP BY property""",
        "order_meas",
        extra={"o3": fx.fold_sql("order_meas", k=3), **_fold_fits("o3")},
    ),
)
def run_cv(spark, sf_dir):
    """Any model of the protocol, cross-validated: fold scores per property."""
    rows = fx.order_folds(spark, sf_dir, k=3)
    model = models.Ridge(tuple(FEATURES), max_groups=len(fx.AMOUNTS))
    oof = runs.cross_validate(rows, model, 3, fx.AMOUNTS)
    return rounded(runs.cv_report(oof, len(fx.AMOUNTS))[0])


@query("run_full_ensemble")
def run_ensemble(spark, sf_dir):
    """From labels to a finished output table; fold 4 plays the test side."""
    rows = fx.order_folds(spark, sf_dir)
    train = rows.where("fold < 4")
    test = rows.where("fold = 4").select(
        F.xxhash64(*KEY).alias("id"), *KEY, *FEATURES
    )
    entities = fx.order_features(spark, sf_dir).select(ENTITY, *FEATURES)
    run = runs.full_ensemble(train, test, entities, FEATURES, fx.CATALOGUE, fx.AMOUNTS)
    return rounded(run.output.select(*KEY, "pred", "source"))


@query("xf_17_meta_choice")
def xf_17_meta(spark, sf_dir):
    """Rows stacked by ridge or shallow trees, whichever the outer fold's training rows chose."""
    m = fx.order_models(spark, sf_dir).drop("qty").withColumnRenamed("qty_model", "qty")
    out = models.chosen_stack(m.select(*KEY, VALUE, "fold", *fx.MODELS), fx.MODELS, fx.AMOUNTS)
    return rounded(out, 4)
