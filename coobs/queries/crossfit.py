"""Relations, calibration, cross-fitting, blending, stacking."""

from __future__ import annotations

from pyspark.sql import functions as F

from coobs import ENTITY, PROPERTY, VALUE
from coobs.operators import ensemble as E, relations as R, score, tables
from coobs.plans.ridge import with_linear
from coobs.queries import fixtures as fx
from coobs.queries.registry import oracle, query, ridge2_fit, ridge2_gcv, ridge2_loo, ridge2_stats, rounded, rs
from coobs.session import cut_lineage

KEY = [ENTITY, PROPERTY]
N = len(fx.AMOUNTS)
TARGETS = [r.target for r in fx.CATALOGUE]
GRID = "SELECT i / 20.0 AS w FROM range(0, 21) t(i)"


def _co_sql() -> str:
    """(entity, property, x, y): every relation on the wide table."""
    return " UNION ALL ".join(
        f"SELECT entity, '{t}' AS property, CASE WHEN {' AND '.join(f'{s} IS NOT NULL' for s in srcs)} THEN {expr.format(p='')} END AS x, {t} AS y FROM order_wide"
        for t, (srcs, expr) in fx.CATALOGUE_SQL.items()
    )


@query(
    "xf_1_relation_terms",
    oracle(
        "SELECT entity, "
        + ", ".join(
            f"{rs(f'CASE WHEN ' + ' AND '.join(f'{s} IS NOT NULL' for s in srcs) + ' THEN ' + e.format(p='') + ' END')} AS rel_{t}"
            for t, (srcs, e) in fx.CATALOGUE_SQL.items()
        )
        + " FROM order_wide",
        "order_wide",
    ),
)
def xf_1(spark, sf_dir):
    wide = tables.wide(fx.order_meas(spark, sf_dir), fx.AMOUNTS)
    return rounded(R.relation_terms(wide, fx.CATALOGUE).drop(*fx.AMOUNTS))


_FIT = """SELECT property, count(*) AS n, regr_slope(y, x) AS a, regr_intercept(y, x) AS b,
          1 - sum((y - x) * (y - x)) / (var_pop(y) * count(*)) AS raw_r2, corr(x, y) ^ 2 AS fitted_r2
          FROM co WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY property HAVING count(*) >= 20 AND stddev_pop(x) >= 1e-12"""


@query(
    "xf_2_fit_relations",
    oracle(
        f"SELECT property, n, {rs('a')} AS a, {rs('b')} AS b, {rs('raw_r2')} AS raw_r2, {rs('fitted_r2')} AS fitted_r2 FROM fit",
        "order_wide",
        extra={"co": _co_sql(), "fit": _FIT},
    ),
)
def xf_2(spark, sf_dir):
    wide = tables.wide(fx.order_meas(spark, sf_dir), fx.AMOUNTS)
    return rounded(R.fit_relations(wide, fx.CATALOGUE))


@query(
    "xf_3_partner_estimate",
    oracle(
        f"""SELECT m.entity, m.property, {rs('f.a * c.x + f.b')} AS estimate, c.x IS NOT NULL AND f.a IS NOT NULL AS covered
            FROM order_meas m LEFT JOIN co c ON c.entity = m.entity AND c.property = m.property LEFT JOIN fit f ON f.property = m.property""",
        "order_wide",
        extra={"co": _co_sql(), "fit": _FIT},
    ),
)
def xf_3(spark, sf_dir):
    rows = fx.order_meas(spark, sf_dir)
    wide = tables.wide(rows, fx.AMOUNTS)
    fits = R.fit_relations(wide, fx.CATALOGUE)
    return rounded(R.partner_estimate(rows.select(*KEY), fits, wide, fx.CATALOGUE))


_CF = {
    "co": _co_sql(),
    "rx": """SELECT m.*, c.x FROM order_models m LEFT JOIN co c ON c.entity = m.entity AND c.property = m.property""",
    "cf": """SELECT k.property, k.fold, regr_slope(r.value, r.x) AS a, regr_intercept(r.value, r.x) AS b, count(r.x) AS n
             FROM (SELECT DISTINCT property, fold FROM rx) k JOIN rx r ON r.property = k.property AND r.fold <> k.fold
             WHERE r.x IS NOT NULL GROUP BY 1, 2 HAVING count(r.x) >= 15""",
    "est": """SELECT rx.*, cf.a * rx.x + cf.b AS estimate, rx.lines AS pred FROM rx LEFT JOIN cf ON cf.property = rx.property AND cf.fold = rx.fold""",
}


def _with_x(spark, sf_dir):
    """Rows with their out-of-fold model value and the raw estimate from measured partners."""
    wide = tables.wide(fx.order_meas(spark, sf_dir), fx.AMOUNTS)
    rows = fx.order_models(spark, sf_dir).withColumn("pred", F.col("lines"))
    return R.with_estimate(rows, wide, fx.CATALOGUE)


def _estimated(spark, sf_dir):
    return R.crossfit_affine(_with_x(spark, sf_dir), max_groups=N)


@query(
    "xf_4_crossfit_calibration",
    oracle(
        f"SELECT entity, property, fold, {rs('estimate')} AS estimate FROM est",
        "order_models",
        "order_wide",
        extra=_CF,
    ),
)
def xf_4(spark, sf_dir):
    return rounded(_estimated(spark, sf_dir).select(*KEY, "fold", "estimate"))


@query(
    "flagship_relation_scores",
    oracle(
        f"""SELECT property, count(*) AS n, {rs('1 - sum((value - estimate) * (value - estimate)) / (var_pop(value) * count(*))')} AS r2
            FROM est WHERE estimate IS NOT NULL GROUP BY property""",
        "order_models",
        "order_wide",
        extra=_CF,
    ),
)
def flagship(spark, sf_dir):
    """How well each amount follows from its related amounts, out of fold."""
    wide = tables.wide(fx.order_meas(spark, sf_dir), fx.AMOUNTS)
    rows = R.with_estimate(fx.order_folds(spark, sf_dir), wide, fx.CATALOGUE)
    return rounded(score.r2_by(R.crossfit_affine(rows, max_groups=N), [PROPERTY], pred="estimate"))


@query(
    "xf_5_blend",
    oracle(
        f"SELECT entity, property, {rs('coalesce(0.7 * pred + 0.3 * estimate, pred)')} AS blended FROM est",
        "order_models",
        "order_wide",
        extra=_CF,
    ),
)
def xf_5(spark, sf_dir):
    est = _estimated(spark, sf_dir)
    return rounded(est.select(*KEY, R.blend(F.col("pred"), F.col("estimate"), F.lit(0.3)).alias("blended")))


_TUNED = {
    **_CF,
    "scores": f"""SELECT property, w, count(*) AS n_rows, count(estimate) AS n_covered,
                  1 - sum((value - coalesce((1 - w) * pred + w * estimate, pred)) ^ 2) / (var_pop(value) * count(*)) AS r2
                  FROM est CROSS JOIN ({GRID}) GROUP BY property, w""",
    "tuned": """SELECT property, n_rows, n_covered, CASE WHEN n_covered >= 10 THEN w ELSE 0.0 END AS weight,
                r2, (SELECT r2 FROM scores z WHERE z.property = s.property AND z.w = 0) AS r0
                FROM scores s QUALIFY row_number() OVER (PARTITION BY property ORDER BY round(r2, 12) DESC, w) = 1""",
}


@query(
    "xf_6_weight_search",
    oracle(
        f"SELECT property, n_rows, n_covered, {rs('weight')} AS weight, {rs('r0')} AS r2_model, {rs('r2')} AS r2_blend FROM tuned",
        "order_models",
        "order_wide",
        extra=_TUNED,
    ),
)
def xf_6(spark, sf_dir):
    return rounded(R.tune_weights(_estimated(spark, sf_dir)))


_SHRUNK = "weight * CASE property WHEN 'tax' THEN 0.9 WHEN 'disc' THEN 1.0 ELSE 0.75 END"


@query(
    "xf_7_shrunk_weights",
    oracle(
        f"SELECT property, {rs(_SHRUNK)} AS weight FROM tuned", "order_models", "order_wide", extra=_TUNED
    ),
)
def xf_7(spark, sf_dir):
    w = R.tune_weights(_estimated(spark, sf_dir))
    shrink = R.shrink_of({"tax": 0.9, "disc": 1.0})
    return rounded(w.select(PROPERTY, (F.col("weight") * shrink).alias("weight")))


_PASS = {
    "pf": """SELECT k.property, k.covered, k.fold, regr_slope(r.value, r.x) AS a, regr_intercept(r.value, r.x) AS b
             FROM (SELECT DISTINCT property, covered, fold FROM blend_rows) k
             JOIN blend_rows r ON r.property = k.property AND r.covered = k.covered AND r.fold <> k.fold
             WHERE r.x IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 25 AND stddev_pop(r.x) >= 1e-12""",
    "ps": f"""SELECT f.property, f.covered, f.fold, f.a, f.b, g.w,
              sum((r.value - ((1 - g.w) * r.pred + g.w * (f.a * r.x + f.b))) ^ 2) AS sse
              FROM pf f JOIN blend_rows r ON r.property = f.property AND r.covered = f.covered AND r.fold <> f.fold
              CROSS JOIN ({GRID}) g GROUP BY ALL""",
    "pw": """SELECT property, covered, fold, a, b, w * 0.75 AS weight FROM ps
             QUALIFY row_number() OVER (PARTITION BY property, covered, fold ORDER BY round(sse, 6), w) = 1""",
    "bl": """SELECT r.*, p.weight, coalesce((1 - p.weight) * r.pred + p.weight * (p.a * r.x + p.b), r.pred) AS blended
             FROM blend_rows r LEFT JOIN pw p ON p.property = r.property AND p.covered = r.covered AND p.fold = r.fold""",
    "rep": """SELECT property, count(*) AS n_rows, count(*) FILTER (WHERE covered) AS n_covered, count(*) FILTER (WHERE NOT covered) AS n_uncovered,
              1 - sum((value - pred) ^ 2) / (var_pop(value) * count(*)) AS r2_before,
              1 - sum((value - blended) ^ 2) / (var_pop(value) * count(*)) AS r2_after,
              (SELECT avg(weight) FROM pw WHERE pw.property = bl.property AND pw.covered AND EXISTS (SELECT 1 FROM blend_rows q WHERE q.property = pw.property AND q.covered AND q.fold = pw.fold)) AS w_covered,
              (SELECT avg(weight) FROM pw WHERE pw.property = bl.property AND NOT pw.covered) AS w_uncovered
              FROM bl GROUP BY property HAVING count(*) >= 30""",
}


@query(
    "xf_8_two_pass_blend",
    oracle(
        f"SELECT entity, property, fold, covered, {rs('weight')} AS weight, {rs('blended')} AS blended FROM bl",
        "blend_rows",
        extra=_PASS,
    ),
)
def xf_8(spark, sf_dir):
    out = R.two_pass_blend(fx.blend_rows(spark, sf_dir), max_groups=N)
    return rounded(out.select(*KEY, "fold", "covered", "weight", "blended"))


@query(
    "evl_11_blend_report",
    oracle(
        f"""SELECT property, n_rows, n_covered, n_uncovered, {rs('r2_before')} AS r2_before, {rs('r2_after')} AS r2_after,
            {rs('w_covered')} AS w_covered, {rs('w_uncovered')} AS w_uncovered, {rs('r2_after - r2_before')} AS gain,
            r2_after - r2_before > 0 AS kept FROM rep""",
        "blend_rows",
        extra=_PASS,
    ),
)
def evl_11(spark, sf_dir):
    return rounded(R.blend_report(R.two_pass_blend(fx.blend_rows(spark, sf_dir), max_groups=N)))


_TRAIN_FOLD = 0


@query(
    "xf_8_test_side",
    oracle(
        f"""SELECT t.entity, t.property, {rs('''CASE WHEN r.r2_after > r.r2_before AND f.a IS NOT NULL AND coalesce(CASE WHEN t.covered THEN r.w_covered ELSE r.w_uncovered END) IS NOT NULL
            THEN (1 - CASE WHEN t.covered THEN r.w_covered ELSE r.w_uncovered END) * t.pred + CASE WHEN t.covered THEN r.w_covered ELSE r.w_uncovered END * (f.a * t.x + f.b)
            ELSE t.pred END''')} AS blended
            FROM blend_all t LEFT JOIN rep r ON r.property = t.property
            LEFT JOIN (SELECT property, covered, regr_slope(value, x) AS a, regr_intercept(value, x) AS b FROM blend_rows
                       WHERE x IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 25) f ON f.property = t.property AND f.covered = t.covered
            WHERE t.fold = {_TRAIN_FOLD}""",
        "blend_rows",
        extra=_PASS,
    )
    .replace("blend_rows AS (", "blend_all AS (", 1)
    .replace("pf AS (", f"blend_rows AS (SELECT * FROM blend_all WHERE fold <> {_TRAIN_FOLD}),\npf AS (", 1),
)
def xf_8_test(spark, sf_dir):
    """Fold 0 plays the test side: calibrated on all other rows, cross-fitted weights."""
    rows = fx.blend_rows(spark, sf_dir)
    train = rows.where(F.col("fold") != _TRAIN_FOLD)
    test = rows.where(F.col("fold") == _TRAIN_FOLD).drop("fold")
    report = R.blend_report(R.two_pass_blend(train, max_groups=N))
    return rounded(R.apply_to_test(train, report, test, max_groups=N).select(*KEY, "blended"))


_SINGLE = {
    "br": "SELECT * FROM blend_rows",
    "cf": """SELECT k.property, k.fold, regr_slope(r.value, r.x) AS a, regr_intercept(r.value, r.x) AS b
             FROM (SELECT DISTINCT property, fold FROM br) k JOIN br r ON r.property = k.property AND r.fold <> k.fold
             WHERE r.x IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 15""",
    "est": "SELECT br.*, cf.a * br.x + cf.b AS estimate FROM br LEFT JOIN cf ON cf.property = br.property AND cf.fold = br.fold",
    "sc": f"SELECT property, w, sum((value - coalesce((1 - w) * pred + w * estimate, pred)) ^ 2) AS sse FROM est CROSS JOIN ({GRID}) GROUP BY ALL",
    "ww": "SELECT property, w * 0.75 AS weight FROM sc QUALIFY row_number() OVER (PARTITION BY property ORDER BY round(sse, 6), w) = 1",
}


@query(
    "xf_9_coalesced_blend",
    oracle(
        f"""SELECT e.entity, e.property, {rs('weight')} AS weight, {rs('coalesce((1 - weight) * pred + weight * estimate, pred)')} AS blended
            FROM est e JOIN ww ON ww.property = e.property""",
        "blend_rows",
        extra=_SINGLE,
    ),
)
def xf_9(spark, sf_dir):
    out = R.single_pass_blend(fx.blend_rows(spark, sf_dir), max_groups=N)
    return rounded(out.select(*KEY, "weight", "blended"))


@query(
    "xf_10_partner_frame",
    oracle(f"SELECT entity, property, {rs('value')} AS value, is_true FROM order_frame", "order_frame"),
)
def xf_10(spark, sf_dir):
    return rounded(fx.order_frame(spark, sf_dir))


_RES = {
    **{k: _CF[k] for k in ("co", "rx")},
    "rr": "SELECT *, value - x AS residual FROM rx",
    "big": "SELECT property FROM rr WHERE residual IS NOT NULL GROUP BY property HAVING count(*) >= 40",
    "rf": """SELECT k.property, k.fold, regr_slope(r.residual, r.qty) AS a, regr_intercept(r.residual, r.qty) AS b
             FROM (SELECT DISTINCT property, fold FROM rr) k JOIN rr r ON r.property = k.property AND r.fold <> k.fold
             WHERE r.residual IS NOT NULL AND k.property IN (SELECT property FROM big) GROUP BY 1, 2 HAVING count(*) >= 30""",
    "rh": "SELECT rr.*, rf.a * rr.qty + rf.b AS hat FROM rr LEFT JOIN rf ON rf.property = rr.property AND rf.fold = rr.fold",
}


@query(
    "xf_11_residual_decomposition",
    oracle(
        f"""SELECT entity, property, {rs('residual')} AS residual, {rs('hat')} AS residual_hat, {rs('x + hat')} AS estimate,
            {rs('CASE WHEN hat IS NOT NULL THEN sqrt(greatest(value - hat, 1e-6)) END')} AS source_estimate FROM rh""",
        "order_models",
        "order_wide",
        extra=_RES,
    ),
)
def xf_11(spark, sf_dir):
    inverse = lambda v: F.when(v.isNotNull(), F.sqrt(F.greatest(v, F.lit(1e-6))))
    out = R.residual_decomposition(_with_x(spark, sf_dir), "qty", inverse, max_groups=N)
    return rounded(out.select(*KEY, "residual", "residual_hat", "estimate", "source_estimate"))


def _partner_rows(spark, sf_dir):
    models = fx.order_models(spark, sf_dir)
    frame = R.frame_wide(fx.order_frame(spark, sf_dir, models.select(*fx.MEASURED)), fx.AMOUNTS)
    return models.select(*KEY, VALUE, "fold", F.col("lines").alias("pred")), frame


@query("xf_12_partner_regression")
def xf_12(spark, sf_dir):
    rows, frame = _partner_rows(spark, sf_dir)
    out = E.partner_regression(rows, frame, fx.AMOUNTS, max_groups=N)
    return rounded(out.select(*KEY, "fold", "estimate", "weight", "blended"), 4)


@query("xf_12_partner_regression_test")
def xf_12_test(spark, sf_dir):
    """The test side: fold 4 is predicted by fits, weights and gates of the other folds."""
    rows, frame = _partner_rows(spark, sf_dir)
    test = rows.where("fold = 4").drop(VALUE, "fold")
    out = E.partner_regression(rows.where("fold < 4"), frame, fx.AMOUNTS, max_groups=N, test=test)
    return rounded(out.where("fold IS NULL").select(*KEY, "pred", "estimate", "weight", "blended"), 4)


@query("xf_13_nested_ridge_feature")
def xf_13(spark, sf_dir):
    rows, frame = _partner_rows(spark, sf_dir)
    design, features = E.partner_design(rows, frame, fx.AMOUNTS)
    design = cut_lineage(design, "partner_design")  # read for the moments and for the feature
    out = E.nested_feature(design, features, max_groups=N)
    return rounded(out.select(*KEY, "fold", "outer", "role", "ridge_feature"), 4)


_FEATURE = {
    "fill": "SELECT " + ", ".join(f"avg({p}) AS {p}" for p in fx.AMOUNTS) + " FROM order_wide",
    "fb": f"""SELECT m.entity, m.property, m.value, m.fold, {fx.relation_case_sql('t_', False)} AS raw, {fx.covered_case_sql('h_')} AS ok
              FROM (SELECT o.*, {", ".join(f"coalesce(w.{p}, f.{p}) AS t_{p}, w.{p} IS NOT NULL AS h_{p}" for p in fx.AMOUNTS)}
                    FROM order_folds o LEFT JOIN order_wide w ON w.entity = o.entity CROSS JOIN fill f) m""",
    "ff": """SELECT k.property, k.fold, regr_slope(r.value, r.raw) AS a, regr_intercept(r.value, r.raw) AS b
             FROM (SELECT DISTINCT property, fold FROM fb) k JOIN fb r ON r.property = k.property AND r.fold <> k.fold
             WHERE r.ok GROUP BY 1, 2 HAVING count(*) >= 15""",
}


@query(
    "xf_14_relation_feature",
    oracle(
        f"""SELECT fb.entity, fb.property, {rs('ff.a * fb.raw + ff.b')} AS rel_est, CAST(fb.ok AS INTEGER) AS rel_ok
            FROM fb LEFT JOIN ff ON ff.property = fb.property AND ff.fold = fb.fold""",
        "order_folds",
        "order_wide",
        extra=_FEATURE,
    ),
)
def xf_14(spark, sf_dir):
    rows = fx.order_folds(spark, sf_dir)
    block = tables.partner_block(rows, fx.order_meas(spark, sf_dir), fx.AMOUNTS)
    return rounded(R.relation_feature(block, fx.CATALOGUE, max_groups=N).select(*KEY, "rel_est", "rel_ok"))


def _refine_sql(rounds: int) -> dict[str, str]:
    out = {"c0": "SELECT * FROM order_frame_wide"}
    flags = ", ".join(f"c.is_{p}" for p in fx.AMOUNTS)
    for i in range(rounds):
        src = f"c{i}"
        out[f"f{i}"] = " UNION ALL ".join(
            f"""SELECT '{t}' AS property, regr_slope({t}, {e.format(p='')}) AS a, regr_intercept({t}, {e.format(p='')}) AS b
                FROM {src} WHERE is_{t} HAVING count(*) >= 25"""
            for t, (_, e) in fx.CATALOGUE_SQL.items()
        )
        cells = ", ".join(
            f"CASE WHEN c.is_{t} THEN c.{t} ELSE 0.5 * c.{t} + 0.5 * (f_{t}.a * {e.format(p='c.')} + f_{t}.b) END AS {t}"
            for t, (_, e) in fx.CATALOGUE_SQL.items()
        )
        joins = " ".join(
            f"CROSS JOIN (SELECT * FROM f{i} WHERE property = '{t}') f_{t}" for t in fx.CATALOGUE_SQL
        )
        out[f"c{i + 1}"] = f"SELECT c.entity, {cells}, {flags} FROM {src} c {joins}"
    return out


@query(
    "xf_15_refine_cells",
    oracle(
        "SELECT entity, " + ", ".join(f"{rs(p, 5)} AS {p}, is_{p}" for p in fx.AMOUNTS) + " FROM c3",
        "order_frame_wide",
        extra=_refine_sql(3),
    ),
)
def xf_15(spark, sf_dir):
    frame = R.frame_wide(fx.order_frame(spark, sf_dir), fx.AMOUNTS)
    return rounded(R.refine_cells(frame, fx.CATALOGUE, fx.AMOUNTS, rounds=3), 5)


def _stack_rows(spark, sf_dir):
    m = fx.order_models(spark, sf_dir).drop("qty").withColumnRenamed("qty_model", "qty")
    return E.with_mean_spread(m.select(*KEY, VALUE, "fold", *fx.MODELS), fx.MODELS)


@query("xf_16_stack")
def xf_16(spark, sf_dir):
    out = E.stack(_stack_rows(spark, sf_dir), fx.MODELS, max_groups=N)
    return rounded(out.select(*KEY, "fold", "ridge_pred", "stacked", "picked"), 4)


@query("xf_17_standardised_stack")
def xf_17(spark, sf_dir):
    rows = _stack_rows(spark, sf_dir)
    fits = E.standard_stack_fits(rows, fx.MODELS)
    out = with_linear(rows, fits, [PROPERTY, "fold"], fx.MODELS, "stacked", N * 65)
    return rounded(out.select(*KEY, "fold", "stacked"), 4)


_SCALE = """SELECT k.property, k.fold, avg(r.value) AS mu, stddev_pop(r.value) AS sd
            FROM (SELECT DISTINCT property, fold FROM order_folds) k
            JOIN order_folds r ON r.property = k.property AND r.fold <> k.fold GROUP BY 1, 2"""


@query(
    "xf_18_target_standardisation",
    oracle(
        f"""SELECT o.entity, o.property, {rs('(o.value - s.mu) / s.sd')} AS z, {rs('o.value')} AS restored FROM order_folds o
            JOIN s ON s.property = o.property AND s.fold = o.fold""",
        "order_folds",
        extra={"s": _SCALE},
    ),
)
def xf_18(spark, sf_dir):
    out = R.standardise_targets(fx.order_folds(spark, sf_dir), max_groups=N)
    return rounded(out.select(*KEY, "z", "restored"))


@query(
    "xf_19_feature_standardisation",
    oracle(
        f"""SELECT o.entity, o.property, {rs('greatest(least((o.n_lines - s.ml) / s.sl, 10), -10)')} AS z_n_lines,
            {rs('greatest(least((o.qty - s.mq) / s.sq, 10), -10)')} AS z_qty, CAST(NULL AS DOUBLE) AS z_flat
            FROM order_folds o JOIN (SELECT k.fold, avg(r.n_lines) AS ml, stddev_pop(r.n_lines) AS sl, avg(r.qty) AS mq, stddev_pop(r.qty) AS sq
              FROM (SELECT DISTINCT fold FROM order_folds) k JOIN order_folds r ON r.fold <> k.fold GROUP BY k.fold) s ON s.fold = o.fold""",
        "order_folds",
    ),
)
def xf_19(spark, sf_dir):
    rows = fx.order_folds(spark, sf_dir).withColumn("flat", F.lit(3.0))
    out = R.standardise_features(rows, ["n_lines", "qty", "flat"])
    return rounded(out.select(*KEY, "z_n_lines", "z_qty", "z_flat"))


# meas at fold level: train rows of small samples, test rows with three predictors
_PSEUDO = {
    "fit": """SELECT property, avg(value) AS m, stddev_samp(value) AS sd, count(*) AS n FROM train GROUP BY property""",
    "tp": """SELECT t.entity, t.property, unnest([f.m, f.m + t.id % 50 / 10.0, f.m - length(t.entity) / 4.0]) AS pred FROM test t JOIN fit f ON f.property = t.property""",
    "ag": "SELECT entity, property, avg(pred) AS pred, stddev_pop(pred) AS spread FROM tp GROUP BY entity, property",
    "cut": "SELECT property, quantile_cont(spread, 0.25) AS q1 FROM ag GROUP BY property",
    "mk": """SELECT ag.*, round(spread, 9) < round(q1, 9) AND spread < 0.15 * fit.sd AS sure FROM ag JOIN cut ON cut.property = ag.property
             JOIN fit ON fit.property = ag.property WHERE fit.n < (SELECT avg(n) + 1 FROM fit)""",
}


@query(
    "xf_20_pseudo_labels",
    oracle(
        f"""SELECT entity, property, {rs('pred')} AS pred, sure AND count(*) FILTER (WHERE sure) OVER (PARTITION BY property) >= 25 AS pseudo FROM mk""",
        "train",
        "test",
        extra=_PSEUDO,
    ),
)
def xf_20(spark, sf_dir):
    train, test = fx.train_test(spark, sf_dir)
    m = train.groupBy(PROPERTY).agg(F.avg(VALUE).alias("m"))
    preds = test.join(F.broadcast(m), PROPERTY).select(
        *KEY,
        F.explode(
            F.array(
                F.col("m"),
                F.col("m") + F.pmod("id", F.lit(50)) / 10.0,
                F.col("m") - F.length(ENTITY) / 4.0,
            )
        ).alias("pred"),
    )
    # 600 rows in real use; the mean property size makes the gate bite at any scale
    gate = train.groupBy(PROPERTY).count().agg(F.avg("count") + 1).scalar()
    agree = E.pseudo_labels(train, preds, KEY, len(fx.EVENT_TYPES), below=gate)
    return rounded(agree.select(*KEY, "pred", "pseudo"))


# -- the same operators on two predictors, where SQL can solve the systems ----------


_PAIR = ["gross", "net"]
_P2 = {
    "d": """SELECT m.entity, m.property, m.value, m.fold, m.lines AS pred,
            CASE m.property WHEN 'gross' THEN coalesce(w.net, 0.0) ELSE coalesce(w.gross, 0.0) END AS x,
            CAST(CASE m.property WHEN 'gross' THEN w.is_net ELSE w.is_gross END AS DOUBLE) AS f
            FROM order_models m JOIN order_frame_wide w ON w.entity = m.entity WHERE m.property IN ('gross', 'net')""",
    "st": f"""SELECT k.property, k.fold, {ridge2_stats("r.value", "r.x", "r.f")} FROM (SELECT DISTINCT property, fold FROM d) k
              JOIN d r ON r.property = k.property AND r.fold <> k.fold GROUP BY k.property, k.fold""",
    "fit": ridge2_loo("st", "d", "value", "x", "f"),
    "est": """SELECT d.*, t.b0 + t.b1 * d.x + t.b2 * d.f AS estimate FROM d JOIN fit t ON t.property = d.property AND t.fold = d.fold""",
    "ws": f"""SELECT k.property, k.fold, g.w, sum((r.value - ((1 - g.w) * r.pred + g.w * r.estimate)) ^ 2) AS sse
              FROM (SELECT DISTINCT property, fold FROM est) k JOIN est r ON r.property = k.property AND r.fold <> k.fold
              CROSS JOIN ({GRID}) g GROUP BY ALL""",
    "ww": "SELECT property, fold, w * 0.75 AS weight FROM ws QUALIFY row_number() OVER (PARTITION BY property, fold ORDER BY round(sse, 6), w) = 1",
    "gg": """SELECT e.property, sum((value - ((1 - weight) * pred + weight * estimate)) ^ 2) < sum((value - pred) ^ 2) AS gain
             FROM est e JOIN ww ON ww.property = e.property AND ww.fold = e.fold GROUP BY e.property""",
}


@query(
    "xf_12_partner_regression_pair",
    oracle(
        f"""SELECT e.entity, e.property, e.fold, {rs('estimate', 5)} AS estimate, {rs('weight')} AS weight,
            {rs('CASE WHEN gain THEN (1 - weight) * pred + weight * estimate ELSE pred END', 5)} AS blended
            FROM est e JOIN ww ON ww.property = e.property AND ww.fold = e.fold JOIN gg ON gg.property = e.property""",
        "order_models",
        "order_frame_wide",
        extra=_P2,
    ),
)
def xf_12_pair(spark, sf_dir):
    """gross on net and net on gross, with their measured flags."""
    rows, frame = _partner_rows(spark, sf_dir)
    pair = rows.where(F.col(PROPERTY).isin(*_PAIR))
    out = E.partner_regression(pair, frame, _PAIR, max_groups=2)
    return rounded(out.select(*KEY, "fold", "estimate", "weight", "blended"), 5, weight=6)


_N2 = {
    "d": "SELECT *, CAST(floor(CAST('0x' || substr(md5(entity || '|inner-0'), 1, 8) AS BIGINT) / 4294967296.0 * 5) AS INTEGER) AS inn FROM order_folds",
    # sums per (property, fold, inner fold) once; a fit pools the cells it may see
    "cells": f"SELECT property, fold, inn, {ridge2_stats('value', 'n_lines', 'qty')} FROM d GROUP BY ALL",
    "jobs": "SELECT DISTINCT property, fold AS o, j FROM cells CROSS JOIN (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS j)",
    "st": "SELECT k.property, k.o, k.j, sum(n) AS n, "
    + ", ".join(f"sum(n * {m}) / sum(n) AS {m}" for m in ("my", "m1", "m2"))
    + ", "
    + ", ".join(
        f"sum({c} + n * {a} * {b}) - sum(n * {a}) * sum(n * {b}) / sum(n) AS {c}"
        for c, a, b in (("yy", "my", "my"), ("g11", "m1", "m1"), ("g22", "m2", "m2"), ("g12", "m1", "m2"), ("c1", "my", "m1"), ("c2", "my", "m2"))
    )
    + " FROM jobs k JOIN cells c ON c.property = k.property AND c.fold <> k.o AND c.inn <> k.j GROUP BY k.property, k.o, k.j",
    "fit": ridge2_gcv("st", "property, o, j"),
}


@query(
    "xf_13_nested_feature_two_columns",
    oracle(
        f"""SELECT d.entity, d.property, d.fold, t.o AS outer, CASE WHEN d.fold = t.o THEN 'valid' ELSE 'train' END AS role,
            {rs('t.b0 + t.b1 * d.n_lines + t.b2 * d.qty', 5)} AS ridge_feature
            FROM d JOIN fit t ON t.property = d.property AND t.j = CASE WHEN d.fold = t.o THEN -1 ELSE d.inn END""",
        "order_folds",
        extra=_N2,
    ),
)
def xf_13_two(spark, sf_dir):
    rows = fx.order_folds(spark, sf_dir)
    out = E.nested_feature(rows, ["n_lines", "qty"], max_groups=N)
    return rounded(out.select(*KEY, "fold", "outer", "role", "ridge_feature"), 5)


_S2 = {
    "d": "SELECT *, CAST(floor(CAST('0x' || substr(md5(entity || '|inner-0'), 1, 8) AS BIGINT) / 4294967296.0 * 3) AS INTEGER) AS inn FROM order_models",
    "al": "SELECT unnest([0.001, 0.01, 0.1, 1.0, 10.0, 100.0]) AS alpha",
    "ist": f"""SELECT k.property, k.inn, {ridge2_stats("r.value", "r.lines", "r.qty_model")} FROM (SELECT DISTINCT property, inn FROM d) k
               JOIN d r ON r.property = k.property AND r.inn <> k.inn GROUP BY k.property, k.inn""",
    "ifit": ridge2_fit("(SELECT * FROM ist CROSS JOIN al)", "property", "alpha", standardise=True),
    "isc": """SELECT t.property, t.alpha, t.inn, 1 - sum((d.value - (t.b0 + t.b1 * d.lines + t.b2 * d.qty_model)) ^ 2) / (var_pop(d.value) * count(*)) AS r2
              FROM ifit t JOIN d ON d.property = t.property AND d.inn = t.inn GROUP BY ALL""",
    "pick": """SELECT property, alpha FROM (SELECT property, alpha, avg(r2) AS s FROM isc GROUP BY ALL)
               QUALIFY row_number() OVER (PARTITION BY property ORDER BY s DESC, alpha) = 1""",
    "ost": f"""SELECT k.property, k.fold, {ridge2_stats("r.value", "r.lines", "r.qty_model")} FROM (SELECT DISTINCT property, fold FROM d) k
               JOIN d r ON r.property = k.property AND r.fold <> k.fold GROUP BY k.property, k.fold""",
    "ofit": ridge2_fit("(SELECT ost.*, alpha FROM ost JOIN pick USING (property))", "property", "alpha", standardise=True),
}


@query(
    "xf_17_standardised_stack_pair",
    oracle(
        f"""SELECT d.entity, d.property, d.fold, {rs('t.b0 + t.b1 * d.lines + t.b2 * d.qty_model', 4)} AS stacked
            FROM d JOIN ofit t ON t.property = d.property AND t.fold = d.fold""",
        "order_models",
        extra=_S2,
    ),
)
def xf_17_pair(spark, sf_dir):
    rows = _stack_rows(spark, sf_dir)
    pair = ["lines", "qty"]
    fits = E.standard_stack_fits(rows, pair)
    out = with_linear(rows, fits, [PROPERTY, "fold"], pair, "stacked", N * 65)
    return rounded(out.select(*KEY, "fold", "stacked"), 4)
