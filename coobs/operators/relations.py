"""Relations between properties: catalogue, calibration, cross-fitting, blending.

All fits are affine and come from centred moments per (property, pass, fold), see
``coobs.plans.moments``.  Rows are touched twice at most: once by the moment
aggregate, once when the small table of fitted numbers is joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coobs import ENTITY, PROPERTY, VALUE
from coobs.functions.numeric import clip, r2_from
from coobs.operators.tables import KEY, wide
from coobs.plans.joins import bounded
from coobs.plans.moments import (
    fold_moments,
    intercept,
    leave_fold_out,
    mean_of,
    moment_of,
    pooled,
    slope,
)
from coobs.plans.ranking import top_k
from coobs.session import cut_lineage

# They decide results.
FIT_MIN = 20
REFIT_MIN = 15
PASS_MIN = 25
BLEND_MIN_ROWS = 30
WEIGHT_MIN = 10
GRID_STEPS = 20
SHRINK = 0.75
RESIDUAL_MIN = 40
RESIDUAL_TRAIN_MIN = 30
MAX_FOLDS = 64


@dataclass(frozen=True)
class Relation:
    """target ~ expr(sources), e.g. ``Relation("net", ("gross", "disc"), lambda g, d: g - d)``."""

    target: str
    sources: tuple[str, ...]
    expr: Callable[..., Column]

    def on(self, column: Callable[[str], Column]) -> Column:
        """The raw estimate; NULL unless every source is known."""
        args = [column(s) for s in self.sources]
        known = args[0].isNotNull()
        for a in args[1:]:
            known = known & a.isNotNull()
        return F.when(known, self.expr(*args))


Catalogue = Sequence[Relation]


def relation_terms(table: DataFrame, catalogue: Catalogue, prefix: str = "rel_") -> DataFrame:
    """Raw estimates as columns of the wide table."""
    return table.select("*", *[r.on(F.col).alias(prefix + r.target) for r in catalogue])


def co_observed(table: DataFrame, catalogue: Catalogue) -> DataFrame:
    """One row per (entity, target) with raw estimate x and measured y: a projection."""
    cells = F.array(
        *[
            F.struct(
                F.lit(r.target).alias(PROPERTY), r.on(F.col).alias("x"), F.col(r.target).alias("y")
            )
            for r in catalogue
        ]
    )
    return table.select(ENTITY, F.explode(cells).alias("_c")).select(ENTITY, "_c.*")


def _fit_columns(min_n: int) -> list[Column]:
    a = F.when(F.col("n") >= min_n, slope())
    return [a.alias("a"), intercept(a=a).alias("b")]


def fit_relations(table: DataFrame, catalogue: Catalogue, min_n: int = FIT_MIN) -> DataFrame:
    """Slope, intercept, n, raw and fitted R2 per relation on co-observed entities.

    Relations with fewer than ``min_n`` rows or a constant estimate give no row.
    """
    m = fold_moments(co_observed(table, catalogue), [PROPERTY], ["x", "y"])
    sxx, sxy, syy = (F.col(moment_of(*p)) for p in (("x", "x"), ("x", "y"), ("y", "y")))
    raw_sse = sxx - 2 * sxy + syy + F.col("n") * F.pow(F.col(mean_of("y")) - F.col(mean_of("x")), 2)
    return (
        m.select("*", *_fit_columns(min_n))
        .where("a is not null")
        .select(
            PROPERTY,
            F.col("n").cast("long").alias("n"),
            "a",
            "b",
            r2_from(raw_sse, syy).alias("raw_r2"),
            r2_from(syy - F.col("a") * sxy, syy).alias("fitted_r2"),
        )
    )


def with_estimate(rows: DataFrame, lookup_wide: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Add ``x``, the raw estimate of the row's own property from its entity's partners."""
    sources = sorted({s for r in catalogue for s in r.sources})
    partners = lookup_wide.select(ENTITY, *[F.col(s).alias(f"_p_{s}") for s in sources])
    x = F.coalesce(
        *[F.when(F.col(PROPERTY) == r.target, r.on(lambda s: F.col(f"_p_{s}"))) for r in catalogue],
        F.lit(None).cast("double"),
    )
    return rows.join(partners, ENTITY, "left").select(*[F.col(c) for c in rows.columns], x.alias("x"))


def partner_estimate(rows: DataFrame, fits: DataFrame, lookup_wide: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Calibrated estimate from measured sources only, and whether the row is covered."""
    small = bounded(fits.select(PROPERTY, "a", "b"), len(catalogue))
    return (
        with_estimate(rows, lookup_wide, catalogue)
        .join(small, PROPERTY, "left")
        .withColumn("estimate", F.col("a") * F.col("x") + F.col("b"))
        .withColumn("covered", F.col("estimate").isNotNull())
        .drop("a", "b", "x")
    )


def crossfit_affine(
    rows: DataFrame,
    keys: Sequence[str] = (PROPERTY,),
    x: str = "x",
    y: str = VALUE,
    min_n: int = REFIT_MIN,
    estimate: str = "estimate",
    max_groups: int = 1000,
) -> DataFrame:
    """Estimate of every row from a fit on the other folds (``keys`` bound: max_groups)."""
    keys = list(keys)
    named = rows.select(*keys, "fold", F.col(x).alias("x"), F.col(y).alias("y"))
    m = fold_moments(named, [*keys, "fold"], ["x", "y"])
    rest = leave_fold_out(m, keys, "fold", ["x", "y"])
    fits = rest.select(*keys, "fold", *_fit_columns(min_n))
    joined = rows.join(bounded(fits, max_groups * MAX_FOLDS), [*keys, "fold"], "left")
    return joined.withColumn(estimate, F.col("a") * F.col(x) + F.col("b")).drop("a", "b")


def crossfit_many(
    rows: DataFrame,
    features: dict[str, str],
    mean: str | None = None,
    y: str = VALUE,
    min_n: int = REFIT_MIN,
    max_groups: int = 1000,
) -> DataFrame:
    """Several single-feature fits ``{output: feature}`` at once, and optionally the
    leave-out mean: one aggregate over the rows and one join back, whatever their number.
    """
    cols = ["x", "y"]
    names = sorted(set(features.values()))
    cells = feature_moments(rows, [PROPERTY, "fold"], names, y)
    rest = leave_fold_out(cells, [PROPERTY, "feature"], "fold", cols)
    fits = rest.select(
        PROPERTY, "fold", "feature", *_fit_columns(min_n), F.when(F.col("n") > 0, F.col(mean_of("y"))).alias("_m")
    )
    table = fits.groupBy(PROPERTY, "fold").agg(
        *[
            F.max(F.when(F.col("feature") == f, F.struct("a", "b"))).alias(f"_f{i}")
            for i, f in enumerate(names)
        ],
        F.max("_m").alias("_m"),
    )
    joined = rows.join(bounded(table, max_groups * MAX_FOLDS), [PROPERTY, "fold"], "left")
    out = {
        o: F.col(f"_f{names.index(f)}.a") * F.col(f) + F.col(f"_f{names.index(f)}.b")
        for o, f in features.items()
    }
    if mean:
        out[mean] = F.col("_m")
    return joined.withColumns(out).drop("_m", *[f"_f{i}" for i in range(len(names))])


def leave_out_mean(
    rows: DataFrame, y: str = VALUE, out: str = "pred", max_groups: int = 1000
) -> DataFrame:
    """Mean of the row's property over the other folds."""
    m = fold_moments(rows.select(PROPERTY, "fold", F.col(y).alias("y")), [PROPERTY, "fold"], ["y"])
    rest = leave_fold_out(m, [PROPERTY], "fold", ["y"])
    small = rest.where("n > 0").select(PROPERTY, "fold", F.col(mean_of("y")).alias(out))
    return rows.join(bounded(small, max_groups * MAX_FOLDS), [PROPERTY, "fold"], "left")


# -- blending ----------------------------------------------------------------------


def blend(model: Column, estimate: Column, weight: Column) -> Column:
    """Convex blend where the estimate exists, the model elsewhere."""
    return F.coalesce((1 - weight) * model + weight * estimate, model)


def best_weight(dd: Column, dg: Column, gg: Column) -> Column:
    """Grid weight in 0, 0.05 .. 1 with the least squared error; a tie takes the smaller.

    With d = y - m and g = e - m the error is dd - 2 w dg + w^2 gg, so three sums decide.
    """
    grid = F.transform(F.sequence(F.lit(0), F.lit(GRID_STEPS)), lambda i: i / F.lit(float(GRID_STEPS)))
    scored = F.transform(
        grid, lambda w: F.struct((dd - 2 * w * dg + w * w * gg).alias("sse"), w.alias("w"))
    )
    return F.array_min(scored)["w"]


def tune_weights(
    rows: DataFrame, keys: Sequence[str] = (PROPERTY,), y: str = VALUE, model: str = "pred",
    estimate: str = "estimate",
) -> DataFrame:
    """Per key the weight that maximises R2 over all rows (blended only where covered)."""
    d = F.col(y) - F.col(model)
    g = F.col(estimate) - F.col(model)
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(estimate).alias("n_covered"),
        F.sum(F.when(g.isNotNull(), d * d)).alias("_dd"),
        F.sum(F.when(g.isNotNull(), d * g)).alias("_dg"),
        F.sum(g * g).alias("_gg"),
        F.sum(d * d).alias("_all"),
        (F.var_pop(y) * F.count(y)).alias("_sst"),
    )
    w = F.when(
        F.col("n_covered") >= WEIGHT_MIN, best_weight(F.col("_dd"), F.col("_dg"), F.col("_gg"))
    ).otherwise(F.lit(0.0))
    gain = 2 * F.col("weight") * F.coalesce("_dg", F.lit(0.0)) - F.pow("weight", F.lit(2)) * F.coalesce("_gg", F.lit(0.0))
    return sums.withColumn("weight", w).select(
        *keys,
        "n_rows",
        "n_covered",
        "weight",
        r2_from(F.col("_all"), F.col("_sst")).alias("r2_model"),
        r2_from(F.col("_all") - gain, F.col("_sst")).alias("r2_blend"),
    )


def single_pass_blend(
    rows: DataFrame, shrink: float | dict[str, float] = SHRINK, max_groups: int = 1000
) -> DataFrame:
    """Coalesced variant: cross-fitted calibration of x, one shrunk weight per property."""
    fitted = crossfit_affine(rows, max_groups=max_groups)
    weights = tune_weights(fitted).select(PROPERTY, (F.col("weight") * shrink_of(shrink)).alias("weight"))
    return fitted.join(bounded(weights, max_groups), PROPERTY, "left").withColumn(
        "blended", blend(F.col("pred"), F.col("estimate"), F.col("weight"))
    )


def shrink_of(shrink: float | dict[str, float], default: float = SHRINK) -> Column:
    """The shrink factor, one number or per property."""
    if isinstance(shrink, dict):
        out = F.lit(float(default))
        for p, s in shrink.items():
            out = F.when(F.col(PROPERTY) == p, F.lit(float(s))).otherwise(out)
        return out
    return F.lit(float(shrink))


def pass_weights(
    rows: DataFrame, shrink: float | dict[str, float] = SHRINK, min_n: int = PASS_MIN
) -> DataFrame:
    """Per (property, covered, fold): calibration a, b and shrunk weight from other folds.

    Input columns: property, covered, fold, value, pred (the model's out-of-fold value)
    and x (the raw estimate).  The calibration of each fold enters its own weight, so the
    three sums are expanded into moments of (value, pred, x): one aggregate for all folds.
    """
    cols = ["y", "m", "x"]
    named = rows.select(
        PROPERTY, "covered", "fold", F.col(VALUE).alias("y"), F.col("pred").alias("m"), "x"
    )
    m = fold_moments(named, [PROPERTY, "covered", "fold"], cols)
    rest = leave_fold_out(m, [PROPERTY, "covered"], "fold", cols)
    mom = {p: F.col(moment_of(*p)) for p in [("y", "y"), ("y", "m"), ("y", "x"), ("m", "m"), ("m", "x"), ("x", "x")]}
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    d0 = F.col(mean_of("y")) - F.col(mean_of("m"))
    g0 = a * F.col(mean_of("x")) + b - F.col(mean_of("m"))
    dd = mom["y", "y"] - 2 * mom["y", "m"] + mom["m", "m"] + n * d0 * d0
    dg = a * mom["y", "x"] - mom["y", "m"] - a * mom["m", "x"] + mom["m", "m"] + n * d0 * g0
    gg = a * a * mom["x", "x"] - 2 * a * mom["m", "x"] + mom["m", "m"] + n * g0 * g0
    varies = (mom["x", "x"] > 0) & (n >= min_n)
    fits = rest.withColumn("a", F.when(varies, mom["y", "x"] / mom["x", "x"])).withColumn(
        "b", F.col(mean_of("y")) - F.col("a") * F.col(mean_of("x"))
    )
    return (
        fits.withColumn("weight", best_weight(dd, dg, gg) * shrink_of(shrink))
        .where("a is not null")
        .select(PROPERTY, "covered", "fold", "a", "b", "weight")
    )


def two_pass_blend(
    rows: DataFrame,
    shrink: float | dict[str, float] = SHRINK,
    max_groups: int = 1000,
) -> DataFrame:
    """Cross-fitted two-pass blend of training rows; adds ``blended`` and ``weight``."""
    weights = pass_weights(rows, shrink)
    fitted = rows.join(
        bounded(weights, max_groups * 2 * MAX_FOLDS), [PROPERTY, "covered", "fold"], "left"
    )
    est = F.col("a") * F.col("x") + F.col("b")
    return fitted.withColumn("blended", blend(F.col("pred"), est, F.col("weight"))).drop("a", "b")


def blend_report(blended: DataFrame, min_rows: int = BLEND_MIN_ROWS) -> DataFrame:
    """Per property: R2 before and after, gain, whether the stage is kept, coverage and
    the mean weight of each pass (mean over folds)."""
    fold_w = blended.groupBy(PROPERTY, "covered", "fold").agg(
        F.max("weight").alias("_w"),
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.pow(F.col(VALUE) - F.col("pred"), 2)).alias("_before"),
        F.sum(F.pow(F.col(VALUE) - F.col("blended"), 2)).alias("_after"),
        F.sum(VALUE).alias("_y"),
        (F.var_pop(VALUE) * F.count(VALUE)).alias("_ss"),
    )
    centred = fold_w.withColumn("_mean", F.col("_y") / F.col("_n"))
    per = centred.groupBy(PROPERTY).agg(
        F.sum("_n").alias("n_rows"),
        F.sum(F.when(F.col("covered"), F.col("_n")).otherwise(0)).alias("n_covered"),
        F.avg(F.when(F.col("covered"), F.col("_w"))).alias("w_covered"),
        F.avg(F.when(~F.col("covered"), F.col("_w"))).alias("w_uncovered"),
        F.sum("_before").alias("_b"),
        F.sum("_after").alias("_a"),
        F.sum("_ss").alias("_within"),
        F.sum("_y").alias("_ty"),
        F.collect_list(F.struct("_n", "_mean")).alias("_parts"),
    )
    grand = F.col("_ty") / F.col("n_rows")
    between = F.aggregate(
        "_parts", F.lit(0.0), lambda s, p: s + p["_n"] * (p["_mean"] - grand) * (p["_mean"] - grand)
    )
    sst = F.col("_within") + between
    return (
        per.where(F.col("n_rows") >= min_rows)
        .select(
            PROPERTY,
            "n_rows",
            "n_covered",
            (F.col("n_rows") - F.col("n_covered")).alias("n_uncovered"),
            r2_from(F.col("_b"), sst).alias("r2_before"),
            r2_from(F.col("_a"), sst).alias("r2_after"),
            "w_covered",
            "w_uncovered",
        )
        .withColumn("gain", F.col("r2_after") - F.col("r2_before"))
        .withColumn("kept", F.coalesce(F.col("gain") > 0, F.lit(False)))
    )


def apply_to_test(
    train: DataFrame, report: DataFrame, test: DataFrame, max_groups: int = 1000, min_n: int = PASS_MIN
) -> DataFrame:
    """Test side: the mean cross-fitted weight and a calibration over all training rows
    of the pass, only for properties whose stage was kept."""
    named = train.select(PROPERTY, "covered", F.col("x"), F.col(VALUE).alias("y"))
    fits = (
        fold_moments(named, [PROPERTY, "covered"], ["x", "y"])
        .select(PROPERTY, "covered", *_fit_columns(min_n))
        .where("a is not null")
    )
    weight = F.when(F.col("covered"), F.col("w_covered")).otherwise(F.col("w_uncovered"))
    kept = report.where("kept").select(PROPERTY, "w_covered", "w_uncovered")
    table = fits.join(kept, PROPERTY).select(PROPERTY, "covered", "a", "b", weight.alias("weight"))
    est = F.col("a") * F.col("x") + F.col("b")
    return (
        test.join(bounded(table, max_groups * 2), [PROPERTY, "covered"], "left")
        .withColumn("blended", blend(F.col("pred"), est, F.col("weight")))
        .drop("a", "b")
    )


# -- partner frame -----------------------------------------------------------------


def partner_frame(
    pool: DataFrame, entities: DataFrame, predictions: DataFrame, properties: Sequence[str]
) -> DataFrame:
    """Every (entity, property) cell: measured value if any, else the prediction.

    ``predictions`` must come from a model without partner columns, or the target's own
    label returns in one hop.
    """
    at = lambda p, c: F.when(F.col(PROPERTY) == p, F.col(c))
    # one row per entity on each side: its cells are never shuffled one by one
    known = pool.groupBy(ENTITY).agg(*[F.avg(at(p, VALUE)).alias(f"_k{i}") for i, p in enumerate(properties)])
    guess = predictions.groupBy(ENTITY).agg(*[F.max(at(p, "pred")).alias(f"_g{i}") for i, p in enumerate(properties)])
    cells = [
        F.struct(
            F.lit(p).alias(PROPERTY),
            F.coalesce(f"_k{i}", f"_g{i}").alias(VALUE),
            F.col(f"_k{i}").isNotNull().alias("is_true"),
        )
        for i, p in enumerate(properties)
    ]
    table = entities.select(ENTITY).join(known, ENTITY, "left").join(guess, ENTITY, "left")
    return table.select(ENTITY, F.explode(F.array(*cells)).alias("_c")).select(ENTITY, "_c.*")


def frame_wide(frame: DataFrame, properties: Sequence[str]) -> DataFrame:
    """The partner frame as columns: <p> and is_<p>."""
    return frame.groupBy(ENTITY).agg(
        *[F.max(F.when(F.col(PROPERTY) == p, F.col(VALUE))).alias(p) for p in properties],
        *[
            F.coalesce(F.max(F.when(F.col(PROPERTY) == p, F.col("is_true"))), F.lit(False)).alias(
                f"is_{p}"
            )
            for p in properties
        ],
    )


def with_frame_estimate(rows: DataFrame, frame: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Add x from the partner frame and ``covered``: every source of the row measured."""
    sources = sorted({s for r in catalogue for s in r.sources})
    partners = frame.select(
        ENTITY,
        *[F.col(s).alias(f"_p_{s}") for s in sources],
        *[F.col(f"is_{s}").alias(f"_i_{s}") for s in sources],
    )
    none = F.lit(None).cast("double")
    x = F.coalesce(
        *[F.when(F.col(PROPERTY) == r.target, r.on(lambda s: F.col(f"_p_{s}"))) for r in catalogue], none
    )

    def all_true(r: Relation) -> Column:
        out = F.lit(True)
        for s in r.sources:
            out = out & F.coalesce(F.col(f"_i_{s}"), F.lit(False))
        return out

    covered = F.coalesce(
        *[F.when(F.col(PROPERTY) == r.target, all_true(r)) for r in catalogue], F.lit(False)
    )
    targets = [r.target for r in catalogue]
    return (
        rows.where(F.col(PROPERTY).isin(*targets))
        .join(partners, ENTITY, "left")
        .select(*[F.col(c) for c in rows.columns], x.alias("x"), covered.alias("covered"))
    )


def relation_feature(block: DataFrame, catalogue: Catalogue, max_groups: int = 1000) -> DataFrame:
    """Calibrated relation as a feature plus its validity flag.

    The calibration sees other folds' rows with every source measured; the feature uses
    the mean-filled partner columns, so it exists on every row of a fitted property.
    """
    filled = F.coalesce(
        *[F.when(F.col(PROPERTY) == r.target, r.on(lambda s: F.col(f"true_{s}"))) for r in catalogue],
        F.lit(None).cast("double"),
    )

    def measured(r: Relation) -> Column:
        out = F.lit(True)
        for s in r.sources:
            out = out & (F.col(f"has_{s}") == 1)
        return out

    flag = F.coalesce(
        *[F.when(F.col(PROPERTY) == r.target, measured(r)) for r in catalogue], F.lit(False)
    )
    rows = block.withColumn("_raw", filled).withColumn("rel_ok", flag.cast("int"))
    rows = rows.withColumn("x", F.when(F.col("rel_ok") == 1, F.col("_raw")))
    named = rows.select(PROPERTY, "fold", "x", F.col(VALUE).alias("y"))
    rest = leave_fold_out(fold_moments(named, [PROPERTY, "fold"], ["x", "y"]), [PROPERTY], "fold", ["x", "y"])
    fits = rest.select(PROPERTY, "fold", *_fit_columns(REFIT_MIN))
    return (
        rows.join(bounded(fits, max_groups * MAX_FOLDS), [PROPERTY, "fold"], "left")
        .withColumn("rel_est", F.col("a") * F.col("_raw") + F.col("b"))
        .drop("a", "b", "x", "_raw")
    )


def residual_decomposition(
    rows: DataFrame,
    feature: str,
    inverse: Callable[[Column], Column] | None = None,
    max_groups: int = 1000,
) -> DataFrame:
    """target = f(source) + r: model r from ``feature`` on the other folds, rebuild.

    Input: property, fold, value, source (raw partner value), x = f(source).  With
    ``inverse`` the same residual answers the other direction: source = inverse(value - r).
    Properties with fewer than 40 co-observed rows give no estimate.
    """
    co = F.col("x").isNotNull() & F.col(VALUE).isNotNull()
    sizes = (
        rows.groupBy(PROPERTY)
        .agg(F.sum(F.when(co, 1).otherwise(0)).alias("_co"))
        .where(F.col("_co") >= RESIDUAL_MIN)
        .select(PROPERTY, F.lit(True).alias("_enough"))
    )
    with_r = rows.withColumn("residual", F.when(co, F.col(VALUE) - F.col("x"))).join(
        bounded(sizes, max_groups), PROPERTY, "left"
    )
    fitted = crossfit_affine(
        with_r, x=feature, y="residual", min_n=RESIDUAL_TRAIN_MIN, estimate="residual_hat",
        max_groups=max_groups,
    )
    fitted = fitted.withColumn("residual_hat", F.when(F.col("_enough"), F.col("residual_hat")))
    out = fitted.withColumn("estimate", F.col("x") + F.col("residual_hat")).drop("_enough")
    if inverse is not None:
        out = out.withColumn("source_estimate", inverse(F.col(VALUE) - F.col("residual_hat")))
    return out


def refine_cells(
    frame: DataFrame,
    catalogue: Catalogue,
    properties: Sequence[str],
    rounds: int = 3,
    damp: float = 0.5,
    min_n: int = PASS_MIN,
) -> DataFrame:
    """Damped, synchronous refinement of predicted cells along the relations.

    Measured cells never move.  Each round is one moment aggregate (a handful of numbers,
    used as a scalar subquery) and one projection; lineage is cut per round.
    """
    flags = [f"is_{p}" for p in properties]
    cur = frame.select(ENTITY, *properties, *flags)
    for _ in range(rounds):
        cells = F.array(
            *[
                F.struct(
                    F.lit(r.target).alias(PROPERTY),
                    r.on(F.col).alias("x"),
                    F.when(F.col(f"is_{r.target}"), F.col(r.target)).alias("y"),
                )
                for r in catalogue
            ]
        )
        long = cur.select(F.explode(cells).alias("_c")).select("_c.*")
        fits = fold_moments(long, [PROPERTY], ["x", "y"]).select(PROPERTY, *_fit_columns(min_n))
        row = fits.agg(
            *[
                F.max(F.when(F.col(PROPERTY) == r.target, F.struct("a", "b"))).alias(r.target)
                for r in catalogue
            ]
        )
        one = row.select(F.struct(*[r.target for r in catalogue])).scalar()
        moved = cur.withColumn("_fit", one)
        new = {}
        for r in catalogue:
            est = F.col(f"_fit.{r.target}.a") * r.on(F.col) + F.col(f"_fit.{r.target}.b")
            step = F.coalesce((1 - damp) * F.col(r.target) + damp * est, F.col(r.target))
            new[r.target] = F.when(F.col(f"is_{r.target}"), F.col(r.target)).otherwise(step)
        cur = cut_lineage(
            moved.select(ENTITY, *[new.get(p, F.col(p)).alias(p) for p in properties], *flags)
        )
    return cur


# -- standardisation and screening -------------------------------------------------


def standardise_targets(rows: DataFrame, y: str = VALUE, max_groups: int = 1000) -> DataFrame:
    """z of the target with mean and population sd of the other folds (sd 0 becomes 1)."""
    named = rows.select(PROPERTY, "fold", F.col(y).alias("y"))
    rest = leave_fold_out(fold_moments(named, [PROPERTY, "fold"], ["y"]), [PROPERTY], "fold", ["y"])
    var = F.greatest(F.col(moment_of("y", "y")) / F.col("n"), F.lit(0.0))
    sd = F.when(F.sqrt(var) > 1e-12, F.sqrt(var)).otherwise(1.0)
    small = rest.where("n > 0").select(PROPERTY, "fold", F.col(mean_of("y")).alias("mu"), sd.alias("sd"))
    return (
        rows.join(bounded(small, max_groups * MAX_FOLDS), [PROPERTY, "fold"], "left")
        .withColumn("z", (F.col(y) - F.col("mu")) / F.col("sd"))
        .withColumn("restored", F.col("z") * F.col("sd") + F.col("mu"))
    )


def feature_moments(
    rows: DataFrame, keys: Sequence[str], features: Sequence[str], y: str | None = None
) -> DataFrame:
    """Moments of each feature (and its co-moment with y) per key, one row per feature.

    All features are aggregated as columns of one pass and only the result is unpivoted.
    """
    aggs = []
    for f in features:
        aggs += [F.count(f).cast("double").alias(f"{f}__n"), F.avg(f).alias(f"{f}__mean"),
                 (F.var_pop(f) * F.count(f)).alias(f"{f}__m")]
        if y:
            aggs += [(F.covar_pop(f, y) * F.count(f)).alias(f"{f}__c")]
    if y:
        aggs += [F.avg(y).alias("_ymean"), (F.var_pop(y) * F.count(y)).alias("_ym")]
    table = rows.groupBy(*keys).agg(*aggs)

    def cell(f: str) -> Column:
        parts = [
            F.lit(f).alias("feature"),
            F.col(f"{f}__n").alias("n"),
            F.col(f"{f}__mean").alias(mean_of("x")),
            F.col(f"{f}__m").alias(moment_of("x", "x")),
        ]
        if y:
            parts += [
                F.col("_ymean").alias(mean_of("y")),
                F.col(f"{f}__c").alias(moment_of("x", "y")),
                F.col("_ym").alias(moment_of("y", "y")),
            ]
        return F.struct(*parts)

    return table.select(*keys, F.explode(F.array(*[cell(f) for f in features])).alias("_c")).select(
        *keys, "_c.*"
    )


def standardise_features(
    rows: DataFrame, features: Sequence[str], flat: float = 1e-6, limit: float = 10.0
) -> DataFrame:
    """z of each feature from the other folds' rows, clipped to +-limit; NULL when flat."""
    rest = leave_fold_out(feature_moments(rows, ["fold"], features), ["feature"], "fold", ["x"])
    sd = F.sqrt(F.greatest(F.col(moment_of("x", "x")) / F.col("n"), F.lit(0.0)))
    stats = rest.where("n > 0").withColumn("sd", sd)
    per_fold = stats.groupBy("fold").agg(
        *[
            F.max(F.when(F.col("feature") == f, F.struct(F.col(mean_of("x")).alias("mu"), "sd"))).alias(
                f"_s_{f}"
            )
            for f in features
        ]
    )
    joined = rows.join(bounded(per_fold, MAX_FOLDS), "fold", "left")
    z = [
        clip(
            F.when(F.col(f"_s_{f}.sd") > flat, (F.col(f) - F.col(f"_s_{f}.mu")) / F.col(f"_s_{f}.sd")),
            F.lit(-limit),
            F.lit(limit),
        ).alias(f"z_{f}")
        for f in features
    ]
    return joined.select(*[F.col(c) for c in rows.columns], *z)


def screen_features(rows: DataFrame, features: Sequence[str], k: int, y: str = VALUE) -> DataFrame:
    """Per (property, fold) the k features most correlated with the target on the other
    folds' rows; a constant feature counts as 0."""
    cols = ["x", "y"]
    rest = leave_fold_out(
        feature_moments(rows, [PROPERTY, "fold"], features, y), [PROPERTY, "feature"], "fold", cols
    )
    sxx, syy = F.col(moment_of("x", "x")), F.col(moment_of("y", "y"))
    varies = (F.sqrt(F.greatest(sxx, F.lit(0.0)) / F.col("n")) > 1e-9) & (syy > 0)
    corr = F.when(varies, F.abs(F.col(moment_of("x", "y"))) / F.sqrt(sxx * syy)).otherwise(0.0)
    scored = rest.where("n > 0").select(PROPERTY, "fold", "feature", corr.alias("abs_corr"))
    return top_k(scored, [PROPERTY, "fold"], [F.desc("abs_corr"), F.asc("feature")], k)
