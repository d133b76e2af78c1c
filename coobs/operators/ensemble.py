"""Combining predictors: averages, disagreement, stacks, partner regressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from coobs import ENTITY, PROPERTY, VALUE
from coobs.operators.relations import SHRINK, best_weight, blend
from coobs.operators.tables import KEY
from coobs.plans.joins import bounded
from coobs.plans.quantiles import exact_quantiles
from coobs.plans.ranking import seeded_uniform
from coobs.plans.ridge import Cells, gcv_alpha, inner_alpha, moment_cells, solve, with_linear, sse
from coobs.session import cut_lineage

# They decide results.
STACK_ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0)
STANDARD_ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
PARTNER_ALPHAS = (0.1, 1.0, 10.0, 100.0)
STACK_MIN_MODELS = 3
STACK_MIN_ROWS = 60
STACK_MIN_TRAIN = 20
PARTNER_MIN_ROWS = 60
PARTNER_MIN_TRAIN = 30
INNER_FOLDS = 5
STANDARD_INNER = 3
PSEUDO_MAX_ROWS = 600
PSEUDO_SHARE = 0.15
PSEUDO_MIN = 25

FIT_SCHEMA = f"{PROPERTY} string, fold int, inner int, alpha double, intercept double, coef array<double>"
FULL = -1  # marks the fit on all folds


def inner_fold(k: int, seed: int | str, keys: Sequence[str] = (ENTITY,)) -> Column:
    """Hash fold of the inner level, no shuffle."""
    return F.floor(seeded_uniform(list(keys), f"inner-{seed}") * k).cast("int")


def average_replicas(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over folds, then over seeds, per row and model."""
    per_seed = preds.groupBy(*keys, "model", "seed").agg(F.avg("pred").alias("pred"))
    return per_seed.groupBy(*keys, "model").agg(
        F.avg("pred").alias("pred"), F.count(F.lit(1)).alias("n_seeds")
    )


def disagreement(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population sd over the models of a row."""
    return preds.groupBy(*keys).agg(
        F.avg("pred").alias("pred"),
        F.stddev_pop("pred").alias("spread"),
        F.count("pred").alias("n_models"),
    )


def models_wide(preds: DataFrame, models: Sequence[str], keys: Sequence[str] = tuple(KEY)) -> DataFrame:
    """Long prediction store to one column per model (missing to 0), mean and spread."""
    table = preds.groupBy(*keys).agg(
        *[
            F.coalesce(F.max(F.when(F.col("model") == m, F.col("pred"))), F.lit(0.0)).alias(m)
            for m in models
        ]
    )
    return with_mean_spread(table, models)


def with_mean_spread(table: DataFrame, models: Sequence[str]) -> DataFrame:
    k = float(len(models))
    mean = sum((F.col(m) for m in models[1:]), F.col(models[0])) / k
    table = table.withColumn("model_mean", mean)
    var = sum((F.pow(F.col(m) - F.col("model_mean"), 2) for m in models), F.lit(0.0)) / k
    return table.withColumn("model_spread", F.sqrt(var))


# -- stacking ----------------------------------------------------------------------


def _stack_fits(features: Sequence[str], alphas: Sequence[float], min_rows: int, min_train: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = Cells(pdf, features, "y")
        fold, inner = pdf["fold"].to_numpy(int), pdf["inner"].to_numpy(int)
        out = []
        if cells.n.sum() >= min_rows:
            for k in [*np.unique(fold), FULL]:
                train = fold != k
                if cells.n[train].sum() < min_train:
                    continue
                a = inner_alpha(cells, train, inner, alphas)
                b0, b = solve(cells.pool(train), a)
                out.append((pdf[PROPERTY].iloc[0], int(k), FULL, a, b0, b.tolist()))
        return pd.DataFrame(out, columns=[PROPERTY, "fold", "inner", "alpha", "intercept", "coef"])

    return fit


def stack_fits(rows: DataFrame, models: Sequence[str], seed: int = 0) -> DataFrame:
    """Ridge on (models + spread) per property and left-out fold; fold -1 is the full fit.

    The penalty comes from an inner 5-fold over {0.01 .. 100}.
    """
    features = [*models, "model_spread"]
    named = rows.withColumn("inner", inner_fold(INNER_FOLDS, seed)).withColumn("y", F.col(VALUE))
    cells = moment_cells(named, [PROPERTY, "fold", "inner"], features, "y")
    return cells.groupBy(PROPERTY).applyInPandas(
        _stack_fits(features, STACK_ALPHAS, STACK_MIN_ROWS, STACK_MIN_TRAIN), FIT_SCHEMA
    )


def stack(
    rows: DataFrame, models: Sequence[str], mode: str = "auto", max_groups: int = 1000, seed: int = 0
) -> DataFrame:
    """Stacked out-of-fold prediction per row and which combination it is.

    auto: the mean, unless at least three models and 60 rows exist, every fold could be
    fitted and the cross-fitted ridge beats the mean out of fold.
    """
    if mode == "mean" or (mode == "auto" and len(models) < STACK_MIN_MODELS):
        return rows.withColumn("stacked", F.col("model_mean")).withColumn("picked", F.lit("mean"))
    features = [*models, "model_spread"]
    fits = stack_fits(rows, models, seed)
    oof = with_linear(rows, fits, [PROPERTY, "fold"], features, "ridge_pred", max_groups * 65)
    ridge = stack_choice(oof)
    picked = oof.join(bounded(ridge.select(PROPERTY, "use_ridge"), max_groups), PROPERTY, "left")
    use = F.coalesce(F.col("use_ridge"), F.lit(False))
    return (
        picked.withColumn("stacked", F.when(use, F.col("ridge_pred")).otherwise(F.col("model_mean")))
        .withColumn("picked", F.when(use, "ridge").otherwise("mean"))
        .drop("use_ridge")
    )


def stack_choice(oof: DataFrame) -> DataFrame:
    """Per property the two scores and whether the ridge is used."""
    sst = F.var_pop(VALUE) * F.count(VALUE)

    def score(c: str) -> Column:
        return F.when(sst > 0, 1 - F.sum(F.pow(F.col(VALUE) - F.col(c), 2)) / sst)

    return (
        oof.groupBy(PROPERTY)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("ridge_pred").alias("_known"),
            score("model_mean").alias("r2_mean"),
            score("ridge_pred").alias("r2_ridge"),
        )
        .withColumn(
            "use_ridge",
            F.coalesce((F.col("_known") == F.col("n")) & (F.col("r2_ridge") > F.col("r2_mean")), F.lit(False)),
        )
        .drop("_known")
    )


def stack_test(
    train: DataFrame, picked: DataFrame, test: DataFrame, models: Sequence[str], seed: int = 0, max_groups: int = 1000
) -> DataFrame:
    """Test side of the stack: the full fit where ridge was picked, else the mean."""
    features = [*models, "model_spread"]
    full = stack_fits(train, models, seed).where(F.col("fold") == FULL)
    chosen = picked.where(F.col("picked") == "ridge").select(PROPERTY).distinct()
    fits = full.join(chosen, PROPERTY, "left_semi")
    out = with_linear(test, fits, [PROPERTY], features, "_ridge", max_groups)
    return out.withColumn("stacked", F.coalesce("_ridge", "model_mean")).drop("_ridge")


def standard_stack_fits(rows: DataFrame, models: Sequence[str], seed: int = 0) -> DataFrame:
    """Standardised ridge stack: one penalty per property (mean R2 of 3 inner folds over
    {0.001 .. 100}), then one fit per left-out fold."""
    features = list(models)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = Cells(pdf, features, "y")
        fold, inner = pdf["fold"].to_numpy(int), pdf["inner"].to_numpy(int)
        everything = np.ones(len(pdf), bool)
        a = inner_alpha(cells, everything, inner, STANDARD_ALPHAS, standardise=True, pooled=False)
        out = []
        for k in [*np.unique(fold), FULL]:
            stats = cells.pool(fold != k)
            if stats[0] > 0:
                b0, b = solve(stats, a, standardise=True)
                out.append((pdf[PROPERTY].iloc[0], int(k), FULL, a, b0, b.tolist()))
        return pd.DataFrame(out, columns=[PROPERTY, "fold", "inner", "alpha", "intercept", "coef"])

    named = rows.withColumn("inner", inner_fold(STANDARD_INNER, seed)).withColumn("y", F.col(VALUE))
    cells = moment_cells(named, [PROPERTY, "fold", "inner"], features, "y")
    return cells.groupBy(PROPERTY).applyInPandas(fit, FIT_SCHEMA)


def nested_standard_fits(rows: DataFrame, models: Sequence[str]) -> DataFrame:
    """Standardised ridge per (property, left-out fold) with everything nested in it: the penalty of {0.001 .. 100} with
    the best mean R2 (``score``) of the inner folds of the other rows, and the fit on these rows.

    ``rows`` has ``fold`` and ``inner``; all fits and scores come from the moments of their cells.
    """
    features = list(models)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = Cells(pdf, features, "y")
        fold, inner = pdf["fold"].to_numpy(int), pdf["inner"].to_numpy(int)
        out = []
        for k in np.unique(fold):
            train = fold != k
            parts = [(cells.pool(train & (inner != j)), cells.pool(train & (inner == j))) for j in np.unique(inner[train])]
            parts = [(f, v) for f, v in parts if f[0] > 0 and v[0] > 0 and v[2][-1, -1] > 0]
            if not parts:
                continue
            scored = [(float(np.mean([1.0 - sse(v, *solve(f, a, True)) / v[2][-1, -1] for f, v in parts])), -i) for i, a in enumerate(STANDARD_ALPHAS)]
            best, i = max(scored)
            a = STANDARD_ALPHAS[-i]
            b0, b = solve(cells.pool(train), a, standardise=True)
            out.append((pdf[PROPERTY].iloc[0], int(k), FULL, a, b0, b.tolist(), best))
        return pd.DataFrame(out, columns=[PROPERTY, "fold", "inner", "alpha", "intercept", "coef", "score"])

    cells = moment_cells(rows.withColumn("y", F.col(VALUE)), [PROPERTY, "fold", "inner"], features, "y")
    return cells.groupBy(PROPERTY).applyInPandas(fit, f"{FIT_SCHEMA}, score double")


# -- partner regression ------------------------------------------------------------


def partner_design(
    rows: DataFrame, frame: DataFrame, properties: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    """Values of all *other* properties plus measured flags, missing to 0.

    The row's own property is zeroed in both, which for a fit within one property is the
    same as leaving its columns out.
    """
    partners = frame.select(
        ENTITY,
        *[F.col(p).alias(f"_v_{p}") for p in properties],
        *[F.col(f"is_{p}").alias(f"_i_{p}") for p in properties],
    )
    zero = F.lit(0.0)
    cols, names = [], []
    for p in properties:
        other = F.col(PROPERTY) != p
        cols.append(F.when(other, F.coalesce(F.col(f"_v_{p}"), zero)).otherwise(zero).alias(f"x_{p}"))
        cols.append(
            F.when(other, F.coalesce(F.col(f"_i_{p}").cast("double"), zero)).otherwise(zero).alias(f"f_{p}")
        )
        names += [f"x_{p}", f"f_{p}"]
    return (
        rows.join(partners, ENTITY, "left").select(*[F.col(c) for c in rows.columns], *cols),
        names,
    )


CANDIDATES = f"{PROPERTY} string, fold int, alpha double, n double, mean array<double>, intercept double, coef array<double>, inverse array<double>"
#: Rows whose leverages one task takes at once.
LEVERAGE_ROWS = 100_000
#: Bytes of candidates that go to every task, so that the rows stay where they are.
LEVERAGE_BYTES = 16 << 20


def ridge_candidates(
    rows: DataFrame, features: Sequence[str], alphas: Sequence[float] = PARTNER_ALPHAS, min_train: int = PARTNER_MIN_TRAIN
) -> DataFrame:
    """The ridge of every penalty per (property, left-out fold), with what a row's leverage needs:
    the training mean and the inverse of the penalised moments."""
    features = list(features)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = Cells(pdf, features, "y")
        fold = pdf["fold"].to_numpy(int)
        out = []
        for k in [*np.unique(fold), FULL]:
            stats = n, mean, m = cells.pool(fold != k)
            if n < min_train:
                continue
            for a in alphas:
                b0, b = solve(stats, a)
                inverse = np.linalg.pinv(m[:-1, :-1] + a * np.eye(len(b)))
                out.append((pdf[PROPERTY].iloc[0], int(k), a, n, mean[:-1].tolist(), b0, b.tolist(), inverse.ravel().tolist()))
        return pd.DataFrame(out, columns=[PROPERTY, "fold", "alpha", "n", "mean", "intercept", "coef", "inverse"])

    cells = moment_cells(rows.withColumn("y", F.col(VALUE)), [PROPERTY, "fold"], features, "y")
    return cells.groupBy(PROPERTY).applyInPandas(fit, CANDIDATES)


def leave_one_out(rows: DataFrame, candidates: DataFrame, features: Sequence[str], max_groups: int = 1000) -> DataFrame:
    """(property, fold, alpha, ``loo``): squared leave-one-out errors, summed over the rows that taught the fit.

    Without row i a linear fit misses it by its residual over one minus its leverage
    1/n + (x - mean)' inverse (x - mean), so all refits cost one pass over the rows.  Few candidates go to
    the tasks that read the rows; more of them (over ``LEVERAGE_BYTES``) meet the rows of their property in groups
    salted to ``LEVERAGE_ROWS``.  What comes back are sums.
    """
    features = list(features)
    few = LEVERAGE_BYTES // (8 * (len(features) + 1) ** 2)
    fits = candidates.limit(few + 1).collect()
    if len(fits) <= few:
        return _scanned_errors(rows, fits, features)
    salts = F.ceil(F.count(F.lit(1)) / LEVERAGE_ROWS).cast("int").alias("_salts")
    sizes = bounded(rows.groupBy(PROPERTY).agg(salts), max_groups)
    salted = rows.select(PROPERTY, "fold", VALUE, *features, ENTITY).join(sizes, PROPERTY)
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(ENTITY, VALUE), F.col("_salts")).cast("int")).drop("_salts", ENTITY)
    spread = candidates.join(sizes, PROPERTY).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")

    def sums(mine: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        mine = mine.dropna(subset=[*features, VALUE])
        x, y, fold = mine[features].to_numpy(float), mine[VALUE].to_numpy(float), mine["fold"].to_numpy()
        out = []
        for f in fits.itertuples():
            taught = fold != f.fold
            off = x[taught] - np.asarray(f.mean)
            leverage = 1.0 / f.n + ((off @ np.asarray(f.inverse).reshape(len(features), -1)) * off).sum(axis=1)
            error = (y[taught] - f.intercept - x[taught] @ np.asarray(f.coef)) / np.maximum(1.0 - leverage, 1e-12)
            out.append((getattr(f, PROPERTY), f.fold, f.alpha, float(error @ error)))
        return pd.DataFrame(out, columns=[PROPERTY, "fold", "alpha", "loo"])

    on = [PROPERTY, "_salt"]
    parts = salted.groupBy(*on).cogroup(spread.groupBy(*on)).applyInPandas(sums, f"{PROPERTY} string, fold int, alpha double, loo double")
    return parts.groupBy(PROPERTY, "fold", "alpha").agg(F.sum("loo").alias("loo"))


def _scanned_errors(rows: DataFrame, candidates: Sequence[Row], features: Sequence[str]) -> DataFrame:
    """``leave_one_out`` without a shuffle of rows: every task has all candidates, those of a fold as one matrix."""
    named: dict[tuple, list[Row]] = {}
    for c in candidates:
        if c[PROPERTY] is not None:
            named.setdefault((c[PROPERTY], c["fold"]), []).append(c)
    models: dict[str, list[tuple]] = {}
    for (name, fold), fits in named.items():
        inverse = np.concatenate([np.reshape(c["inverse"], (len(features), -1)) for c in fits], axis=1)
        coef, intercept = np.array([c["coef"] for c in fits]).T, np.array([c["intercept"] for c in fits])
        models.setdefault(name, []).append((fold, [c["alpha"] for c in fits], fits[0]["n"], np.array(fits[0]["mean"]), intercept, coef, inverse))
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            x, (y, fold) = (
                np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in features]),
                (batch.column(c).to_numpy(zero_copy_only=False) for c in (VALUE, "fold")),
            )
            known = ~(np.isnan(x).any(axis=1) | np.isnan(y))
            names = pc.dictionary_encode(batch.column(PROPERTY))
            code = pc.fill_null(names.indices, -1).to_numpy(zero_copy_only=False)
            for i, name in enumerate(names.dictionary.to_pylist()):
                mine = np.flatnonzero(known & (code == i))
                xs, ys, folds = x[mine], y[mine], fold[mine]
                for k, alphas, n, mean, intercept, coef, inverse in sent.value.get(name, ()):
                    off = xs - mean
                    spread = (off @ inverse).reshape(len(off), len(alphas), -1)
                    leverage = 1.0 / n + np.einsum("rap,rp->ra", spread, off)
                    error = (ys[:, None] - intercept - xs @ coef) / np.maximum(1.0 - leverage, 1e-12)
                    error[folds == k] = 0.0  # these rows did not teach the fit
                    held[name, k] = held.get((name, k), 0.0) + (error * error).sum(axis=0)
        out = [(name, k, a, e) for (name, k), es in held.items() for a, e in zip(next(m[1] for m in sent.value[name] if m[0] == k), es.tolist())]
        if out:
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=[PROPERTY, "fold", "alpha", "loo"])

    asked = rows.select(PROPERTY, "fold", F.col(VALUE).cast("double").alias(VALUE), *[F.col(c).cast("double").alias(c) for c in features])
    parts = asked.mapInArrow(sums, f"{PROPERTY} string, fold int, alpha double, loo double")
    return parts.groupBy(PROPERTY, "fold", "alpha").agg(F.sum("loo").alias("loo"))


def ridge_fits(
    rows: DataFrame, features: Sequence[str], alphas: Sequence[float] = PARTNER_ALPHAS, min_train: int = PARTNER_MIN_TRAIN, max_groups: int = 1000
) -> DataFrame:
    """Cross-fitted ridge per property at the penalty of the least leave-one-out error (the smaller one on a tie)."""
    candidates = cut_lineage(ridge_candidates(rows, features, alphas, min_train), "ridge_candidates")
    errors = leave_one_out(rows, candidates, features, max_groups)
    best = errors.groupBy(PROPERTY, "fold").agg(F.min(F.struct("loo", "alpha")).alias("_b")).select(PROPERTY, "fold", F.col("_b.alpha").alias("alpha"))
    chosen = candidates.join(best, [PROPERTY, "fold", "alpha"])
    return chosen.select(PROPERTY, "fold", F.lit(FULL).alias("inner"), "alpha", "intercept", "coef")


def partner_regression(
    rows: DataFrame,
    frame: DataFrame,
    properties: Sequence[str],
    shrink: float = SHRINK,
    max_groups: int = 1000,
    test: DataFrame | None = None,
) -> DataFrame:
    """Ridge of the target on all other properties, cross-fitted, then blended into
    ``pred`` with a cross-fitted shrunk weight.  Adds ``estimate``, ``weight``, ``blended``.

    A property keeps its blend only if that lowers its squared error; else ``blended`` is
    ``pred``.  Rows of ``test`` (the same columns without ``value`` and ``fold``) follow with a
    null value and fold: the fit on all rows, the mean fold weight, under the same gate.
    """
    sizes = rows.groupBy(PROPERTY).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= PARTNER_MIN_ROWS)
    big = rows.join(bounded(sizes.select(PROPERTY), max_groups), PROPERTY, "left_semi")
    design, features = partner_design(big, frame, properties)
    design = cut_lineage(design, "partner_design")
    fits = cut_lineage(ridge_fits(design, features, max_groups=max_groups), "partner_fits")
    est = with_linear(design, fits, [PROPERTY, "fold"], features, "estimate", max_groups * 65).drop(*features)
    est = cut_lineage(est, "partner_estimates")
    weights = cut_lineage(plain_weights(est, shrink), "partner_weights")
    joined = est.join(bounded(weights, max_groups * 64), [PROPERTY, "fold"], "left")
    mixed = F.coalesce(blend(F.col("pred"), F.col("estimate"), F.col("weight")), F.col("pred"))
    joined = joined.withColumn("blended", mixed)
    error = [F.sum(F.pow(F.col(VALUE) - F.col(c), 2)) for c in ("blended", "pred")]
    gains = joined.groupBy(PROPERTY).agg((error[0] < error[1]).alias("_gain"))
    gains = cut_lineage(gains, "partner_gains")
    gated = F.when(F.col("_gain"), F.col("blended")).otherwise(F.col("pred"))
    out = joined.join(bounded(gains, max_groups), PROPERTY, "left").withColumn("blended", gated).drop("_gain")
    if test is None:
        return out
    known = bounded(gains, max_groups)
    asked, _ = partner_design(test.join(known.select(PROPERTY), PROPERTY, "left_semi"), frame, properties)
    whole = fits.where(F.col("fold") == FULL).drop("fold")
    mean = weights.groupBy(PROPERTY).agg(F.avg("weight").alias("weight"))
    unseen = with_linear(asked, whole, [PROPERTY], features, "estimate", max_groups).drop(*features)
    unseen = unseen.join(bounded(mean, max_groups), PROPERTY, "left").withColumn("blended", mixed)
    unseen = unseen.join(known, PROPERTY, "left").withColumn("blended", gated).drop("_gain")
    return out.unionByName(unseen, allowMissingColumns=True)


def plain_weights(rows: DataFrame, shrink: float = SHRINK, min_train: int = PARTNER_MIN_TRAIN) -> DataFrame:
    """Per (property, fold) the shrunk blend weight tuned on the other folds."""
    known = F.col("estimate").isNotNull()
    d, g = F.col(VALUE) - F.col("pred"), F.col("estimate") - F.col("pred")
    sums = rows.groupBy(PROPERTY, "fold").agg(
        F.count("estimate").alias("_n"),
        F.coalesce(F.sum(F.when(known, d * d)), F.lit(0.0)).alias("_dd"),
        F.coalesce(F.sum(F.when(known, d * g)), F.lit(0.0)).alias("_dg"),
        F.coalesce(F.sum(F.when(known, g * g)), F.lit(0.0)).alias("_gg"),
    )
    w = Window.partitionBy(PROPERTY)
    rest = {c: F.sum(c).over(w) - F.col(c) for c in ("_n", "_dd", "_dg", "_gg")}
    return (
        sums.select(PROPERTY, "fold", *[e.alias(c + "r") for c, e in rest.items()])
        .where(F.col("_nr") >= min_train)
        .select(
            PROPERTY,
            "fold",
            (best_weight(F.col("_ddr"), F.col("_dgr"), F.col("_ggr")) * shrink).alias("weight"),
        )
    )


def nested_feature_fits(
    rows: DataFrame, features: Sequence[str], alphas: Sequence[float] = PARTNER_ALPHAS, seed: int = 0
) -> DataFrame:
    """Two-level fits: for outer fold k one fit without k (inner -1, for validation rows)
    and one per inner fold j without k and j (for the training rows of j)."""
    features = list(features)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = Cells(pdf, features, "y")
        fold, inner = pdf["fold"].to_numpy(int), pdf["inner"].to_numpy(int)
        out = []
        for k in np.unique(fold):
            for j in [FULL, *np.unique(inner)]:
                stats = cells.pool((fold != k) & (inner != j))
                if stats[0] >= PARTNER_MIN_TRAIN:
                    a = gcv_alpha(stats, alphas)
                    b0, b = solve(stats, a)
                    out.append((pdf[PROPERTY].iloc[0], int(k), int(j), a, b0, b.tolist()))
        return pd.DataFrame(out, columns=[PROPERTY, "fold", "inner", "alpha", "intercept", "coef"])

    named = rows.withColumn("inner", inner_fold(INNER_FOLDS, seed)).withColumn("y", F.col(VALUE))
    cells = moment_cells(named, [PROPERTY, "fold", "inner"], features, "y")
    return cells.groupBy(PROPERTY).applyInPandas(fit, FIT_SCHEMA)


def nested_feature(
    rows: DataFrame, features: Sequence[str], outer: int | None = None, seed: int = 0, max_groups: int = 1000
) -> DataFrame:
    """The partner ridge as one leak-free feature for the model of each outer fold (or of
    ``outer`` alone): validation rows get the fit on all training rows, training rows an
    inner OOF value.  Each row comes once per outer fold of its property (column ``outer``)."""
    fits = nested_feature_fits(rows, features, seed=seed).withColumnRenamed("fold", "outer")
    if outer is not None:
        fits = fits.where(F.col("outer") == outer)
    fits = cut_lineage(fits, "nested_fits")
    models = bounded(fits.select(PROPERTY, "outer").distinct(), max_groups * 64)
    valid = F.col("fold") == F.col("outer")
    keyed = rows.join(models, PROPERTY).withColumn(
        "inner", F.when(valid, F.lit(FULL)).otherwise(inner_fold(INNER_FOLDS, seed))
    )
    return (
        with_linear(keyed, fits, [PROPERTY, "outer", "inner"], features, "ridge_feature", max_groups * 64 * 8)
        .withColumn("role", F.when(valid, "valid").otherwise("train"))
        .drop("inner")
    )


# -- pseudo labels -----------------------------------------------------------------


def pseudo_labels(
    train: DataFrame,
    test_preds: DataFrame,
    keys: Sequence[str],
    max_groups: int = 1000,
    below: int | Column = PSEUDO_MAX_ROWS,
) -> DataFrame:
    """Mark test rows of small properties on which the models agree most.

    A row is confident below the property's first quartile of disagreement and below
    0.15 sd of its training values; a property with fewer than 25 such rows gives none.
    Nothing is applied: the rows carry the flag.
    """
    agree = disagreement(test_preds, keys)
    stats = (
        train.groupBy(PROPERTY)
        .agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(VALUE).alias("_sd"))
        .where(F.col("_n") < below)
    )
    cut = exact_quantiles(agree, [PROPERTY], "spread", {"_q1": 0.25}, max_groups)
    limits = stats.join(cut, PROPERTY).select(PROPERTY, "_q1", "_sd")
    rows = agree.join(bounded(limits, max_groups), PROPERTY)
    sure = (F.col("spread") < F.col("_q1")) & (F.col("spread") < PSEUDO_SHARE * F.col("_sd"))
    marked = rows.withColumn("_sure", F.coalesce(sure, F.lit(False)))
    counts = marked.groupBy(PROPERTY).agg(F.sum(F.col("_sure").cast("long")).alias("_k"))
    return (
        marked.join(bounded(counts, max_groups), PROPERTY)
        .withColumn("pseudo", F.col("_sure") & (F.col("_k") >= PSEUDO_MIN))
        .drop("_q1", "_sd", "_sure", "_k")
    )
