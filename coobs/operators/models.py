"""Per-property models that are Spark jobs, behind one small protocol.

``Model.fit(train, targets) -> state`` and ``Model.predict(state, rows) -> rows + pred``.
Linear models need one aggregate for all properties and folds; trees are groups of one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coobs import ENTITY, PROPERTY, VALUE
from coobs.functions.numeric import r2_from
from coobs.functions.text import family
from coobs.operators.ensemble import FIT_SCHEMA, FULL, STANDARD_INNER, inner_fold, nested_standard_fits
from coobs.plans.gram import packed, wide_ridge, with_wide_linear
from coobs.plans.joins import bounded
from coobs.plans.ranking import hash_rank
from coobs.plans.ridge import MAX_COLUMNS, Cells, moment_cells, solve, with_linear
from coobs.plans import trees
from coobs.plans.trees import TEACH_ROWS, fit_trees
from coobs.session import cut_lineage

RIDGE_MIN_ROWS = 5


class Model(Protocol):
    def fit(self, train: DataFrame, targets: Sequence[str] | None = None) -> object: ...

    def predict(self, state: object, rows: DataFrame) -> DataFrame: ...


# -- ridge -------------------------------------------------------------------------


def ridge_per_property(
    train: DataFrame, features: Sequence[str], alpha: float = 1.0, with_folds: bool = False
) -> DataFrame:
    """Standardised ridge per property (and per left-out fold): one aggregate over rows.

    Beyond ``MAX_COLUMNS`` features the moments are tiles of a Gram matrix."""
    features = list(features)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = Cells(pdf, features, "y")
        fold = pdf["fold"].to_numpy(int)
        left_out = [*sorted(set(fold))] if with_folds else []
        out = []
        for k in [*left_out, FULL]:
            stats = cells.pool(fold != k) if k != FULL else cells.pool(fold == fold)
            if stats[0] >= RIDGE_MIN_ROWS:
                b0, b = solve(stats, alpha, standardise=True)
                out.append((pdf[PROPERTY].iloc[0], int(k), FULL, alpha, float(b0), b.tolist()))
        return pd.DataFrame(out, columns=[PROPERTY, "fold", "inner", "alpha", "intercept", "coef"])

    if len(features) > MAX_COLUMNS:
        wide = wide_ridge(train, PROPERTY, "fold" if with_folds else None, packed(features), F.col(VALUE), alpha=alpha, min_rows=RIDGE_MIN_ROWS)
        return wide.select(PROPERTY, "fold", F.lit(FULL).alias("inner"), "alpha", "intercept", "coef")
    named = train.withColumn("y", F.col(VALUE))
    if not with_folds:
        named = named.withColumn("fold", F.lit(0))
    named = named.select(
        PROPERTY, "fold", "y", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    )
    cells = moment_cells(named, [PROPERTY, "fold"], features, "y")
    return cells.groupBy(PROPERTY).applyInPandas(fit, FIT_SCHEMA)


@dataclass(frozen=True)
class Ridge:
    """Ridge baseline with the property mean for properties that could not be fitted."""

    features: tuple[str, ...]
    alpha: float = 1.0
    max_groups: int = 1000

    def fit(self, train: DataFrame, targets: Sequence[str] | None = None):
        rows = train if targets is None else train.where(F.col(PROPERTY).isin(*targets))
        fits = ridge_per_property(rows, self.features, self.alpha)
        means = train.groupBy(PROPERTY).agg(F.avg(VALUE).alias("_mean"))
        return fits, means

    def predict(self, state, rows: DataFrame) -> DataFrame:
        fits, means = state
        out = with_linear(
            rows.fillna(0.0, subset=list(self.features)), fits, [PROPERTY], self.features, "_p", self.max_groups
        )
        return (
            out.join(bounded(means, self.max_groups), PROPERTY, "left")
            .withColumn("pred", F.coalesce("_p", "_mean", F.lit(0.0)))
            .drop("_p", "_mean")
        )


def ridge_oof(
    rows: DataFrame, features: Sequence[str], alpha: float = 1.0, max_groups: int = 1000
) -> DataFrame:
    """Out-of-fold ridge prediction of every row, all folds from one aggregate."""
    fits = ridge_per_property(rows, features, alpha, with_folds=True).where(F.col("fold") != FULL)
    clean = rows.fillna(0.0, subset=list(features))
    return with_linear(clean, fits, [PROPERTY, "fold"], features, "pred", max_groups * 65)


def oof_and_test(
    rows: DataFrame, test: DataFrame, features: Sequence[str], alpha: float = 1.0, max_groups: int = 1000
) -> tuple[DataFrame, DataFrame]:
    """Linear form of the generic driver: OOF rows, and test rows as the *average of the
    fold models* (for a linear model the average of the coefficients)."""
    fits = ridge_per_property(rows, features, alpha, with_folds=True).where(F.col("fold") != FULL)
    oof = with_linear(
        rows.fillna(0.0, subset=list(features)), fits, [PROPERTY, "fold"], features, "pred", max_groups * 65
    )
    mean_fit = fits.groupBy(PROPERTY).agg(
        F.avg("intercept").alias("intercept"),
        F.array(*[F.avg(F.col("coef")[i]) for i in range(len(features))]).alias("coef"),
    )
    tested = with_linear(
        test.fillna(0.0, subset=list(features)), mean_fit, [PROPERTY], features, "pred", max_groups
    )
    return oof, tested


def wide_ridge_oof(
    rows: DataFrame, x: str, width: int, alpha: float = 1.0, max_groups: int = 1000, is_sparse: bool = False
) -> DataFrame:
    """Out-of-fold ridge prediction from a column ``x`` of ``width`` features: an array, or rows of ``gram.sparse``."""
    fits = wide_ridge(
        rows, PROPERTY, "fold", F.col(x), F.col(VALUE), alpha=alpha, min_rows=RIDGE_MIN_ROWS, width=width if is_sparse else None
    )
    fits = cut_lineage(fits.where(F.col("fold") != FULL), "wide_fits")
    return with_wide_linear(rows, fits, [PROPERTY, "fold"], F.col(x), "pred", max_groups * 65, width, is_sparse)


# -- trees -------------------------------------------------------------------------


def per_property_oof(
    rows: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    properties: Sequence[str],
    kind: str = "gbt",
    folds: int = 3,
    seed: int = 42,
    key: Sequence[str] = ("entity", "property"),
    augment: DataFrame | None = None,
    teach_rows: int = TEACH_ROWS,
) -> DataFrame:
    """Fit per (property, fold); predict validation and test; average the fold models on
    test and never refit on everything.  Returns (key.., split, pred).

    All fits are groups of one job.  All rows teach: one by one in properties of at most ``teach_rows`` rows, beyond
    that those of equal features together (``plans.trees``).  ``augment`` rows (with parent
    folds) join training parts only.
    """
    feats, key, n = list(features), list(key), len(properties)
    ours = F.col(PROPERTY).isin(*properties)
    clean = cut_lineage(rows.where(ours).fillna(0.0, subset=feats), "tree_rows")
    columns = list(dict.fromkeys([*key, PROPERTY, VALUE, "fold", *feats]))
    teach = clean.select(*columns)
    if augment is not None:
        extra = augment.where(ours).fillna(0.0, subset=feats)
        for c in key:
            extra = extra if c in extra.columns else extra.withColumn(c, F.lit(None).cast(clean.schema[c].dataType))
        teach = cut_lineage(teach.unionByName(extra.select(*columns)), "tree_taught")
    jobs = F.sequence(F.lit(0), F.lit(folds - 1))
    other = F.explode(F.filter(jobs, lambda k: k != F.col("fold"))).alias("job")
    taught = taught_entries(teach, ["fold"], {"job": other}, feats, key, kind, teach_rows, seed, n)
    fits = cut_lineage(fit_trees(taught.entries, [PROPERTY, "job"], feats, VALUE, key, kind, seed, "n"), "tree_fits")
    fits = trees.with_edges(fits, taught.edges, PROPERTY, n)

    own = clean.select(*dict.fromkeys([*key, PROPERTY, *feats]), F.col("fold").alias("job"))
    asked = test.where(ours).fillna(0.0, subset=feats).select(*dict.fromkeys([*key, PROPERTY, *feats]))
    vectors = asked.select(PROPERTY, *feats).distinct().withColumn("job", F.explode(jobs))
    every = own.select(PROPERTY, "job", *feats).unionByName(vectors.select(PROPERTY, "job", *feats))
    values = trees.tree_values(every, fits, [PROPERTY, "job"], feats, n * folds)
    mean = values.groupBy(PROPERTY, *feats).agg(F.avg("pred").alias("pred"))
    oof = trees.matched(own, values, [PROPERTY, "job", *feats]).withColumn("split", F.lit("oof"))
    tested = trees.matched(asked, mean, [PROPERTY, *feats]).withColumn("split", F.lit("test"))
    both = oof.select(*key, "split", "pred").unionByName(tested.select(*key, "split", "pred"))
    return both.groupBy(*key, "split").agg(F.avg("pred").alias("pred"))


@dataclass(frozen=True)
class Taught:
    """What teaches (``entries``), all rows as cells, and edges of the properties whose features are codes in both."""

    entries: DataFrame
    cells: DataFrame
    edges: DataFrame | None


def taught_entries(
    rows: DataFrame, parts: Sequence[str], jobs: dict[str, Column], feats: Sequence[str], key: Sequence[str], kind: str, teach_rows: int, seed: int, n: int
) -> Taught:
    """Rows of small properties one by one and those of all others as cells, once per job that they teach.

    ``jobs`` are the columns that name a fit, one of them an explode over ``parts``.
    """
    facts = trees.group_facts(rows, PROPERTY, feats, VALUE, teach_rows)
    is_few = bounded(facts.select(PROPERTY, "_few"), n)
    edges = trees.bin_edges(rows, facts, PROPERTY, feats, trees.vectors_held(kind, len(feats)), n)
    coded = trees.with_codes(rows, edges, PROPERTY, feats, n)
    cells = trees.cells_of(coded, facts, PROPERTY, parts, feats, VALUE, list(dict.fromkeys([*key, VALUE])), kind, seed, n)
    few = rows.join(is_few, PROPERTY).where("_few")
    few = few.select(*dict.fromkeys([PROPERTY, *parts, *key, VALUE, *feats]), F.lit(1).cast("bigint").alias("n"))
    many = cells.join(is_few, PROPERTY).where(~F.col("_few"))
    one = few.select("*", *jobs.values())
    names = [PROPERTY, *jobs]
    whole = trees.cells_by(many.select("*", *jobs.values()), names, feats, VALUE)
    for c in key:
        whole = whole if c in whole.columns else whole.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
    columns = list(dict.fromkeys([*names, *key, VALUE, *feats, "n"]))
    return Taught(one.select(*columns).unionByName(whole.select(*columns)), cells, edges)


def bounded_sample(rows: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """Per property the ``n`` rows with the least hashes of ``key``; all, if there are fewer.  No model is taught by it."""
    ranked = hash_rank(rows, list(key), seed, [PROPERTY], rank="_rank")
    return ranked.where(F.col("_rank") < n).drop("_rank")


def chosen_stack(
    rows: DataFrame, models: Sequence[str], properties: Sequence[str], seed: int = 0, teach_rows: int = TEACH_ROWS
) -> DataFrame:
    """Every row stacked by the learner its outer fold chose: (key.., fold, ``ridge_score``, ``tree_score``, ``meta``, ``stacked``).

    For each outer fold, on its training rows only: three inner folds give the mean R2 of the standardised ridge at its
    best penalty and of shallow boosted trees on the same predictions; the better one (the ridge on a tie)
    is fitted on all training rows and predicts the fold's own rows.  Inner scores come from cells of equal predictions,
    so rows are never multiplied by the number of fits, and no row is shuffled.
    """
    feats, n = list(models), len(properties)
    given = rows.where(F.col(PROPERTY).isin(*properties)).withColumn("inner", inner_fold(STANDARD_INNER, seed))
    given = cut_lineage(given.select(ENTITY, PROPERTY, VALUE, "fold", "inner", *feats), "meta_rows")
    ridge = cut_lineage(nested_standard_fits(given, feats), "meta_ridge")

    outer = given.select("fold").distinct().agg(F.sort_array(F.collect_list("fold"))).first()[0] or []
    if not outer:  # no rows, no folds
        none = F.lit(None).cast("double")
        return given.select(ENTITY, PROPERTY, "fold", none.alias("ridge_score"), none.alias("tree_score"), F.lit("ridge").alias("meta"), none.alias("stacked"))
    inner = [FULL, *range(STANDARD_INNER)]
    pairs = F.array(*[F.struct(F.lit(k).alias("outer"), F.lit(j).alias("part")) for k in outer for j in inner])
    seen = F.explode(F.filter(pairs, lambda p: (p["outer"] != F.col("fold")) & (p["part"] != F.col("inner"))))
    taught = taught_entries(given, ["fold", "inner"], {"job": seen.alias("job")}, feats, [ENTITY], "meta", teach_rows, seed, n)
    entries = taught.entries.select("*", F.col("job.outer").alias("outer"), F.col("job.part").alias("held"))
    by = [PROPERTY, "outer", "held"]
    fits = cut_lineage(fit_trees(entries, by, feats, VALUE, [ENTITY], "meta", seed, "n"), "meta_trees")
    # a row is scored by the fits that held its inner fold out: one of each other outer fold
    held = F.explode(F.filter(F.array(*[F.lit(k) for k in outer]), lambda k: k != F.col("fold"))).alias("outer")
    mean = trees.cell_mean(F.col("_sum"), F.col("n"))
    cells = taught.cells.select(PROPERTY, held, F.col("inner").alias("held"), *feats, "n", "_m2", "_low", "_high", mean.alias("_mean"))
    met = trees.predict_trees(cells, fits, by, feats, [*by, "n", "_m2", "_low", "_high", "_mean"], n * len(outer) * len(inner))
    off = F.col("n") * F.pow(F.col("_mean") - F.col("pred"), 2)
    centre = F.sum(F.col("n") * F.col("_mean")) / F.sum("n")
    centred = met.join(bounded(met.groupBy(*by).agg(centre.alias("_centre")), n * len(outer) * len(inner)), by)
    spread = F.col("n") * F.pow(F.col("_mean") - F.col("_centre"), 2)
    varies = F.max("_high") > F.min("_low")
    r2 = centred.groupBy(*by).agg(F.when(varies, r2_from(F.sum(F.col("_m2") + off), F.sum(F.col("_m2") + spread))).alias("r2"))
    scores = r2.groupBy(PROPERTY, "outer").agg(F.avg("r2").alias("tree_score"))
    scores = cut_lineage(ridge.select(PROPERTY, F.col("fold").alias("outer"), F.col("score").alias("ridge_score")).join(scores, [PROPERTY, "outer"], "left"), "meta_scores")
    chosen = scores.select(
        PROPERTY, F.col("outer").alias("fold"), "ridge_score", "tree_score",
        F.when(F.col("tree_score") > F.col("ridge_score"), "trees").otherwise("ridge").alias("meta"),
    )
    linear = with_linear(given, ridge, [PROPERTY, "fold"], feats, "_ridge", n * 65)
    asks = linear.select(ENTITY, PROPERTY, "fold", *feats, "_ridge", F.col("fold").alias("outer"), F.lit(FULL).alias("held"))
    own = trees.predict_trees(asks, trees.with_edges(fits, taught.edges, PROPERTY, n), by, feats, [ENTITY, PROPERTY, "fold", "_ridge"], n * len(outer) * len(inner))
    both = own.join(bounded(chosen, n * 65), [PROPERTY, "fold"], "left")
    return both.select(
        ENTITY, PROPERTY, "fold", "ridge_score", "tree_score", "meta",
        F.when(F.col("meta") == "trees", F.col("pred")).otherwise(F.col("_ridge")).alias("stacked"),
    )


# -- attribution -------------------------------------------------------------------


def linear_attribution(
    rows: DataFrame, fits: DataFrame, features: Sequence[str], key: Sequence[str], max_groups: int = 1000
) -> DataFrame:
    """Additive contributions coef * (x - mean) of a linear fit, one row per (key, feature).

    base is the prediction at the feature means, so base + sum(contribution) = prediction.
    """
    feats = list(features)
    means = rows.groupBy(PROPERTY).agg(*[F.avg(f).alias(f"_m_{f}") for f in feats])
    small = fits.select(PROPERTY, "intercept", "coef").join(means, PROPERTY)
    joined = rows.join(bounded(small, max_groups), PROPERTY)
    base: Column = F.col("intercept")
    pred: Column = F.col("intercept")
    for i, f in enumerate(feats):
        base = base + F.col("coef")[i] * F.col(f"_m_{f}")
        pred = pred + F.col("coef")[i] * F.col(f)
    cells = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f).cast("double").alias("x"),
            (F.col("coef")[i] * (F.col(f) - F.col(f"_m_{f}"))).alias("contribution"),
        )
        for i, f in enumerate(feats)
    ]
    keys = list(dict.fromkeys([*key, PROPERTY]))
    return (
        joined.select(*keys, base.alias("base"), pred.alias("prediction"), F.explode(F.array(*cells)).alias("_c"))
        .select(*keys, "base", "prediction", "_c.*")
    )


def mean_attribution(contributions: DataFrame) -> DataFrame:
    """Mean |contribution| per (property, feature)."""
    return contributions.groupBy(PROPERTY, "feature").agg(
        F.avg(F.abs("contribution")).alias("importance")
    )


def additivity(contributions: DataFrame, key: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Per property: rows and rows whose base + contributions miss the prediction."""
    per_row = contributions.groupBy(*dict.fromkeys([*key, PROPERTY])).agg(
        F.max("base").alias("_b"), F.max("prediction").alias("_p"), F.sum("contribution").alias("_s")
    )
    miss = F.abs(F.col("_b") + F.col("_s") - F.col("_p")) > tolerance
    return per_row.groupBy(PROPERTY).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(miss.cast("long")).alias("n_missed")
    )


def family_attribution(importance: DataFrame, floor: float = 0.005) -> DataFrame:
    """Share of attribution by feature family; families below 0.5 % are dropped."""
    per = importance.groupBy(PROPERTY, family(F.col("feature")).alias("family")).agg(
        F.sum(F.abs("importance")).alias("attribution")
    )
    total = per.groupBy(PROPERTY).agg(F.sum("attribution").alias("_t"))
    return (
        per.join(total, PROPERTY)
        .withColumn("share", F.when(F.col("_t") > 0, F.col("attribution") / F.col("_t")))
        .where(F.col("share") >= floor)
        .drop("_t")
    )


def interpretable(importance: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Attribution rows of families a reader can interpret."""
    return importance.where(family(F.col("feature")).isin(*[p.rstrip("_") for p in prefixes]))


def running_explanation(contributions: DataFrame, key: Sequence[str], top: int = 12) -> DataFrame:
    """Contributions of a row from the largest on with the running prediction; whatever
    follows the first ``top`` is folded into one line.  A row's window spans its features."""
    by = list(key)
    order = [F.desc(F.abs("contribution")), F.asc("feature")]
    ranked = contributions.withColumn("step", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    lines = ranked.withColumn("step", F.least(F.col("step"), F.lit(top + 1))).groupBy(*by, "step").agg(
        F.max("base").alias("base"),
        F.max("prediction").alias("prediction"),
        F.when(F.col("step") > top, "(remaining)").otherwise(F.max("feature")).alias("feature"),
        F.sum("contribution").alias("contribution"),
    )
    w = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("running", F.col("base") + F.sum("contribution").over(w)).withColumn(
        "step", F.col("step").cast("long")
    )
