"""Whole runs: cross-validation of a model, and the full ensemble from labels to output."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coobs import ENTITY, PROPERTY
from coobs.operators import ensemble as E, models as M, relations as R, score, tables
from coobs.plans.joins import bounded
from coobs.session import cut_lineage, scratch_path

KEY = [ENTITY, PROPERTY]


def fold_table(rows: DataFrame) -> DataFrame:
    """``rows`` written once in one folder per (property, fold): a fit lists the folders it needs, so what it
    reads does not grow with the number of properties and folds."""
    path = scratch_path(rows.sparkSession, "fold_table")
    # a pair is one task's worth of files at least, and more where it is large
    rows.repartition(PROPERTY, "fold").write.partitionBy(PROPERTY, "fold").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)


def cross_validate(
    rows: DataFrame, model: M.Model, folds: int, properties: Sequence[str], own_rows: bool = True
) -> DataFrame:
    """Out-of-fold prediction of each row by any model of the protocol: per (property,
    fold) it is fitted without that property's own fold rows.

    The table of folds is written once, by (property, fold).  A model that learns a property from
    its rows alone (``own_rows``) is given these, and reads no other folder; else it sees all but the
    held-out rows.
    """
    table = fold_table(rows)
    out = None
    for p in properties:
        for k in range(folds):
            mine = table.where(F.col(PROPERTY) == p)
            train = mine.where(F.col("fold") != k) if own_rows else tables.held_out_view(table, k, p)
            state = model.fit(train, targets=[p])
            part = model.predict(state, mine.where(F.col("fold") == k)).select(*rows.columns, "pred")
            out = part if out is None else out.unionByName(part)
    return out


def cv_report(oof: DataFrame, n_properties: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fold scores, macro R2 and noise floor of an out-of-fold table."""
    scores = score.fold_scores(oof)
    macro = score.macro_r2(score.r2_by(oof, [PROPERTY]))
    return scores, macro, score.noise_floor(scores, n_properties)


@dataclass(frozen=True)
class EnsembleRun:
    """Result tables of a full run."""

    oof: DataFrame
    output: DataFrame
    blend: DataFrame


def full_ensemble(
    train: DataFrame,
    test: DataFrame,
    entities: DataFrame,
    features: Sequence[str],
    catalogue: R.Catalogue,
    properties: Sequence[str],
    archive: DataFrame | None = None,
    trees: Sequence[str] = (),
) -> EnsembleRun:
    """Base models, mean/ridge stack, two-pass relation blend, partner regression, clip, fill, override.

    train: (entity, property, value, fold, features..); test: (id, entity, property,
    features..); entities: (entity, features..), the universe.  Base models are one ridge
    per feature, one on all, and one ensemble per kind in ``trees``; the partner frame comes from a
    partner-free ridge, so no label returns through a predicted partner.
    """
    n = len(properties)
    feats = list(features)
    sets = {f"ridge_{f}": [f] for f in feats} | {"ridge_all": feats}
    names = sorted(sets)
    oof, tested = train, test
    for name in names:
        o, t = M.oof_and_test(oof, tested, sets[name], max_groups=n)
        oof = o.withColumnRenamed("pred", name)
        tested = t.withColumnRenamed("pred", name)
    if trees:
        folds = (train.agg(F.max("fold")).first()[0] or 0) + 1
        asked = test.select(*KEY, *feats).dropDuplicates(KEY)
        for kind in trees:
            both = cut_lineage(M.per_property_oof(train, asked, feats, properties, kind=kind, folds=folds), f"member_{kind}")
            oof, tested = (
                df.join(both.where(F.col("split") == split).select(*KEY, F.col("pred").alias(f"tree_{kind}")), KEY, "left")
                for df, split in ((oof, "oof"), (tested, "test"))
            )
        names = sorted([*names, *(f"tree_{k}" for k in trees)])
    base = cut_lineage(E.with_mean_spread(oof, names), "oof")
    base_test = cut_lineage(E.with_mean_spread(tested, names), "test")
    stacked = E.stack(base, names, max_groups=n)
    stacked_test = E.stack_test(base, stacked, base_test, names, max_groups=n)
    rows = cut_lineage(stacked.select(*train.columns, F.col("stacked").alias("pred")), "stack")

    free = M.Ridge(tuple(feats), max_groups=n)
    cells = entities.select(
        ENTITY, *feats, F.explode(F.array(*[F.lit(p) for p in properties])).alias(PROPERTY)
    )
    guesses = free.predict(free.fit(train), cells)
    pool = tables.label_pool(train, archive)
    frame = R.frame_wide(R.partner_frame(pool, entities.select(ENTITY), guesses, properties), properties)
    frame = cut_lineage(frame, "frame")

    related = R.with_frame_estimate(rows, frame, catalogue)
    blended = cut_lineage(R.two_pass_blend(related, max_groups=n), "blend")
    report = R.blend_report(blended)
    test_rows = stacked_test.select(*test.columns, F.col("stacked").alias("pred"))
    related_test = R.with_frame_estimate(test_rows, frame, catalogue)
    moved = R.apply_to_test(blended.drop("weight", "blended"), report, related_test, max_groups=n)
    targets = [r.target for r in catalogue]
    untouched = test_rows.where(~F.col(PROPERTY).isin(*targets))
    final = moved.select(*test.columns, F.col("blended").alias("pred")).unionByName(untouched)

    kept = report.select(PROPERTY, "kept")
    finished = blended.join(bounded(kept, n), PROPERTY, "left").withColumn(
        "pred", F.when(F.col("kept"), F.col("blended")).otherwise(F.col("pred"))
    )
    oof_rows = finished.select(*train.columns, "pred").unionByName(
        rows.where(~F.col(PROPERTY).isin(*targets)).select(*train.columns, "pred")
    )
    oof_rows, final = cut_lineage(oof_rows, "related"), cut_lineage(final, "related_test")
    # small properties have no partner fit and keep what they have
    partner = cut_lineage(E.partner_regression(oof_rows, frame, properties, max_groups=n, test=final), "partnered")
    taught = partner.where(F.col("fold").isNotNull()).select(*KEY, "blended")
    unseen = partner.where(F.col("fold").isNull()).select("id", "blended")
    better = F.coalesce("blended", "pred")
    oof_rows = oof_rows.join(taught, KEY, "left").select(*train.columns, better.alias("pred"))
    final = final.join(unseen, "id", "left").select(*test.columns, better.alias("pred"))

    ranges = score.train_ranges(train)
    final = score.clip_to_train(final, ranges, max_groups=n)
    final = score.fill_missing(final, ranges, max_groups=n)
    if archive is not None:
        final = tables.override(final, archive)
    else:
        final = final.withColumn("source", F.lit("model")).withColumn("model_pred", F.col("pred"))
    return EnsembleRun(oof_rows, final.select(*test.columns, "pred", "model_pred", "source"), report)


