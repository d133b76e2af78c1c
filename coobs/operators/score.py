"""Scores and audits: R2 per property, macro mean, noise floor, domain split, validator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coobs import PROPERTY, VALUE
from coobs.functions.numeric import finite, r2_from, to_number
from coobs.plans.joins import bounded

MIN_SIDE = 20


def _sse(y: str, pred: str) -> Column:
    return F.sum(F.pow(F.col(y) - F.col(pred), 2))


def _sst(y: str) -> Column:
    """Sum of squares about the mean, aggregated without a second pass."""
    return F.var_pop(y) * F.count(y)


def r2_by(df: DataFrame, keys: Sequence[str], y: str = VALUE, pred: str = "pred") -> DataFrame:
    """R2 per key over rows with both values; NULL when the truth is constant."""
    both = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), r2_from(_sse(y, pred), _sst(y)).alias("r2")
    )


def macro_r2(per_property: DataFrame) -> DataFrame:
    """Unweighted mean over the properties present; an empty match is an error."""
    n = F.count("r2")
    mean = F.when(n > 0, F.avg("r2")).otherwise(
        F.raise_error(F.lit("no property matched any row: nothing was scored")).cast("double")
    )
    return per_property.agg(n.alias("n_properties"), mean.alias("macro_r2"))


def comparison_table(preds: DataFrame, models: Sequence[str], y: str = VALUE) -> DataFrame:
    """property x model R2 with a MEAN row; one aggregate over the long prediction store."""
    per = r2_by(preds, [PROPERTY, "model"], y)
    table = per.groupBy(PROPERTY).agg(
        *[F.max(F.when(F.col("model") == m, F.col("r2"))).alias(m) for m in models]
    )
    mean = table.agg(*[F.avg(m).alias(m) for m in models]).select(F.lit("MEAN").alias(PROPERTY), *models)
    return table.unionByName(mean)


def fold_scores(df: DataFrame, y: str = VALUE, pred: str = "pred") -> DataFrame:
    """Per property: folds, mean and population sd of the fold R2s."""
    return (
        r2_by(df, [PROPERTY, "fold"], y, pred)
        .groupBy(PROPERTY)
        .agg(
            F.count("r2").alias("n_folds"),
            F.avg("r2").alias("mean_r2"),
            F.stddev_pop("r2").alias("std_r2"),
        )
    )


def noise_floor(scores: DataFrame, n_properties: int) -> DataFrame:
    """Standard error of the macro score and the noisiest property.

    Differences below twice the floor are no change.
    """
    se = F.col("std_r2") / F.sqrt(F.greatest(F.col("n_folds"), F.lit(1)))
    worst = F.max_by(PROPERTY, F.struct(F.col("std_r2"), F.col(PROPERTY)))
    return scores.agg(
        (F.sqrt(F.sum(se * se)) / F.lit(n_properties)).alias("noise_floor"),
        (2 * F.sqrt(F.sum(se * se)) / F.lit(n_properties)).alias("no_change_below"),
        worst.alias("noisiest"),
    )


def domain_split(
    df: DataFrame, flag: str = "out_of_domain", y: str = VALUE, pred: str = "pred", min_side: int = MIN_SIDE
) -> DataFrame:
    """Per property n, R2 and mean absolute error inside and outside the domain."""
    per = df.groupBy(PROPERTY, flag).agg(
        F.count(F.lit(1)).alias("n"),
        r2_from(_sse(y, pred), _sst(y)).alias("r2"),
        F.avg(F.abs(F.col(y) - F.col(pred))).alias("mae"),
    )

    def side(out: bool, c: str) -> Column:
        return F.max(F.when(F.col(flag) == F.lit(out), F.col(c)))

    return (
        per.groupBy(PROPERTY)
        .agg(
            *[side(False, c).alias(f"{c}_in") for c in ("n", "r2", "mae")],
            *[side(True, c).alias(f"{c}_out") for c in ("n", "r2", "mae")],
        )
        .where((F.col("n_in") >= min_side) & (F.col("n_out") >= min_side))
    )


# -- finishing and validating an output --------------------------------------------


def train_ranges(train: DataFrame) -> DataFrame:
    return train.groupBy(PROPERTY).agg(
        F.min(VALUE).alias("lo"), F.max(VALUE).alias("hi"), F.avg(VALUE).alias("mean")
    )


def clip_to_train(
    preds: DataFrame, ranges: DataFrame, pad: float = 0.05, pred: str = "pred", max_groups: int = 1000
) -> DataFrame:
    """Clamp to the training range widened by ``pad``; NULL predictions stay NULL."""
    width = F.lit(pad) * (F.col("hi") - F.col("lo"))
    lo, hi = F.col("lo") - width, F.col("hi") + width
    p = F.col(pred)
    joined = preds.join(bounded(ranges.select(PROPERTY, "lo", "hi"), max_groups), PROPERTY, "left")
    known = p.isNotNull() & lo.isNotNull()
    clipped = F.when(known, F.least(F.greatest(p, lo), hi)).otherwise(p)
    return (
        joined.withColumn("was_clipped", F.coalesce((p < lo) | (p > hi), F.lit(False)))
        .withColumn(pred, clipped)
        .drop("lo", "hi")
    )


def fill_missing(
    preds: DataFrame, ranges: DataFrame, fallback: str | None = None, pred: str = "pred", max_groups: int = 1000
) -> DataFrame:
    """Non-finite prediction: another model's value, else the property's training mean."""
    order = [finite(F.col(pred))]
    if fallback:
        order.append(finite(F.col(fallback)))
    order.append(F.col("mean"))
    small = bounded(ranges.select(PROPERTY, "mean"), max_groups)
    return preds.join(small, PROPERTY, "left").withColumn(pred, F.coalesce(*order)).drop("mean")


def validate_output(
    out: DataFrame,
    test: DataFrame,
    ranges: DataFrame,
    properties: Sequence[str],
    warn_pad: float = 0.25,
    flat: float = 1e-8,
) -> DataFrame:
    """Checks of an (id, target) table as rows (check, property, severity, n, example).

    Duplicate ids are folded map-side before the one full outer join on id; everything
    else is one aggregate.  Only failed checks give rows.
    """
    wrong = [] if out.columns == ["id", "target"] else [f"columns are {out.columns}"]
    if wrong:
        return out.sparkSession.createDataFrame(
            [("columns", None, "fail", 1, wrong[0])],
            "check string, property string, severity string, n bigint, example string",
        )
    raw = F.col("target").try_cast("double")
    value = to_number(F.col("target"))
    per_id = out.groupBy("id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(F.when(raw.isNull() | F.isnan(raw), 1).otherwise(0)).alias("_nan"),
        F.sum(F.when(raw.isNotNull() & ~F.isnan(raw) & value.isNull(), 1).otherwise(0)).alias("_inf"),
        F.min(value).alias("_v"),
    )
    joined = (
        test.select("id", PROPERTY, F.lit(1).alias("_t"))
        .join(per_id, "id", "full_outer")
        .join(bounded(ranges.select(PROPERTY, "lo", "hi"), len(properties)), PROPERTY, "left")
    )
    t, s = F.col("_t").isNotNull(), F.col("_rows").isNotNull()
    pad = F.lit(warn_pad) * (F.col("hi") - F.col("lo"))
    outside = t & ((F.col("_v") < F.col("lo") - pad) | (F.col("_v") > F.col("hi") + pad))
    checks = {
        "missing_ids": t & ~s,
        "extra_ids": s & ~t,
        "duplicate_ids": F.col("_rows") > 1,
        "not_a_number": F.col("_nan") > 0,
        "infinite": F.col("_inf") > 0,
        "outside_range": outside,
    }
    weight = {"duplicate_ids": F.col("_rows") - 1, "not_a_number": F.col("_nan"), "infinite": F.col("_inf")}
    aggs = [
        F.sum(F.when(s, F.col("_rows")).otherwise(0)).alias("_n_out"),
        F.sum(F.when(t, 1).otherwise(0)).alias("_n_test"),
        F.count(F.when(t, F.col("_v"))).alias("_n_v"),
        F.stddev_pop(F.when(t, F.col("_v"))).alias("_sd"),
        F.min(F.when(t, F.col("_v"))).alias("_lowest"),
    ]
    for name, c in checks.items():
        aggs.append(F.sum(F.when(c, weight.get(name, F.lit(1))).otherwise(0)).alias(f"{name}_n"))
        aggs.append(F.min(F.when(c, F.col("id"))).alias(f"{name}_e"))
    per = joined.groupBy(PROPERTY).agg(*aggs)

    def row(check, prop, severity, n, example):
        return F.struct(
            F.lit(check).alias("check"),
            prop.cast("string").alias(PROPERTY),
            F.lit(severity).alias("severity"),
            n.cast("long").alias("n"),
            example.cast("string").alias("example"),
        )

    by_property = [
        row("outside_range", F.col(PROPERTY), "warn", F.col("outside_range_n"), F.col("outside_range_e")),
        row(
            "constant",
            F.col(PROPERTY),
            "fail",
            F.when((F.col("_sd") < flat) & F.col(PROPERTY).isNotNull(), F.col("_n_v")).otherwise(0),
            F.col("_lowest"),
        ),
    ]
    everything = [c for c in checks if c != "outside_range"]
    total = per.agg(
        F.sum("_n_out").alias("_n_out"),
        F.sum("_n_test").alias("_n_test"),
        *[F.sum(f"{c}_n").alias(f"{c}_n") for c in everything],
        *[F.min(f"{c}_e").alias(f"{c}_e") for c in everything],
    )
    none = F.lit(None)
    overall = [row(c, none, "fail", F.col(f"{c}_n"), F.col(f"{c}_e")) for c in everything]
    overall.append(
        row("row_count", none, "fail", F.abs(F.col("_n_out") - F.col("_n_test")), F.col("_n_out"))
    )
    a = per.select(F.explode(F.array(*by_property)).alias("_r")).select("_r.*")
    b = total.select(F.explode(F.array(*overall)).alias("_r")).select("_r.*")
    return a.unionByName(b).where("n > 0")
