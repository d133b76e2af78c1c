"""Leave-fold-out statistics by subtraction (one aggregate instead of K refits).

Per (keys, fold) the centred second moments of a few columns are aggregated once;
for every fold the moments of all *other* folds follow in closed form.  Everything
is re-centred on the mean over all folds first, which keeps the subtraction free of
cancellation between large raw sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


FLAT = 1e-12  # a predictor with a smaller standard deviation is constant


def _pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(cols) for b in cols[i:]]


def mean_of(c: str) -> str:
    return f"mean_{c}"


def moment_of(a: str, b: str) -> str:
    return f"m_{a}_{b}"


def fold_moments(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """n, means and centred moments of the rows where all of ``cols`` are known.

    A fold without such rows still gets a (zero) entry: its rows may need the
    statistics of the other folds.
    """
    known = F.lit(True)
    for c in cols:
        known = known & F.col(c).isNotNull()
    masked = df.select(*keys, *[F.when(known, F.col(c).cast("double")).alias(c) for c in cols])
    n = F.count(cols[0]).cast("double")
    zero = F.lit(0.0)
    aggs = [n.alias("n")]
    aggs += [F.coalesce(F.avg(c), zero).alias(mean_of(c)) for c in cols]
    aggs += [
        F.coalesce((F.var_pop(a) if a == b else F.covar_pop(a, b)) * n, zero).alias(moment_of(a, b))
        for a, b in _pairs(cols)
    ]
    return masked.groupBy(*keys).agg(*aggs)


def pooled(moments: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Moments over all folds, from the per-fold moments."""
    w = Window.partitionBy(*keys)
    centred = moments.select("*", *_centres(w, cols))
    return (
        centred.groupBy(*keys)
        .agg(
            F.sum("n").alias("_n"),
            *[F.max(f"_c_{c}").alias(f"_c_{c}") for c in cols],
            *[F.sum(_about(a, b)).alias(f"_s_{a}_{b}") for a, b in _pairs(cols)],
        )
        .select(
            *keys,
            F.col("_n").alias("n"),
            *[F.col(f"_c_{c}").alias(mean_of(c)) for c in cols],
            *[F.col(f"_s_{a}_{b}").alias(moment_of(a, b)) for a, b in _pairs(cols)],
        )
    )


def leave_fold_out(
    moments: DataFrame, keys: Sequence[str], fold: str, cols: Sequence[str]
) -> DataFrame:
    """For every (keys, fold) the moments of the group's rows outside that fold."""
    w = Window.partitionBy(*keys)
    n_rest = F.sum("n").over(w) - F.col("n")
    shifted = moments.select(
        "*",
        n_rest.alias("_nr"),
        *_centres(w, cols),
    )
    shifted = shifted.select(
        "*",
        *[
            (-F.col("n") * (F.col(mean_of(c)) - F.col(f"_c_{c}"))).alias(f"_d_{c}") for c in cols
        ],
        *[_about(a, b).alias(f"_own_{a}_{b}") for a, b in _pairs(cols)],
    )
    return shifted.select(
        *keys,
        fold,
        F.col("_nr").alias("n"),
        *[
            (F.col(f"_c_{c}") + _safe_div(F.col(f"_d_{c}"), F.col("_nr"))).alias(mean_of(c))
            for c in cols
        ],
        *[
            (
                F.sum(f"_own_{a}_{b}").over(w)
                - F.col(f"_own_{a}_{b}")
                - _safe_div(F.col(f"_d_{a}") * F.col(f"_d_{b}"), F.col("_nr"))
            ).alias(moment_of(a, b))
            for a, b in _pairs(cols)
        ],
    )


def _centres(w, cols: Sequence[str]) -> list[Column]:
    total = F.sum("n").over(w)
    return [
        F.coalesce(_safe_div(F.sum(F.col("n") * F.col(mean_of(c))).over(w), total), F.lit(0.0)).alias(
            f"_c_{c}"
        )
        for c in cols
    ]


def _about(a: str, b: str) -> Column:
    """A fold's second moment about the all-fold mean."""
    da = F.col(mean_of(a)) - F.col(f"_c_{a}")
    db = F.col(mean_of(b)) - F.col(f"_c_{b}")
    return F.col(moment_of(a, b)) + F.col("n") * da * db


def _safe_div(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def slope(x: str = "x", y: str = "y") -> Column:
    """Least-squares slope of y on x; null where x does not vary."""
    sxx = F.col(moment_of(x, x))
    varies = (F.col("n") > 0) & (sxx > 0) & (sxx >= F.col("n") * F.lit(FLAT * FLAT))
    return F.when(varies, F.col(moment_of(x, y)) / sxx)


def intercept(x: str = "x", y: str = "y", a: Column | None = None) -> Column:
    a = slope(x, y) if a is None else a
    return F.col(mean_of(y)) - a * F.col(mean_of(x))
