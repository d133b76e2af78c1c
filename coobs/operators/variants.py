"""Labelled variants of a row and the invariance audits built on them.

A rewrite is a Column expression ``(sequence, i) -> sequence`` on an ARRAY<STRING>.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coobs import PROPERTY, VALUE
from coobs.functions import sequences as S
from coobs.functions.binding import explode_once
from coobs.functions.text import family
from coobs.plans.joins import bounded, spread
from coobs.plans.quantiles import exact_quantiles
from coobs.plans.ranking import hash_sample
from coobs.session import cut_lineage

Rewrite = Callable[[Column, int], Column]

AUGMENT_BELOW = 400
EXACT = 1e-9
CLOSE = 0.02
MIN_INVARIANCE = 0.90


def respell(seq: Column, i: int) -> Column:
    """Another spelling of the same sequence: case flipped from position i on."""
    return F.transform(seq, lambda t, j: F.when(j >= i, F.upper(t)).otherwise(F.lower(t)))


def translated(seq: Column, i: int) -> Column:
    return S.rotate(seq, i + 1)


def repeated(seq: Column, i: int) -> Column:
    return S.repeat_unit(seq, i + 2)


KINDS: dict[str, Rewrite] = {
    "permutational": respell,
    "translational": translated,
    "repetition": repeated,
}


def with_variants(
    rows: DataFrame, seq: str, kinds: Mapping[str, Rewrite] = KINDS, per_kind: int = 2, base: bool = True
) -> DataFrame:
    """One row per variant: kind, i, and the rewritten sequence; the base row is kind
    "base".  A row's variants are a fixed number, built and exploded in place."""
    cells = [F.struct(F.lit("base").alias("kind"), F.lit(0).alias("i"), F.col(seq).alias("variant"))] if base else []
    for name, make in kinds.items():
        for i in range(per_kind):
            cells.append(
                F.struct(F.lit(name).alias("kind"), F.lit(i).alias("i"), make(F.col(seq), i).alias("variant"))
            )
    keep = [f"`{c}`" for c in rows.columns]
    return explode_once(rows, keep, F.array(*cells), "_v").select("*", "_v.*").drop("_v")


def distinct_variants(
    rows: DataFrame, key: str, seq: str, limit: int, kinds: Mapping[str, Rewrite] = KINDS, per_kind: int = 2
) -> DataFrame:
    """Up to ``limit`` different spellings per row, the base first (row-local arrays)."""
    made = [F.col(seq)]
    for make in kinds.values():
        made += [make(F.col(seq), i) for i in range(per_kind)]
    # the fixed number of spellings is the operator's parameter
    kept = F.slice(F.array_distinct(F.array(*made)), 1, limit)
    return rows.select(key, F.posexplode(kept).alias("n", "variant"))


def augment_small(
    rows: DataFrame, seq: str, below: int = AUGMENT_BELOW, max_groups: int = 1000
) -> DataFrame:
    """Training rows plus, for properties with fewer than ``below`` rows, the twofold
    variant of each with the same value, engineered columns and parent fold."""
    sizes = rows.groupBy(PROPERTY).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < below)
    small = rows.join(bounded(sizes.select(PROPERTY), max_groups), PROPERTY, "left_semi")
    extra = small.withColumn(seq, S.repeat_unit(F.col(seq), 2)).withColumn("augmented", F.lit(True))
    return rows.withColumn("augmented", F.lit(False)).unionByName(extra)


def training_view(augmented: DataFrame, fold: int) -> DataFrame:
    return augmented.where(F.col("fold") != fold)


def validation_view(augmented: DataFrame, fold: int) -> DataFrame:
    """Never an augmented row."""
    return augmented.where((F.col("fold") == fold) & ~F.col("augmented"))


def average_variants(preds: DataFrame, key: Sequence[str]) -> DataFrame:
    return preds.groupBy(*key).agg(F.avg("pred").alias("pred"), F.count(F.lit(1)).alias("n_variants"))


def invariance_rows(
    rows: DataFrame,
    seq: str,
    key_of: Callable[[Column], Column],
    predict: Callable[[Column], Column],
    kinds: Mapping[str, Rewrite] = KINDS,
    per_kind: int = 2,
) -> DataFrame:
    """Per (row, kind, i): |prediction change|, whether the text and the key moved, and
    the scale max(|value|, 1e-9)."""
    # what the row itself has is computed once, not once per variant
    own = spread(rows).withColumns({"_pred": predict(F.col(seq)), "_spelt": S.spell(F.col(seq)), "_key": key_of(F.col(seq))})
    v = with_variants(own, seq, kinds, per_kind, base=False)
    return v.select(
        "*",
        F.abs(predict(F.col("variant")) - F.col("_pred")).alias("delta"),
        (S.spell(F.col("variant")) != F.col("_spelt")).alias("rewritten"),
        (key_of(F.col("variant")) != F.col("_key")).alias("key_moved"),
        F.greatest(F.abs(F.col(VALUE)), F.lit(1e-9)).alias("scale"),
    ).drop("_pred", "_spelt", "_key")


def invariance_audit(audit: DataFrame, max_kinds: int = 16) -> DataFrame:
    """Per kind: rows, rewritten, keys moved, median / mean / max change, median relative
    change, and whether the kind is exact (largest change at most 1e-9)."""
    # read by three aggregates and their rounds
    audit = cut_lineage(audit.select("kind", "rewritten", "key_moved", "delta", "scale"), "audit")
    moved = audit.where("rewritten")
    stats = audit.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("rewritten").cast("long")).alias("n_rewritten"),
        F.sum((F.col("rewritten") & F.col("key_moved")).cast("long")).alias("n_key_moved"),
        F.avg(F.when(F.col("rewritten"), F.col("delta"))).alias("mean_delta"),
        F.max(F.when(F.col("rewritten"), F.col("delta"))).alias("max_delta"),
    )
    q = exact_quantiles(moved, ["kind"], "delta", {"median_delta": 0.5}, max_kinds)
    r = exact_quantiles(
        moved.withColumn("_rel", F.col("delta") / F.col("scale")), ["kind"], "_rel", {"median_rel": 0.5}, max_kinds
    )
    return (
        stats.join(bounded(q, max_kinds), "kind", "left")
        .join(bounded(r, max_kinds), "kind", "left")
        .withColumn("exact", F.col("max_delta") <= EXACT)
    )


def invariance_by_property(audit: DataFrame, max_groups: int = 10_000) -> DataFrame:
    """Median change per (kind, property) on rewritten variants."""
    return exact_quantiles(
        audit.where("rewritten"), ["kind", PROPERTY], "delta", {"median_delta": 0.5}, max_groups
    )


def feature_invariance(
    rows: DataFrame,
    seq: str,
    features: Mapping[str, Callable[[Column], Column]],
    kinds: Mapping[str, Rewrite] = KINDS,
    per_kind: int = 1,
) -> DataFrame:
    """Per (kind, family): share of feature values that move by less than 2 %."""
    v = with_variants(spread(rows), seq, kinds, per_kind, base=False)
    cells = [
        F.struct(
            F.lit(n).alias("feature"),
            f(F.col(seq)).cast("double").alias("a"),
            f(F.col("variant")).cast("double").alias("b"),
        )
        for n, f in features.items()
    ]
    long = v.select("kind", F.explode(F.array(*cells)).alias("_c")).select("kind", "_c.*")
    close = F.abs(F.col("b") - F.col("a")) / (F.abs(F.col("a")) + 1e-6) < CLOSE
    return long.groupBy("kind", family(F.col("feature")).alias("family")).agg(
        F.count(F.lit(1)).alias("n_values"), F.avg(close.cast("double")).alias("share_unchanged")
    )


def key_selftest(
    rows: DataFrame,
    seq: str,
    key_of: Callable[[Column], Column],
    kinds: Mapping[str, Rewrite] = KINDS,
    per_kind: int = 2,
    minimum: float = MIN_INVARIANCE,
) -> DataFrame:
    """Per kind the rate of key(rewrite(s)) = key(s) and whether it reaches the minimum."""
    own = spread(rows).withColumn("_key", key_of(F.col(seq)))
    v = with_variants(own, seq, kinds, per_kind, base=False)
    same = (key_of(F.col("variant")) == F.col("_key")).cast("double")
    return (
        v.groupBy("kind")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(same).alias("rate"))
        .withColumn("passed", F.col("rate") >= minimum)
    )


def spelling_spread(
    rows: DataFrame,
    train: DataFrame,
    key: str,
    seq: str,
    normalise: Callable[[Column], Column],
    predict: Callable[[Column], Column],
    kinds: Mapping[str, Rewrite] = KINDS,
    per_kind: int = 2,
    max_groups: int = 1000,
) -> DataFrame:
    """Per property the prediction spread over spellings in units of the property's sd,
    with and without normalisation, and their ratio."""
    v = with_variants(spread(rows), seq, kinds, per_kind)
    per_row = v.groupBy(key, PROPERTY).agg(
        F.stddev_pop(predict(normalise(F.col("variant")))).alias("_with"),
        F.stddev_pop(predict(F.col("variant"))).alias("_without"),
    )
    sd = train.groupBy(PROPERTY).agg(F.greatest(F.stddev_samp(VALUE), F.lit(1e-9)).alias("_sd"))
    return (
        per_row.join(bounded(sd, max_groups), PROPERTY)
        .groupBy(PROPERTY)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col("_with") / F.col("_sd")).alias("spread_normalised"),
            F.avg(F.col("_without") / F.col("_sd")).alias("spread_raw"),
        )
        .withColumn(
            "ratio", F.col("spread_raw") / F.greatest(F.col("spread_normalised"), F.lit(1e-9))
        )
    )


def audit_sample(rows: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """The audit's seeded sample of exactly ``n`` rows."""
    return hash_sample(rows, n, [key], seed)


