"""Repeatable folds: balanced within a property, grouped by entity, or hash-only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coobs import ENTITY, PROPERTY
from coobs.plans.joins import salted_join
from coobs.plans.ranking import hash_rank, seeded_hash

FOLDS = 10
SMALL_FOLDS = 15
SMALL_ROWS = 400


def adaptive_folds(n: Column, base: int = FOLDS) -> Column:
    """15 folds below 400 rows, else ``base``; always within [2, n]."""
    k = F.when(n < SMALL_ROWS, F.lit(SMALL_FOLDS)).otherwise(F.lit(base))
    return F.greatest(F.lit(2), F.least(k, n))


def property_folds(df: DataFrame, k: int | None = FOLDS, seed: int = 42, exact: bool = True) -> DataFrame:
    """Fold per row within its property.  ``k=None`` is adaptive, then clamped to [2, n].

    exact: sizes differ by at most one (rank in hash order modulo k).
    Otherwise hash modulo k: no shuffle, sizes only nearly equal.
    """
    if not exact:
        if k is None:
            raise ValueError("hash folds need a fixed k")
        head = F.conv(F.substring(seeded_hash([ENTITY], seed), 1, 8), 16, 10).cast("bigint")
        return df.withColumn("fold", F.pmod(head, F.lit(k)).cast("int"))
    ranked = hash_rank(df, [ENTITY], seed, group=[PROPERTY], rank="_rank", total="_total")
    if k is None:
        folds = adaptive_folds(F.col("_total"))
    else:
        folds = F.greatest(F.lit(2), F.least(F.lit(k), F.col("_total")))
    return ranked.withColumn("fold", F.pmod("_rank", folds).cast("int")).drop("_rank", "_total")


def grouped_folds(df: DataFrame, k: int = FOLDS, seed: int = 42) -> DataFrame:
    """Fold per entity over the whole table: an entity never straddles a split."""
    entities = hash_rank(df.select(ENTITY).distinct(), [ENTITY], seed, rank="_rank")
    table = entities.select(ENTITY, F.pmod("_rank", F.lit(k)).cast("int").alias("fold"))
    return salted_join(df, table, [ENTITY])


def grouped_property_folds(df: DataFrame, key: str = ENTITY, k: int = FOLDS, seed: int = 42) -> DataFrame:
    """Grouped folds within each property, k = min(k, groups); one group means fold 0."""
    groups = df.select(PROPERTY, key).distinct()
    ranked = hash_rank(groups, [key], seed, group=[PROPERTY], rank="_rank", total="_total")
    folds = F.greatest(F.lit(1), F.least(F.lit(k), F.col("_total")))
    table = ranked.select(PROPERTY, key, F.pmod("_rank", folds).cast("int").alias("fold"))
    return salted_join(df, table, [PROPERTY, key])


def straddling(df: DataFrame, group: list[str]) -> DataFrame:
    """Groups that span more than one fold, or rows without a fold: must be empty."""
    return (
        df.groupBy(*group)
        .agg(
            F.min("fold").alias("lowest"),
            F.max("fold").alias("highest"),
            F.sum(F.when(F.col("fold").isNull(), 1).otherwise(0)).alias("n_unassigned"),
        )
        .where("lowest <> highest or n_unassigned > 0")
    )


def fold_partner_availability(df: DataFrame, scheme: str) -> DataFrame:
    """Share of validation rows whose entity has another property in the training part.

    A partner row of the same entity stays in training when its fold differs (grouped:
    never) or, with per-property folds, whenever the property differs: only the row's own
    property loses its fold.
    """
    per_entity = df.groupBy(ENTITY).agg(F.count(F.lit(1)).alias("_rows"))
    per_fold = df.groupBy(ENTITY, "fold").agg(F.count(F.lit(1)).alias("_same"))
    rows = df.join(per_entity, ENTITY).join(per_fold, [ENTITY, "fold"])
    if scheme == "per_property":
        partners = F.col("_rows") - 1
    elif scheme == "grouped":
        partners = F.col("_rows") - F.col("_same")
    else:
        raise ValueError(f"unknown fold scheme {scheme!r}")
    return rows.groupBy(PROPERTY).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.when(partners > 0, 1.0).otherwise(0.0)).alias("share_with_partner"),
    )
