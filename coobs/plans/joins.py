"""Lookups against a table that has one row per key.

Two shapes, both exact:

* the lookup table has a bound known from its construction (closed property
  domain x folds, for instance) and the bound is small: broadcast it;
* otherwise the table grows with the data: shuffle, and spread the keys that
  hold more rows than a task should, each over as many tasks as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
#: Rows of one key that one task may hold; no more keys than ``HOT_KEYS`` are ever split.
TASK_ROWS = 1_000_000
HOT_KEYS = 100_000
#: Tasks for a key that the caller names as hot without a count.
SALTS = 64


def bounded(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose row bound is small and follows from its construction
    (properties of the closed domain x folds); a larger bound leaves the join to Spark.

    The bound is checked where the table is built: one row too many stops the job
    instead of flooding the executors.
    """
    if rows > BROADCAST_ROWS:
        return table
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    fits = F.when(n <= rows, True).otherwise(
        F.raise_error(F.concat(n.cast("string"), F.lit(f" rows in a table bounded by {rows}"))).cast("boolean")
    )
    checked = table.withColumn("_fits", fits).where("_fits").drop("_fits")
    return F.broadcast(checked)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over every core, for costly expressions on few bytes.

    A compressed file of some megabytes is one split and so one task, whatever its rows cost; Spark would
    also join small partitions again unless their number is given.
    """
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    *,
    bound: int | None = None,
    how: str = "left",
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Join ``rows`` with ``table`` (unique on ``on``); ``bound`` is a proven size."""
    on = list(on)
    if bound is not None and bound <= BROADCAST_ROWS:
        return rows.join(bounded(table, bound), on, how)
    return salted_join(rows, table, on, how=how, spread_by=spread_by)


def hot_keys(rows: DataFrame, on: Sequence[str], task_rows: int | None = None) -> DataFrame:
    """Keys with more rows than a task should hold, and the number of tasks to spread each over.

    The threshold rises with the table, so that there are at most ``HOT_KEYS`` of them.
    """
    freq = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_c"))
    total = freq.agg(F.sum("_c").alias("_t"))
    limit = F.greatest(F.lit(task_rows or TASK_ROWS), (total.scalar() / HOT_KEYS).cast("bigint"))
    return freq.where(F.col("_c") > limit).select(*on, F.ceil(F.col("_c") / limit).cast("int").alias("_salts"))


def salted_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    *,
    how: str = "left",
    spread_by: Sequence[str] = (),
    hot: DataFrame | None = None,
) -> DataFrame:
    """Equi-join that splits hot keys of ``rows``.

    The salt is a hash of ``spread_by`` (a row id, say; by default the whole row),
    never a random number, so a recomputed task gives the same rows again.
    """
    on = list(on)
    if rows.isStreaming:  # a stream cannot be counted first; its table side is static
        return rows.join(table, on, how)
    hot = hot_keys(rows, on) if hot is None else hot
    salts = F.col("_salts") if "_salts" in hot.columns else F.lit(SALTS)
    flags = F.broadcast(hot.select(*on, salts.alias("_salts")))
    spread: list[Column] = [F.col(c) for c in (spread_by or rows.columns)]
    n = F.coalesce("_salts", F.lit(1))
    left = rows.join(flags, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), n).cast("int"))
    right = table.join(flags, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))
    return left.drop("_salts").join(right.drop("_salts"), on + ["_salt"], how).drop("_salt")
