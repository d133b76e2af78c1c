"""Exact ranks without a task that holds a whole group.

``row_number() over (partition by property order by ...)`` sends every row of a
property to one task.  Here the order is split into buckets that refine it: rows
are counted per bucket (map-side combined), bucket offsets come from a running
sum over the small count table, and only rows of one bucket are sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_DIGITS = 3


def seeded_hash(keys: Sequence[Column | str], seed: int | str) -> Column:
    """md5 of the key columns and the seed, the source of all repeatable shuffles."""
    return F.md5(F.concat_ws("|", *keys, F.lit(str(seed))))


def seeded_uniform(keys: Sequence[Column | str], seed: int | str) -> Column:
    """A repeatable number in [0, 1) per key."""
    head = F.conv(F.substring(seeded_hash(keys, seed), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0)


def bucketed_rank(
    df: DataFrame,
    group: Sequence[str],
    levels: Sequence[Column],
    order: Sequence[Column],
    rank: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """0-based rank of each row in its group, by ``levels`` then ``order``.

    ``levels`` must sort like the wanted order (ascending); each further level
    splits the one before it.  ``total`` adds the group size.
    """
    group = list(group)
    names = [f"_l{i}" for i in range(len(levels))]
    rows = df.select("*", *[c.alias(n) for c, n in zip(levels, names)])
    counts = rows.groupBy(*group, *names).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts
    parts = []
    for i, name in enumerate(names):
        head = group + names[:i]
        level = counts.groupBy(*head, name).agg(F.sum("_n").alias("_m"))
        before = (
            Window.partitionBy(*head)
            .orderBy(name)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        cols = [F.coalesce(F.sum("_m").over(before), F.lit(0)).alias(f"_o{i}")]
        if i == 0 and total:
            cols.append(F.sum("_m").over(Window.partitionBy(*group)).alias(total))
        level = level.select(*head, name, *cols)
        offsets = level if i == 0 else level.join(offsets, group + names[:i])
        parts.append(f"_o{i}")
    # dealt first, so that the order's keys (hashes, often) are computed behind the shuffle and not moved
    dealt = rows.repartition(*group, *names)
    within = F.row_number().over(Window.partitionBy(*group, *names).orderBy(*order))
    start = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return (
        dealt.withColumn("_r", within)
        .join(offsets, group + names)
        .withColumn(rank, (start + F.col("_r") - 1).cast("long"))
        .drop("_r", *parts, *names)
    )


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    seed: int | str,
    group: Sequence[str] = (),
    rank: str = "rank",
    total: str | None = None,
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Rank by the seeded hash of ``keys``; ``16**digits`` even buckets per group."""
    h = seeded_hash(list(keys), seed)
    return bucketed_rank(
        df, group, [F.substring(h, 1, digits)], [h, *[F.col(k) for k in keys]], rank, total
    )


def hash_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int | str) -> DataFrame:
    """Exactly ``n`` rows (or all), the ones with the smallest seeded hash.

    Bucket counts tell which buckets are kept whole; only the bucket in which the
    ``n``-th row falls is ranked.
    """
    h = seeded_hash(list(keys), seed)
    rows = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, HASH_DIGITS))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        rows.groupBy("_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .where(F.col("_off") < n)
    )
    kept = rows.join(F.broadcast(buckets), "_b")
    whole = kept.where(F.col("_off") + F.col("_n") <= n)
    order = Window.partitionBy("_b").orderBy("_h", *keys)
    cut = (
        kept.where(F.col("_off") + F.col("_n") > n)
        .withColumn("_r", F.row_number().over(order))
        .where(F.col("_off") + F.col("_r") <= n)
        .drop("_r")
    )
    return whole.unionByName(cut).drop("_h", "_b", "_n", "_off")


def top_k(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per group.  Spark limits each map task to ``k`` rows per group
    before the shuffle (WindowGroupLimit), so a hot group costs ``k`` rows per task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)
