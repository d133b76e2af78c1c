"""Exact quantiles of large groups.

Spark's ``percentile`` keeps every distinct value of a group in one reducer.  The exact answer
needs only the two order statistics around the wanted rank: a mergeable quantile sketch (KLL) brackets
them, one aggregate counts what lies below the bracket and what lies inside, and the bracket is
sketched anew until so few distinct values are left inside that one task sorts them.  The values are written once, whatever it
cost to compute them; the steps read that table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coobs.plans.joins import lookup
from coobs.session import cut_lineage

#: Sketch size (error about 1.7 / k of the ranks), and how far beyond it a bracket reaches.
SKETCH_K = 800
MARGIN = 4.0 / SKETCH_K
#: Steps between the quantiles that are read off a sketch.
GRID = 400
#: Distinct values of a bracket that one task sorts.
SORTED = 50_000
LEAST, MOST = float("-inf"), float("inf")


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    wanted: Mapping[str, float],
    max_groups: int,
) -> DataFrame:
    """One row per group with the linearly interpolated quantiles ``{name: q}``.

    A bracket ``lo <= v <= hi`` always holds both wanted order statistics: its counts are exact, and a new one is
    taken only where they say so; else the next attempt reaches further.  Equal values are one entry
    whatever their number, so a bracket that ties keep from shrinking is small as well.  Not-a-number
    values are greater than all others and not sketched: quantiles among very many of them are sorted in one task.
    """
    group = list(group)
    keys = group or ["_all"]
    rows = df if group else df.withColumn("_all", F.lit(0))
    # every step reads them again, so they are computed once
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    rows = cut_lineage(rows, "quantile_values")
    per = [*keys, "q"]
    asked = F.array(*[F.struct(F.lit(n).alias("q"), F.lit(float(p)).alias("p")) for n, p in wanted.items()])
    # one small row per (group, quantile); ranks count from 0
    state = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_n", F.explode(asked).alias("_q")).select(*keys, "_n", "_q.*")
    pos = F.col("p") * (F.col("_n") - 1)
    state = state.select(
        *per, F.floor(pos).cast("bigint").alias("_low"), F.ceil(pos).cast("bigint").alias("_high"), (pos - F.floor(pos)).alias("_f"),
        F.lit(LEAST).alias("lo"), F.lit(float("nan")).alias("hi"), F.lit(0).cast("bigint").alias("_below"), F.col("_n").alias("_in"), F.lit(False).alias("_stuck"), F.lit(MARGIN).alias("_margin"),
    )
    state = cut_lineage(state, "quantile_brackets")
    bound = max_groups * len(wanted)
    while True:
        open_ = state.where((F.col("_in") > SORTED) & ~F.col("_stuck"))
        if open_.isEmpty():
            break
        inside = _inside(rows, open_, keys, bound)
        sketch = inside.groupBy(*per).agg(F.kll_sketch_agg_double("_v", F.lit(SKETCH_K)).alias("_s"))
        points = F.kll_sketch_get_quantile_double("_s", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
        at = lambda rank, to: F.get(F.col("_p"), F.least(F.greatest(to(rank * GRID), F.lit(0)), F.lit(GRID)).cast("int"))
        low, high = ((F.col(c) - F.col("_below")) / F.col("_in") for c in ("_low", "_high"))
        cut = at(low - F.col("_margin"), F.floor).alias("_a"), at(high + F.col("_margin"), F.ceil).alias("_b")
        fresh = cut_lineage(open_.join(sketch.select(*per, points.alias("_p")), per).select(*per, *cut), "quantile_cuts")
        tried = open_.join(fresh, per)
        # exact counts of the three parts, for the bracket that is tried
        counted = (
            _inside(rows, tried, keys, bound, "_a", "_b")
            .groupBy(*per)
            .agg(F.sum((F.col("_v") < F.col("_a")).cast("bigint")).alias("_left"), F.sum(((F.col("_v") >= F.col("_a")) & (F.col("_v") <= F.col("_b"))).cast("bigint")).alias("_mid"))
        )
        below = F.col("_below") + F.col("_left")
        fits = (F.col("_low") >= below) & (F.col("_high") < below + F.col("_mid"))
        moved = tried.join(counted, per).select(
            *per, "_low", "_high", "_f",
            F.when(fits, F.col("_a")).otherwise(F.col("lo")).alias("lo"),
            F.when(fits, F.col("_b")).otherwise(F.col("hi")).alias("hi"),
            F.when(fits, below).otherwise(F.col("_below")).alias("_below"),
            F.when(fits, F.col("_mid")).otherwise(F.col("_in")).alias("_in"),
            # ties alone keep a bracket from shrinking; and there is no wider one than all values
            F.when(fits, F.col("_mid") >= F.col("_in")).otherwise(F.col("_margin") >= 1).alias("_stuck"),
            F.when(fits, F.lit(MARGIN)).otherwise(F.col("_margin") * 4).alias("_margin"),
        )
        done = state.join(open_.select(*per), per, "left_anti")
        state = cut_lineage(done.unionByName(moved), "quantile_brackets")
    # equal values fold into one entry map-side
    entries = _inside(rows, state, keys, bound, "_low", "_high", "_f", "_below").groupBy(*per, "_low", "_high", "_f", "_below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*per).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = entries.withColumn("_to", F.col("_below") + F.sum("_c").over(w)).withColumn("_from", F.col("_to") - F.col("_c"))
    value_at = lambda rank: F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))
    found = placed.groupBy(*per).agg(value_at(F.col("_low")).alias("_a"), value_at(F.col("_high")).alias("_b"), F.max("_f").alias("_f"))
    # one order statistic is the quantile itself, also where it is infinite
    found = found.withColumn("_x", F.when((F.col("_f") == 0) | (F.col("_a") == F.col("_b")), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")))
    out = found.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == n, F.col("_x"))).alias(n) for n in wanted])
    return out if group else out.drop("_all")


def _inside(rows: DataFrame, brackets: DataFrame, keys: Sequence[str], bound: int, *carry: str) -> DataFrame:
    """Each value once per bracket of its group that holds it, with ``carry`` columns of the bracket.

    The brackets of a group are one array, so a row meets one small row.
    """
    held = ["q", "lo", "hi", *carry]
    lists = brackets.groupBy(*keys).agg(F.collect_list(F.struct(*held)).alias("_qs"))
    met = lookup(rows, lists, list(keys), bound=bound, how="inner")
    v = F.col("_v")
    within = F.filter("_qs", lambda b: (v >= b["lo"]) & (v <= b["hi"]))
    return met.select(*keys, "_v", F.explode(within).alias("_q")).select(*keys, "_v", "_q.*")
