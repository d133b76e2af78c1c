"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coobs.llm.tables import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``comp``) for every node of an edge; ``comp`` is its least reachable node.

    Minima combine before the shuffle and the join that brings them back is a plain equi-join, so a
    node with very many edges is split by the adaptive planner.  The number of rounds grows
    with the logarithm of the longest path.
    """
    lo, hi = F.least(a, b).alias("v"), F.greatest(a, b).alias("u")
    e = cut_lineage(edges.select(hi, lo).where("u <> v").distinct(), "cc_edges")
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut_lineage(large, "cc_large")
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(m, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut_lineage(small, "cc_small")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
