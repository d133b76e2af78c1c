"""Label lineage: which properties' labels a column was made from.

The registry is driver metadata kept beside a DataFrame.  A prediction column carries
the union of the lineage of everything its model consumed, labels included, so a label
cannot come back through a predicted partner.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coobs import PROPERTY, VALUE


@dataclass
class Lineage:
    uses: dict[str, frozenset[str]] = field(default_factory=dict)
    fills: dict[str, float] = field(default_factory=dict)

    def add(self, column: str, sources: Iterable[str], fill: float = 0.0) -> "Lineage":
        self.uses[column] = frozenset(sources)
        self.fills[column] = float(fill)
        return self

    def add_partners(self, properties: Sequence[str], fills: dict[str, float]) -> "Lineage":
        for p in properties:
            self.add(f"true_{p}", {p}, fills.get(p, 0.0))
            self.add(f"has_{p}", {p}, 0.0)
        return self

    def derive(self, column: str, inputs: Iterable[str], labels: Iterable[str] = (), fill: float = 0.0) -> "Lineage":
        """A column computed from other columns (a relation, a prediction, a blend)."""
        sources = set(labels)
        for c in inputs:
            sources |= self.uses.get(c, frozenset())
        return self.add(column, sources, fill)

    def leaky(self, target: str) -> list[str]:
        return [c for c, s in self.uses.items() if target in s]

    def drop_leaky(self, df: DataFrame, target: str) -> DataFrame:
        """Column guard, for one property's model."""
        return df.drop(*self.leaky(target))

    def mask_rows(self, df: DataFrame) -> DataFrame:
        """Row guard, for a model over all properties: where the row's own property is in
        a column's lineage the column takes its training fill."""
        masked = {
            c: F.when(F.col(PROPERTY).isin(*sorted(s)), F.lit(self.fills[c])).otherwise(
                F.col(c).cast("double")
            )
            for c, s in self.uses.items()
            if c in df.columns and s
        }
        return df.withColumns(masked)


def leak_report(
    block: DataFrame, lineage: Lineage, properties: Sequence[str], tolerance: float = 1e-6
) -> DataFrame:
    """Both directions of the guard per property, in one aggregate over the rows.

    leak_exists: the unguarded column reproduces the label; column_guard: no dependent
    column survives; row_guard: after masking, every own column holds its fill.
    """
    raw = [F.col(f"true_{p}").alias(f"_raw_{p}") for p in properties]
    both = lineage.mask_rows(block.select("*", *raw))
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for p in properties:
        own = F.col(PROPERTY) == p
        aggs.append(
            F.max(F.when(own, F.abs(F.col(f"_raw_{p}") - F.col(VALUE)))).alias(f"_gap_{p}")
        )
        aggs.append(
            F.sum(
                F.when(own & (F.col(f"true_{p}") != F.lit(lineage.fills[f"true_{p}"])), 1).otherwise(0)
            ).alias(f"_unmasked_{p}")
        )
    table = both.groupBy(PROPERTY).agg(*aggs)
    gap = F.coalesce(*[F.when(F.col(PROPERTY) == p, F.col(f"_gap_{p}")) for p in properties])
    left = F.coalesce(*[F.when(F.col(PROPERTY) == p, F.col(f"_unmasked_{p}")) for p in properties])
    clean = [
        p
        for p in properties
        if not [
            c
            for c in lineage.drop_leaky(block, p).columns
            if p in lineage.uses.get(c, frozenset())
        ]
    ]
    return table.where(F.col(PROPERTY).isin(*properties)).select(
        PROPERTY,
        "n_rows",
        gap.alias("max_gap"),
        (gap <= tolerance).alias("leak_exists"),
        F.col(PROPERTY).isin(*clean).alias("column_guard"),
        (left == 0).alias("row_guard"),
    )
