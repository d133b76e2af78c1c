"""Null-aware numeric expressions.

Missing is NULL and nothing else: NaN and infinities become NULL where data enters
and after each division, root or logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT32_MAX = 3.4028234663852886e38


def finite(x: Column) -> Column:
    """NaN and infinities to NULL."""
    x = x.cast("double")
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(x) & (x < inf) & (x > -inf), x)


def to_number(x: Column) -> Column:
    """Text to a finite double, NULL when it is not one."""
    return finite(x.try_cast("double"))


def clip(x: Column, lo: Column, hi: Column) -> Column:
    """Clamp to [lo, hi]; a NULL stays NULL (least/greatest alone would return a bound)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def signed_log1p(x: Column) -> Column:
    """sign(x) * ln(1 + |x|) on finite values, NULL otherwise."""
    v = finite(x)
    return F.signum(v) * F.log1p(F.abs(v))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL for a zero or missing divisor."""
    return F.when(b != 0, a / b)


def r2_from(sse: Column, sst: Column) -> Column:
    """1 - SSE/SST; NULL when the truth does not vary."""
    return F.when(sst > 0, 1 - sse / sst)
