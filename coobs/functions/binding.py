"""Evaluate a costly expression once inside a larger expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often it is used.

    A plain Column is copied wherever it is mentioned; inside a lambda over n elements
    that means n evaluations.  A lambda variable is bound.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def explode_once(df: DataFrame, keep: list[str], array: Column, name: str) -> DataFrame:
    """One row per element of a costly array expression, empty arrays dropped.

    For a plain ``explode`` the optimizer infers size and null filters from the array and
    evaluates its expression again for each; the outer form infers nothing.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
