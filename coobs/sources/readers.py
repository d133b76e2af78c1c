"""Readers: labelled measurements, query rows, an optional archive, a corpus column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coobs import ENTITY, PROPERTY, VALUE
from coobs.functions.numeric import finite
from coobs.functions.text import compact_key
from coobs.operators.tables import assert_domain, normalise_labels, reconcile, require_columns

LABEL_SCHEMA = T.StructType(
    [
        T.StructField(ENTITY, T.StringType()),
        T.StructField(PROPERTY, T.StringType()),
        T.StructField(VALUE, T.DoubleType()),
    ]
)


def load(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A parquet, csv, orc or json table; csv needs its schema, nothing is inferred."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        if schema is None:
            raise ValueError("csv needs an explicit schema")
        reader = reader.option("header", True)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def labelled(
    df: DataFrame,
    domain: Sequence[str],
    key: Callable[[Column], Column] = compact_key,
    dedupe: bool = True,
) -> DataFrame:
    """Labelled measurements from (raw, property, value): checked, keyed, non-finite
    values to NULL, optionally one row per (entity, property)."""
    require_columns(df, ["raw", PROPERTY, VALUE])
    keyed = assert_domain(df, domain).select(
        "raw", key(F.col("raw")).alias(ENTITY), PROPERTY, finite(F.col(VALUE)).alias(VALUE)
    )
    return reconcile(keyed) if dedupe else keyed


def query_rows(
    df: DataFrame, domain: Sequence[str], key: Callable[[Column], Column] = compact_key
) -> DataFrame:
    """Rows to predict from (id, raw, property): the same checks, no value."""
    require_columns(df, ["id", "raw", PROPERTY])
    return assert_domain(df, domain).select("id", "raw", key(F.col("raw")).alias(ENTITY), PROPERTY)


@dataclass(frozen=True)
class Adopted:
    """Outcome of trying archive candidates."""

    table: DataFrame
    ok: bool
    source: str
    reasons: tuple[str, ...]


def validate_labels(df: DataFrame, allowed: Sequence[str]) -> tuple[bool, str]:
    """One aggregate: required columns, a usable number, only allowed properties."""
    missing = sorted({ENTITY, PROPERTY, VALUE} - set(df.columns))
    if missing:
        return False, f"missing columns {missing}"
    prop = F.lower(F.trim(F.col(PROPERTY)))
    foreign = ~F.coalesce(prop.isin(*allowed), F.lit(False))
    row = df.agg(
        F.count(F.col(VALUE).try_cast("double")).alias("usable"),
        F.sum(foreign.cast("long")).alias("foreign"),
        F.min(F.when(foreign, prop)).alias("example"),
    ).first()
    if row["usable"] == 0:
        return False, "no usable values"
    if row["foreign"]:
        return False, f"{row['foreign']} rows outside {sorted(allowed)}, e.g. {row['example']}"
    return True, f"{row['usable']} usable values"


def adopt_archive(
    spark: SparkSession,
    candidates: Sequence[tuple[str, Callable[[], DataFrame]]],
    allowed: Sequence[str],
) -> Adopted:
    """The first candidate that reads and validates, normalised and averaged per key;
    otherwise an empty table.  Never fails for want of an archive."""
    reasons = []
    for name, read in candidates:
        try:
            df = read()
            ok, why = validate_labels(df, allowed)
        except Exception as e:  # an unreadable candidate is skipped by contract
            ok, why = False, f"unreadable ({type(e).__name__})"
        reasons.append(f"{name}: {why}")
        if ok:
            tidy = normalise_labels(df).groupBy(ENTITY, PROPERTY).agg(F.avg(VALUE).alias(VALUE))
            return Adopted(tidy, True, name, tuple(reasons))
    return Adopted(spark.createDataFrame([], LABEL_SCHEMA), False, "none", tuple(reasons))


def corpus_column(df: DataFrame, pattern: str) -> DataFrame:
    """Distinct non-null strings of the first column whose name contains ``pattern``
    (else the first column); only that column is read."""
    names = [c for c in df.columns if pattern.lower() in c.lower()]
    name = names[0] if names else df.columns[0]
    return df.select(F.col(name).cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()


