"""Writers: validated outputs, prediction store, reusable stages, run records."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coobs.functions.numeric import finite

RUN_SCHEMA = T.StructType(
    [
        T.StructField("config", T.StringType()),
        T.StructField("seed", T.LongType()),
        T.StructField("macro_r2", T.DoubleType()),
        T.StructField("per_property", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("per_property_std", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("noise_floor", T.DoubleType()),
        T.StructField("wall_seconds", T.DoubleType()),
        T.StructField("run_at", T.StringType()),
    ]
)


#: Models that a task of the prediction store keeps files open for, and the bytes that one file gathers before it writes them.
OPEN_MODELS = 16
STORE_BLOCK = 32 << 20


class OutputRejected(ValueError):
    """The output failed a check; nothing was written."""


def write_output(out: DataFrame, test: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Write (id, target) after row-count, finiteness and unique-id checks.

    ``out`` is computed once: its rows go to a folder beside ``path`` and are counted on the way,
    and the folder takes the place of ``path`` only if every check holds.  A rejected output, or a
    job that fails, leaves what was there before.
    """
    spark = out.sparkSession
    ids = out.groupBy("id").agg(
        F.count(F.lit(1)).alias("_n"), F.count(finite(F.col("target"))).alias("_ok"), F.first("target").alias("target")
    )
    joined = ids.join(test.select("id", F.lit(1).alias("_t")).distinct(), "id", "full_outer")
    seen = Observation()
    count = lambda wrong: F.coalesce(F.sum(F.when(wrong, 1).otherwise(0)), F.lit(0))
    checked = joined.observe(
        seen,
        count(F.col("_n").isNull()).alias("missing"),
        count(F.col("_t").isNull()).alias("extra"),
        count(F.col("_n") > 1).alias("duplicate"),
        count(F.col("_ok") < F.col("_n")).alias("not_finite"),
    )
    staged = f"{path.rstrip('/')}-{uuid.uuid4().hex[:12]}.staged"
    try:
        checked.select("id", "target").write.format(fmt).save(staged)
        wrong = {k: v for k, v in seen.get.items() if v}
        if wrong:
            raise OutputRejected(f"output not written: {wrong}")
        _replace(spark, staged, path)
    finally:
        _hadoop(spark, staged)[0].delete(_hadoop(spark, staged)[1], True)
    return spark.read.format(fmt).load(path)


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path, as Spark's writers see it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _replace(spark: SparkSession, staged: str, path: str) -> None:
    """Put a written folder in the place of another; the old one goes last."""
    (fs, new), (_, target) = _hadoop(spark, staged), _hadoop(spark, path)
    _, old = _hadoop(spark, f"{staged}.old")
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(new, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"cannot move {staged} to {path}")
    if had:
        fs.delete(old, True)


def differing_rows(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Of two output variants: rows, rows that differ, largest difference."""
    both = a.select("id", F.col("target").alias("_a")).join(b.select("id", F.col("target").alias("_b")), "id")
    d = F.abs(F.col("_a") - F.col("_b"))
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(d > tolerance, 1).otherwise(0)).alias("n_differ"),
        F.max(d).alias("max_diff"),
    )


def append_run(
    spark: SparkSession,
    path: str,
    config: str,
    seed: int,
    scores: DataFrame,
    macro: DataFrame,
    noise: DataFrame,
    wall_seconds: float,
) -> DataFrame:
    """Append one run record built from score tables (one row per property at most)."""
    maps = scores.agg(
        F.map_from_entries(F.collect_list(F.struct("property", "mean_r2"))).alias("per_property"),
        F.map_from_entries(F.collect_list(F.struct("property", "std_r2"))).alias("per_property_std"),
    )
    record = maps.select(
        F.lit(config).alias("config"),
        F.lit(seed).cast("long").alias("seed"),
        macro.select("macro_r2").scalar().alias("macro_r2"),
        "per_property",
        "per_property_std",
        noise.select("noise_floor").scalar().alias("noise_floor"),
        F.lit(float(wall_seconds)).alias("wall_seconds"),
        F.date_format(F.current_timestamp(), "yyyyMMdd-HHmmss").alias("run_at"),
    )
    record.write.mode("append").parquet(path)
    return spark.read.schema(RUN_SCHEMA).parquet(path)


def write_predictions(preds: DataFrame, path: str) -> DataFrame:
    """Long prediction store, partitioned by model so a blend reads only its members.

    Only the models in ``preds`` are replaced, so models are written one by one and again at will.
    A task writes up to ``OPEN_MODELS`` models side by side instead of sorting its rows by model, which would
    hold all of them in memory; a task that meets more models sorts the rows that follow.
    """
    conf, files = preds.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(files, None)
    conf.set(files, str(OPEN_MODELS))
    try:
        writer = preds.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.option("parquet.block.size", STORE_BLOCK).partitionBy("model").parquet(path)
    finally:
        conf.unset(files) if before is None else conf.set(files, before)
    return preds.sparkSession.read.parquet(path)


def signature(config: Mapping[str, object]) -> str:
    """Identity of a configuration: md5 of its sorted JSON."""
    return hashlib.md5(json.dumps(dict(config), sort_keys=True).encode()).hexdigest()[:16]


def stage_path(root: str, name: str, config: Mapping[str, object]) -> str:
    return os.path.join(root, name, f"sig={signature(config)}")


def _complete(spark: SparkSession, path: str) -> bool:
    """A committed write leaves _SUCCESS; a failed one does not."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    marker = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return bool(marker.getFileSystem(conf).exists(marker))


def run_stage(
    spark: SparkSession, root: str, name: str, config: Mapping[str, object], build: Callable[[], DataFrame]
) -> tuple[DataFrame, bool]:
    """The stage's table and whether it was reused.  Only a complete table written under
    the same configuration is reused; a failed stage is built again."""
    path = stage_path(root, name, config)
    if _complete(spark, path):
        return spark.read.parquet(path), True
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), False


def run_report(sections: Mapping[str, DataFrame], max_rows: int = 1000) -> DataFrame:
    """Small result tables as one nested JSON document (a row of text).

    A section of more than ``max_rows`` rows is no report table: it is counted first, and the
    job stops before any of its rows are gathered.
    """
    parts = None
    for name, df in sections.items():
        fits = F.when(df.agg(F.count(F.lit(1))).scalar() <= max_rows, True).otherwise(
            F.raise_error(F.lit(f"section {name} is not a report table")).cast("boolean")
        )
        checked = df.where(fits).agg(
            F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias("rows")
        ).select(F.lit(name).alias("section"), "rows")
        parts = checked if parts is None else parts.unionByName(checked)
    return parts.agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", "rows"))))).alias("report")
    )

