"""Session defaults and lineage cuts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("coobs")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder, which is removed at the end: on a
    cluster the executors that read a checkpoint need not be the ones that wrote it.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # our own, so ours to remove
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later steps start from files any executor can read, with column pruning and sizes the
    planner knows, instead of computing ``df`` again.
    """
    path = scratch_path(df.sparkSession, name)
    write_table(df, path)
    return read_table(df, path)


def write_table(df: DataFrame, path: str) -> None:
    """Append ``df`` to the table at ``path``.  Shuffle files of this write alone go when it ends: nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        conf.set(CLEANUP, before)


def read_table(like: DataFrame, path: str) -> DataFrame:
    """The table at ``path`` with the columns of ``like``."""
    return like.sparkSession.read.schema(like.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``cut_lineage`` that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        for folder in {os.path.dirname(f) for f in table.inputFiles()}:
            if not re.fullmatch(r".*/tables/[^/]+-[0-9a-f]{12}", folder):
                raise ValueError(f"{folder} is no table of scratch_path")
            at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table, below the shared folder."""
    return os.path.join(shared_dir(spark), "tables", f"{name}-{uuid.uuid4().hex[:12]}")
