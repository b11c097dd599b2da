"""Session defaults, and tables in the folder that all machines share."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(name: str = "lodestrata", **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword arguments are settings, with ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary one where it is unset in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestrata-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder, removed when the session's JVM ends."""
    where, context = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}", spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def cut(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write to the shared folder and read back: an iteration's plan stays short, and a lost
    executor costs no recomputation."""
    where = shared_path(df.sparkSession, tag)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def spread(rows: DataFrame) -> DataFrame:
    """A scan of few splits dealt out to all cores, for work that takes long for each row; a scan
    of at least as many splits as there are cores stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for a context: they may start
    where it can't be imported from."""
    context = spark.sparkContext
    if not getattr(context, "_lodestrata_shipped", False):
        package = Path(__file__).resolve().parent
        if package.parent.is_dir():  # not when it is imported from an archive
            context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/lodestrata", "zip", package.parent, package.name))
        context._lodestrata_shipped = True
