"""Intermediates written to the folder that all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:  # tests and single machines
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="motifmill-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path there, deleted when this process ends."""
    path = f"{shared_dir(spark)}/motifmill/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(clean)
    _made[path] = spark
    return path


def write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def keep(path: str) -> None:
    """Leave a written table when this process ends."""
    _made.pop(path, None)


def drop(path: str, spark: SparkSession | None = None) -> None:
    spark = _made.pop(path, None) or spark or SparkSession.getActiveSession()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean() -> None:
    for path in list(_made):
        try:
            drop(path)
        except Exception:  # at exit the session may be gone
            _made.pop(path, None)
