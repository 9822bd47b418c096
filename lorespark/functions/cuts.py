"""Cuts of lineage: tables written to the folder that all executors share, so that a lost executor loses nothing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and driver and executors are one process, as in tests."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "").startswith("local") or conf.get("spark.master", "").startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="lorespark-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer partitions than there are cores (a file of one row group, say) is dealt out over them; a larger one stays as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def track(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted when this process ends; an earlier end of the session leaves it to the owner of the folder."""

    def gone() -> None:
        try:
            delete(spark, path)
        except Exception:  # the session has ended
            pass

    atexit.register(gone)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    path = track(df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
