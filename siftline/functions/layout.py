"""Where rows lie, and folders that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table for each core, as the planner estimates them, below which its rows are dealt anew: a small file has
#: few row groups, so few tasks.
SMALL = 2 << 20

_made: dict[str, str] = {}


def spread(df: DataFrame) -> DataFrame:
    """A small table's rows over all cores. Larger tables have row groups for every core and are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if SMALL // 64 < size < SMALL * cores else df


def shared_folder(spark: SparkSession) -> str:
    """A folder below the shared checkpoint folder; a temporary one only where the session names none."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="siftline-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    path = f"{base.rstrip('/')}/siftline-feeds-{sc.applicationId}"
    if path not in _made:
        _made[path] = path
        atexit.register(_forget, spark, path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """A path of any of Spark's file systems, and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone already
        pass
