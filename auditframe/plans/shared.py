"""Intermediate tables in the folder that driver and executors share.

A written table cuts the plan that made it, survives a lost executor, and is dropped when the process ends or earlier.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; in local mode without that setting, one of this process."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="auditframe-")
    return _LOCAL["dir"]


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _MADE.pop(path, None)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def saved(frame: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder."""
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_MADE.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001, PERF203 - the JVM may be gone; what is left is the cluster's to clean
            break
    if "dir" in _LOCAL:
        shutil.rmtree(_LOCAL["dir"], ignore_errors=True)
