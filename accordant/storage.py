"""Cutting lineage through the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster.  Where it is unset and the master is local, a folder of this
process is used; where it is unset on a cluster, writing fails rather than use a machine-local folder.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables of this application, removed when the process ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="accordant-")
        _roots[app] = f"{base.rstrip('/')}/accordant-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone already
        local = path.removeprefix("file://")
        if os.path.isdir(local):
            import shutil

            shutil.rmtree(local, ignore_errors=True)


class Stage:
    """A table written to the shared folder; ``df`` reads it, ``drop`` deletes its files."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _remove(self.spark, self.path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut, and losing an executor costs no recomputation."""
    return Stage(df, name).df
