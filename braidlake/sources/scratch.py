"""Cutting the lineage of iterative plans in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a session on one machine gets a temporary folder and a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="braidlake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read from a checkpoint: its plan is a scan, however it came about."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


_made: list[tuple[SparkSession, str]] = []


def temporary(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted when the interpreter ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _delete_made() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the JVM may be gone
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
