"""Written intermediate tables in the folder that all executors share, and who deletes them."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_run: ContextVar[Run | None] = ContextVar("run", default=None)
_roots: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, deleted when the interpreter ends.

    Where that setting is unset, a session on one machine (tests) gets a temporary folder; on a cluster it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="braidlake-")
        spark.conf.set("spark.checkpoint.dir", at)
    root = f"{at.rstrip('/')}/braidlake-{spark.conf.get('spark.app.id')}"
    _roots[root] = spark
    return root


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    for root, spark in _roots.items():
        with contextlib.suppress(Exception):  # the JVM may be gone
            _delete(spark, root)


class Run:
    """The tables of one call of an operator: all of them go if it fails; else those that nothing kept reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.tables, self.kept = spark, f"{folder(spark)}/{uuid.uuid4().hex}", {}, set()


@contextlib.contextmanager
def run(spark: SparkSession, whole: bool = False) -> Iterator[Run]:
    """Tables written meanwhile are in one folder. It goes if the body fails; with ``whole`` also when the body ends, but for tables given to ``keep``."""
    own = Run(spark)
    token = _run.set(own)
    try:
        yield own
    except BaseException:
        _delete(spark, own.path)
        raise
    finally:
        _run.reset(token)
    if whole:
        for path in [p for p in own.tables if p not in own.kept]:
            _delete(spark, path)


def owned(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator (docs first) whose intermediate tables are one run's. What its lazy result reads stays until the interpreter ends."""

    @functools.wraps(operator)
    def inner(docs: DataFrame, *args, **named):
        if _run.get() is not None:
            return operator(docs, *args, **named)
        with run(docs.sparkSession):
            return operator(docs, *args, **named)

    return inner


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: lineage is cut, a lost executor loses nothing.

    The shuffle files behind it are deleted once it is written, since nothing reads them again.
    """
    spark, own = df.sparkSession, _run.get()
    path = f"{own.path if own else folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if own:
        own.tables[path] = name
    out = spark.read.schema(df.schema).parquet(path)
    out._braidlake_path = path
    return out


def keep(df: DataFrame) -> DataFrame:
    """The written table outlives the run that it was written in."""
    if (own := _run.get()) is not None:
        own.kept.add(df._braidlake_path)
    return df


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        if (own := _run.get()) is not None:
            own.tables.pop(df._braidlake_path, None)
        _delete(df.sparkSession, df._braidlake_path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        k = 0
        while f"{name}_{k}" in taken:
            k += 1
        out.append(f"{name}_{k}")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
