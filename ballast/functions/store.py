"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

A written table survives the loss of executors and cuts the lineage of iterative jobs.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
# Drops a query's shuffle files at its end; a later use of the same plan writes them anew.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scope: ContextVar[str] = ContextVar("scope", default="")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local session may fall back to a temporary one."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
    import tempfile

    folder = tempfile.mkdtemp(prefix="ballast-")
    spark.conf.set(SETTING, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path; all tables of one application lie in one folder, to be dropped when it is done."""
    return f"{_folder(spark)}{_scope.get()}/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/ballast/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write the rows once to the shared folder and read them back.

    The shuffles behind the rows go with the end of the write, as what follows reads the table.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables written inside lie in a folder of this name, which :func:`discard` can drop alone."""
    token = _scope.set(f"/{name}")
    try:
        yield
    finally:
        _scope.reset(token)


def spread(table: DataFrame, name: str = "spread") -> DataFrame:
    """A written table for steps that compute much per row.

    One that lies in fewer pieces than there are cores is cut up once; a large table is left as it is.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return written(table.repartition(cores), name) if table.rdd.getNumPartitions() < cores else table


def _delete(spark: SparkSession, folder: str) -> None:
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(conf).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Have the driver drop what ended jobs left to its garbage: their broadcasts, shuffles and plans.

    Spark frees these only when the driver happens to collect, and its heap grows to its limit before that.
    """
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, name: str = "") -> None:
    """Drop all tables that this application has written, or those of one scope; call it once the results are stored."""
    _delete(spark, f"{_folder(spark)}/{name}" if name else _folder(spark))
