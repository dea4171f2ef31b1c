"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only on a local master, where executors are threads of the driver, may it be unset; then
    a temporary folder is made and kept in the session's settings.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="assay-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(_drop, spark, at)
    return at.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone before its driver  # noqa: BLE001
        return


def folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/assay-{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage (a lost executor costs a read, not the work before it), keeps
    a costly scan from running twice and gives the planner the true size.
    """
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Arrow batches of at most ``rows`` in what is written meanwhile: a worker holds fewer whole texts at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
