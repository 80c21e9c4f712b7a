"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (tests on one machine) is a temporary folder set.  Raises where executors could not see one.  Folders
    stay until the cluster clears that place: results are read from them as long as they are used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            base = jvm_dir.get()
        else:
            import tempfile

            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base}/loom-{uuid.uuid4().hex}"


def materialize(df: DataFrame, mode: str = "overwrite") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and gives real sizes."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.mode(mode).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Have each step's shuffle files removed once it is written.  Only for steps that run inside: what is returned lazily may be read more than once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ascii_lower(c):
    """Lower-case A-Z only.  ``lower`` is the cheap way where every character is one byte."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))
