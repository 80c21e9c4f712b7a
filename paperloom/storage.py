"""Steps written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; on one machine, where that is unset, below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            base = set_dir.get()
        elif spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    return f"{base}/step-{uuid.uuid4().hex}"


def written(rows: DataFrame, path: str | None = None, rows_a_file: int = 0) -> DataFrame:
    """``rows`` written as Parquet and read back: computed once, with real sizes, and safe from lost executors.

    Spark decodes up to 4,096 rows of a file at a time, however large they are; ``rows_a_file`` bounds what rows of some MB take.
    """
    path = path or shared_dir(rows.sparkSession)
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
