"""A table of rows with a unique key, kept in buckets by the key's hash and committed version by version.

Below the root, ``data/v=N/bucket=B`` holds the files that version N wrote, and ``manifest/v=N`` a row (bucket, path) for every bucket of that
version.  A change reads and writes the buckets that its keys fall in; the next manifest names the old folders for all others.  A version exists once
its manifest is written whole, so a failed or repeated change leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import written


class BucketTable:
    """``key`` is the unique column; ``buckets`` is fixed when the table is created (a manifest has a row for each, so the driver holds no more)."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str, buckets: int = 64):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        found = [s.getPath() for s in files.listStatus(path)]
        whole = [p for p in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("v=")) for p in whole)

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """Bucket -> folder of a version, the last one if none is named; empty before the first."""
        known = self.versions()
        if not known:
            return {}
        version = known[-1] if version is None else version
        rows = self.spark.read.schema("bucket int, path string").parquet(f"{self.root}/manifest/v={version:08d}").collect()  # at most ``buckets``
        return {r.bucket: r.path for r in rows}

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version, or those of some of its buckets."""
        paths = [p for b, p in sorted(self.manifest(version).items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, rows: DataFrame, order: list[Column], version: int | None = None) -> int:
        """Put ``rows`` in the place of those of their keys; of rows of one key the first by ``order``.  Rows without a key are left out.  Gives the version.

        A ``version`` that is committed already is not written again, so a repeated batch of a stream changes nothing.
        """
        return self._change(rows.filter(F.col(self.key).isNotNull()).select(*self.schema.names), order, version)

    def delete(self, keys: DataFrame, version: int | None = None) -> int:
        """Remove the rows of ``keys`` (a column of the key's name)."""
        return self._change(keys.filter(F.col(self.key).isNotNull()).select(self.key).distinct(), None, version)

    def _change(self, rows: DataFrame, order: list[Column] | None, version: int | None) -> int:
        """Write the buckets of ``rows`` anew: of a key in ``rows`` the first of them by ``order``, or nothing where that is None; held rows of other keys stay.

        Rows are shuffled once, by bucket; those of a key meet there.
        """
        known = self.versions()
        number = (known[-1] + 1 if known else 0) if version is None else version
        if number in known:
            return number
        if known and number < known[-1]:
            raise ValueError(f"version {number} is older than the last one, {known[-1]}")
        rows = rows.withColumn("bucket", self.bucket()).withColumn("_held", F.lit(False))
        touched: set[int] = set()
        if known:  # a first version has nothing to keep, so its rows needn't be read twice
            rows = written(rows)
            touched = {r.bucket for r in rows.select("bucket").distinct().collect()}  # at most ``buckets``
            rows = rows.unionByName(self.read(only=touched).withColumn("bucket", self.bucket()).withColumn("_held", F.lit(True)), allowMissingColumns=True)
        place = Window.partitionBy("bucket", self.key).orderBy("_held", *(order or []))
        first = rows.repartition("bucket").withColumn("_n", F.row_number().over(place)).filter("_n = 1")
        after = (first.filter("_held") if order is None else first).select(*self.schema.names, "bucket")
        data = f"{self.root}/data/v={number:08d}"
        after.write.mode("overwrite").partitionBy("bucket").parquet(data)  # what a failed change left is written anew
        paths = {b: p for b, p in self.manifest().items() if b not in touched} | {b: f"{data}/bucket={b}" for b in self._folders(data)}
        named = self.spark.createDataFrame(sorted(paths.items()), "bucket int, path string").coalesce(1)
        # a manifest without its mark is of a failed change; one with it is never written again
        named.write.mode("overwrite").parquet(f"{self.root}/manifest/v={number:08d}")
        return number

    def _folders(self, data: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(data)
        names = [s.getPath().getName() for s in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)]
        return [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]
