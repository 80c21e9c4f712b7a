"""Round trips through an embedded database."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from paperloom.sources import database


@pytest.fixture
def url():
    return f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"


def test_round_trip_in_parallel(spark, url):
    rows = spark.range(100_000).select("id", F.concat(F.lit("text "), "id").alias("text"), (F.col("id") % 7).alias("n"))
    database.write_table(rows, url, "chunks")
    back = database.read_table(spark, url, "chunks", "id", rows_a_partition=15_000)
    assert back.rdd.getNumPartitions() == 7
    assert back.count() == 100_000 and back.exceptAll(rows).isEmpty()
    plan = back.filter("n = 3").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(n,3)" in plan and "text" not in plan.split("ReadSchema")[-1]
    with pytest.raises(Exception, match="(?i)already exists"):
        database.write_table(rows, url, "chunks")


def test_upsert_replaces_keys_and_leaves_no_stage(spark, url):
    schema = "id long, v string"
    database.write_table(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], schema), url, "t")
    fresh = spark.createDataFrame([(2, "B"), (4, "d"), (None, "x")], schema)
    for _ in range(2):  # a repeated write changes nothing
        database.upsert_table(fresh, url, "t", "id", partitions=2)
        assert {tuple(r) for r in database.read_table(spark, url, "t", "id").collect()} == {(1, "a"), (2, "B"), (3, None), (4, "d")}
    with pytest.raises(ValueError, match="more than once"):
        database.upsert_table(spark.createDataFrame([(1, "x"), (1, "y")], schema), url, "t", "id")
    with pytest.raises(Exception):  # a column that the table lacks: the deletion is rolled back
        database.upsert_table(spark.createDataFrame([(1, "x", 1)], schema + ", w int"), url, "t", "id")
    assert {tuple(r) for r in database.read_table(spark, url, "t", "id").collect()} == {(1, "a"), (2, "B"), (3, None), (4, "d")}
    left = spark.read.format("jdbc").options(url=url, query="SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'").load().collect()
    assert [r.TABLENAME for r in left] == ["T"]


def test_empty_table(spark, url):
    database.write_table(spark.createDataFrame([], "id long, v string"), url, "t")
    assert database.read_table(spark, url, "t", "id").count() == 0
    database.upsert_table(spark.createDataFrame([], "id long, v string"), url, "t", "id")
    database.upsert_table(spark.createDataFrame([(1, "a")], "id long, v string"), url, "t", "id")
    assert database.read_table(spark, url, "t", "id").count() == 1
