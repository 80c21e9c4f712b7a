"""Tables of a database over JDBC: read in ranges of a key, changed by a staged table and one transaction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_A_PARTITION = 100_000


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def read_table(spark: SparkSession, url: str, table: str, key: str, rows_a_partition: int = ROWS_A_PARTITION, **options: str) -> DataFrame:
    """``table`` in as many parallel ranges of its integer ``key`` as its count asks for; rows without a key come with the first range.

    The bounds and the count are asked of the database in one row.  Ranges split what is between the bounds evenly; a filter or a choice of columns is
    pushed to the database.
    """
    k = _quoted(key)
    source = lambda **more: spark.read.format("jdbc").options(url=url, **options, **more)
    ends = source(query=f'SELECT MIN({k}) AS "least", MAX({k}) AS "most", COUNT(*) AS "rows" FROM {table}').load().first()
    parts = -(-(ends["rows"] or 0) // rows_a_partition)
    if ends["least"] is None or parts < 2:
        return source(dbtable=table).load()
    return source(dbtable=table, partitionColumn=k, lowerBound=str(ends["least"]), upperBound=str(ends["most"] + 1), numPartitions=str(parts)).load()


def _run(spark: SparkSession, url: str, user: str | None, password: str | None, *statements: str) -> None:
    """Run statements in one transaction, from the driver; the database does the work."""
    manager = spark._jvm.java.sql.DriverManager
    connection = manager.getConnection(url, user, password) if user else manager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for sql in statements:
            statement.executeUpdate(sql)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def write_table(rows: DataFrame, url: str, table: str, **options: str) -> None:
    """``rows`` as a new table."""
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("errorifexists").save()


def upsert_table(rows: DataFrame, url: str, table: str, key: str, partitions: int = 8, **options: str) -> None:
    """Put ``rows`` in the place of those of their keys in ``table``, which has the same columns; rows without a key are left out.

    Tasks fill a staging table over ``partitions`` connections; then one transaction deletes the keys and inserts the rows, so readers see the old table or
    the new one, and a failed or repeated write leaves no half.  Keys must be unique in ``rows``: of repeated ones the transaction would keep all, so they raise.
    A task that is tried again may stage rows twice, hence the distinct keys of the stage are compared with its rows before the change.
    """
    spark = rows.sparkSession
    stage = f"stage_{uuid.uuid4().hex}"
    user, password = options.get("user"), options.get("password")
    keyed = rows.filter(F.col(key).isNotNull())
    write_table(keyed.repartition(partitions), url, stage, **options)
    k, names = _quoted(key), ", ".join(_quoted(c) for c in rows.columns)
    try:
        counts = spark.read.format("jdbc").options(url=url, query=f'SELECT COUNT(*) AS "n", COUNT(DISTINCT {k}) AS "keys" FROM {stage}', **options).load().first()
        if counts["n"] != counts["keys"]:
            raise ValueError(f"{counts['n'] - counts['keys']} rows of {key} are staged more than once")
        _run(spark, url, user, password, f"DELETE FROM {table} WHERE {k} IN (SELECT {k} FROM {stage})", f"INSERT INTO {table} ({names}) SELECT {names} FROM {stage}")
    finally:
        _run(spark, url, user, password, f"DROP TABLE {stage}")
