"""Structured Streaming: document ingest, upload dedupe, error-rate windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import chunking, lifecycle, validate
from ..params import CHUNK, ChunkParams
from ..sources.bucket_table import BucketTable


def prepare(docs: DataFrame, params: ChunkParams = CHUNK) -> DataFrame:
    """Clean documents into valid chunk rows; the same function serves batch and stream."""
    cleaned = docs.withColumn("text", T.clean(F.col("text")))
    chunks = chunking.word_windows(cleaned, params).withColumn("chunk_id", F.concat_ws(":", "doc_id", "chunk_index"))
    good, _ = validate.split_valid(chunks, validate.chunk_reason(F.col("chunk_text"), params.min_chars, params.min_words))
    return good.select("chunk_id", "doc_id", "chunk_index", "total_chunks", "chunk_text")


def ingest(spark: SparkSession, source: str, schema, checkpoint: str, read_current: Callable[[], DataFrame | None], write_next: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Start the ingest of parquet documents below ``source``: each batch is chunked and upserted; a repeated batch gives the same table."""

    def apply(batch: DataFrame, number: int) -> None:
        fresh, current = prepare(batch), read_current()
        merged = fresh if current is None else lifecycle.upsert(current, fresh, "chunk_id", [F.desc("chunk_text")])
        write_next(merged, number)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_into(spark: SparkSession, source: str, schema, checkpoint: str, table: BucketTable) -> StreamingQuery:
    """Start the ingest of parquet documents below ``source`` into a bucket table of chunks: a batch rewrites the buckets of its chunks alone.

    A batch is the version of its number, so one that is repeated after a failure is written once.  The table is changed by this stream only.
    """

    def apply(batch: DataFrame, number: int) -> None:
        table.upsert(prepare(batch), [F.desc("chunk_text")], version=number)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_uploads(uploads: DataFrame) -> DataFrame:
    """A stream's uploads (id, file_hash, uploaded_at), and for each content among them a row (file_hash, so_far): all its uploads up to now.

    The state store holds a count for each content, for ever.
    """
    rows = uploads.select("id", "file_hash", F.coalesce(F.col("uploaded_at").cast("long"), F.lit(-(2**63))).alias("uploaded_at"))
    counts = rows.filter("file_hash IS NOT NULL").groupBy("file_hash").agg(F.count("*").alias("so_far"))
    return rows.unionByName(counts, allowMissingColumns=True)


def first_uploads(batch: DataFrame) -> DataFrame:
    """(id, file_hash) of the first upload of each content that is new in a batch of ``counted_uploads``: the one of least (uploaded_at, id).

    A content is new if all its uploads up to now are of the batch, so later copies are told from first ones after any restart.  An upload without a
    hash is a first one.
    """
    own = F.when(F.col("file_hash").isNull(), F.monotonically_increasing_id())  # no two of those belong together
    upload = F.when(F.col("so_far").isNull(), F.struct("uploaded_at", "id"))
    found = batch.groupBy("file_hash", own.alias("own")).agg(F.min(upload).alias("first"), F.count(upload).alias("n"), F.max("so_far").alias("so_far"))
    return found.filter("file_hash IS NULL OR so_far = n").select("first.id", "file_hash")


def run_uploads(spark: SparkSession, source: str, schema, sink: str, checkpoint: str) -> None:
    """Write the first uploads among the files that are new below ``source`` to ``sink``; a batch that is repeated after a failure replaces its own rows."""

    def apply(batch: DataFrame, number: int) -> None:
        first_uploads(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = counted_uploads(spark.readStream.schema(schema).parquet(source))
    stream.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def new_uploads(stream: DataFrame, registry: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Uploads (ts, file_hash, …) whose content neither came within ``delay`` nor is in the registry."""
    fresh = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["file_hash"])
    return fresh.join(registry.select("file_hash").distinct().hint("merge"), "file_hash", "left_anti")


def error_rates(events: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts by kind in event-time windows, tumbling or sliding; late events within ``delay`` still count."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
