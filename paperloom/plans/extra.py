"""Lifecycle steps, chunk and conversion reports, and number scans over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, evaluate, lifecycle, search, validate, vector
from ..params import ChunkParams
from ..registry import oracle_sql_of, read, register
from . import inputs as I
from .corpus import REASON_SQL, _html_sql
from .inputs import CHUNKS, REGISTRY, sql_words
from .search import _SCORES, _found

R = f"WITH {REGISTRY}"
RC = f"WITH {REGISTRY}, {CHUNKS}"


@register("p21_extraction_picks", f"{R} SELECT id, 'processed' AS pick FROM registry WHERE status = 'processed' UNION ALL SELECT id, 'given' AS pick FROM registry WHERE source = 'web' OR vehicle_id IS NOT NULL")
def p21(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.registry_rows(spark, sf_dir)
    given = rows.filter("source = 'web' OR vehicle_id IS NOT NULL").select("id")
    picks = lifecycle.extraction_picks(rows).select("id", F.lit("processed").alias("pick"))
    return picks.unionByName(lifecycle.extraction_picks(rows, given).select("id", F.lit("given").alias("pick")))


@register("j08_inherited_ids", f"{RC} SELECT chunk_id, CAST(id AS VARCHAR) AS registry_id FROM chunks LEFT JOIN (SELECT id FROM registry WHERE status <> 'failed') ON id = doc_id")
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = I.registry_rows(spark, sf_dir).filter("status <> 'failed'")
    return lifecycle.inherit_registry(I.chunks(spark, sf_dir), good).select("chunk_id", "registry_id")


@register(
    "c06_merged_metadata",
    f"{RC}, k AS (SELECT * FROM registry WHERE status <> 'uploaded') SELECT chunk_id, status, document_type, vrn FROM chunks JOIN k ON id = doc_id "
    "UNION ALL SELECT chunk_id, 'refused' AS status, NULL AS document_type, NULL AS vrn FROM chunks WHERE doc_id NOT IN (SELECT id FROM k)",
)
def c06(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = I.registry_rows(spark, sf_dir).filter("status <> 'uploaded'")
    merged, refused = lifecycle.merge_registry(I.chunks(spark, sf_dir), known)
    none = F.lit(None).cast("string")
    return merged.select("chunk_id", "status", "document_type", "vrn").unionByName(refused.select("chunk_id", F.lit("refused").alias("status"), none.alias("document_type"), none.alias("vrn")))


@register(
    "l06_deleted_files",
    f"WITH {CHUNKS}, s AS (SELECT DISTINCT file_name AS path FROM chunks JOIN labels USING (doc_id)) "
    "SELECT file_name AS path, count(*) AS chunks, file_name IN (SELECT path FROM s) AS kept FROM chunks GROUP BY 1",
)
def l06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label stand for the files that a scan still finds; all documents for those indexed."""
    chunks = I.chunks(spark, sf_dir).withColumnRenamed("file_name", "path")
    scan = chunks.join(read(spark, sf_dir, "labels").select("doc_id").hint("merge"), "doc_id", "left_semi").select("path")
    _, left, gone = lifecycle.remove_deleted(scan, chunks.select("path").distinct(), chunks)
    count = lambda rows, kept: rows.groupBy("path").agg(F.count("*").alias("chunks")).withColumn("kept", F.lit(kept))
    return count(left, True).unionByName(count(chunks.join(gone.hint("merge"), "path", "left_semi"), False))


@register(
    "v05_result_rows",
    f"{_SCORES} SELECT query_id, CAST(id AS VARCHAR) AS id, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '...' ELSE t END AS preview, CAST(coalesce(i, 0) AS INTEGER) AS chunk_index, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank "
    "FROM r LEFT JOIN (SELECT doc_id, coalesce(text, '') AS t, nullif(doc_id % 3, 2) AS i FROM documents) ON doc_id = id WHERE rank <= 20",
)
def v05(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = F.pmod("doc_id", F.lit(3))
    chunks = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.when(index < 2, index).alias("chunk_index"))
    return vector.result_rows(_found(spark, sf_dir, 20), chunks).withColumn("score", F.round("score", 6))


@register("v07_index_check", "SELECT CASE WHEN embedding IS NULL THEN 'null_vector' WHEN len(embedding) <> 64 THEN 'wrong_dimension' WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not_finite' ELSE 'fit' END AS reason, count(*) AS n FROM embeddings GROUP BY 1")
def v07(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = vector.fit_for_index(read(spark, sf_dir, "embeddings"), 64, "embedding")
    return good.select(F.lit("fit").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@register("p07_null_bytes", f"WITH {CHUNKS} SELECT CASE WHEN contains(text, chr(0)) THEN 'null_bytes' WHEN length(trim(text)) < 10 THEN 'too_short' ELSE 'valid' END AS reason, count(*) AS n FROM chunks GROUP BY 1")
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.reason_counts(I.chunks(spark, sf_dir), validate.null_byte_reason(F.col("text")))


@register(
    "c05_chunk_report",
    f"WITH {CHUNKS}, r AS (SELECT doc_id, length(text) AS n, {REASON_SQL} = 'valid' AS ok FROM chunks) SELECT count(*) AS chunks, count(*) FILTER (ok) AS valid, round(count(*) FILTER (ok) / count(*), 6) AS retention, "
    "round(count(*) FILTER (ok) / count(DISTINCT doc_id), 6) AS valid_per_document, round(CAST(sum(n) FILTER (ok) AS DOUBLE) / sum(n), 6) AS efficiency FROM r",
)
def c05(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, n = validate.chunk_reason(F.col("text")).isNull(), F.length("text")
    return I.chunks(spark, sf_dir).agg(
        F.count("*").alias("chunks"),
        F.count_if(ok).alias("valid"),
        F.round(F.count_if(ok) / F.count("*"), 6).alias("retention"),
        F.round(F.count_if(ok) / F.countDistinct("doc_id"), 6).alias("valid_per_document"),
        F.round(F.sum(F.when(ok, n)) / F.sum(n), 6).alias("efficiency"),
    )


@register("a42_chunk_types")
def a42(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = chunking.convert_pages(read(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), F.col("markdown").alias("text"))
    return chunking.structure_chunks(pages, 200).groupBy("doc_id", "chunk_type").agg(F.count("*").alias("n"), F.sum(F.length("chunk_text")).alias("chars"))


@register(
    "a25_conversion_log",
    f"WITH m AS (SELECT length(html) AS size, length({_html_sql('coalesce(html, ' + chr(39) * 2 + ')')}) AS n FROM pages) SELECT CASE WHEN n < 10 THEN 'rejected' ELSE 'converted' END AS verdict, count(*) AS files, "
    "CAST(sum(size) AS BIGINT) AS original_chars, CAST(sum(n) AS BIGINT) AS markdown_chars, round(avg(n), 6) AS mean FROM m GROUP BY 1",
)
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = chunking.convert_pages(read(spark, sf_dir, "pages")), F.length("markdown")
    return rows.groupBy("verdict").agg(F.count("*").alias("files"), F.sum("original_size").alias("original_chars"), F.sum(n).alias("markdown_chars"), F.round(F.avg(n), 6).alias("mean"))


@register("o05_timeline", "SELECT page_id, url, length(html) AS size FROM pages ORDER BY page_id DESC NULLS LAST LIMIT 20")
def o05_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "url", F.length("html").alias("size")).orderBy(F.desc_nulls_last("page_id")).limit(20)


@register("o05_worst_quality", f"SELECT doc_id, score FROM ({oracle_sql_of('f07_quality_score')}) ORDER BY score, doc_id LIMIT 20")
def o05_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.documents(spark, sf_dir).select("doc_id", T.quality_score(F.col("text")).alias("score"))
    return rows.orderBy("score", "doc_id").limit(20)


@register("o07_sorted_documents", f"WITH {CHUNKS} SELECT file_name, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM chunks GROUP BY 1 ORDER BY chunks DESC, lower(file_name) LIMIT 50")
def o07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.chunks(spark, sf_dir).groupBy("file_name").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))
    return rows.orderBy(F.desc("chunks"), F.lower("file_name")).limit(50)


@register(
    "c03_fallback_chunks",
    f"WITH d AS (SELECT doc_id, lang, len({sql_words(chr(34) + 'text' + chr(34))}) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN lang = 'en' THEN greatest(1, CAST(ceil((n - 20) / 80) AS INTEGER)) ELSE greatest(1, CAST(ceil((n - 128) / 384) AS INTEGER)) END AS chunks FROM d WHERE n > 0",
)
def c03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one language have chunks of a smaller size already; the rest fall back."""
    docs = I.documents(spark, sf_dir).select("doc_id", "text", "lang")
    done = chunking.word_windows(docs.filter("lang = 'en'").drop("lang"), ChunkParams(size=100, overlap=20))
    return chunking.with_fallback(docs.drop("lang"), done).groupBy("doc_id").agg(F.count("*").cast("int").alias("chunks"))


@register("r20_search")
def r20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage from the benchmark's phrases to response rows, on what the searches find in all chunks; tested against brute force."""
    chunks = I.chunks(spark, sf_dir).select("chunk_id", "file_name", "chunk_index", "text")
    return search.responses(search.search(I.search_queries(spark, sf_dir), chunks))


@register("e04_search_summary")
def e04_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, reciprocal rank and pass rate of that search."""
    chunks = I.chunks(spark, sf_dir).select("chunk_id", "file_name", "chunk_index", "text")
    return evaluate.summary(search.measured(search.search(I.search_queries(spark, sf_dir), chunks)), F.lit(0.5))
