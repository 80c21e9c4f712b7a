"""Reports and functions over documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, token_chunks, validate
from ..registry import read, register
from . import inputs as I
from .inputs import CHUNKS, sql_words

W = f"WITH {CHUNKS}"
SIZE_BANDS = ("small", "medium", "large", "very_large")


def size_band(n):
    return F.when(n < 1000, "small").when(n < 5000, "medium").when(n < 20_000, "large").otherwise("very_large")


@register("a01_document_list", f"{W} SELECT file_name, file_type, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars, max(chunk_index) AS last_index FROM chunks GROUP BY ALL")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.chunks(spark, sf_dir).groupBy("file_name", "file_type").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.max("chunk_index").alias("last_index"))


@register(
    "a02_document_detail",
    f"{W} SELECT file_name, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(length(text)), 6) AS avg_chars, max(length(text)) AS max_chars, "
    "arg_min(file_type, chunk_index) AS file_type, string_agg(CAST(chunk_index AS VARCHAR), ',' ORDER BY chunk_index) AS indices FROM chunks GROUP BY file_name",
)
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    indices = F.array_join(F.transform(F.array_sort(F.collect_list("chunk_index")), lambda i: i.cast("string")), ",")
    return I.chunks(spark, sf_dir).groupBy("file_name").agg(
        F.count("*").alias("chunks"), F.sum(n).alias("chars"), F.round(F.avg(n), 6).alias("avg_chars"), F.max(n).alias("max_chars"), F.min_by("file_type", "chunk_index").alias("file_type"), indices.alias("indices")
    )


@register("a03_corpus_totals", f"{W} SELECT count(DISTINCT file_name) AS files, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM chunks")
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.chunks(spark, sf_dir).agg(F.countDistinct("file_name").alias("files"), F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


@register("a04_chunks_per_document", f"{W} SELECT round(avg(n), 6) AS avg_chunks, min(n) AS min_chunks, max(n) AS max_chunks FROM (SELECT file_name, count(*) AS n FROM chunks GROUP BY 1)")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = I.chunks(spark, sf_dir).groupBy("file_name").agg(F.count("*").alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("avg_chunks"), F.min("n").alias("min_chunks"), F.max("n").alias("max_chunks"))


@register("a05_file_types", f"{W} SELECT coalesce(file_type, 'unknown') AS file_type, count(DISTINCT file_name) AS files FROM chunks GROUP BY 1")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.chunks(spark, sf_dir).groupBy(F.coalesce("file_type", F.lit("unknown")).alias("file_type")).agg(F.countDistinct("file_name").alias("files"))


@register(
    "a06_size_distribution",
    "WITH b AS (SELECT CASE WHEN length(coalesce(text,'')) < 1000 THEN 'small' WHEN length(coalesce(text,'')) < 5000 THEN 'medium' WHEN length(coalesce(text,'')) < 20000 THEN 'large' ELSE 'very_large' END AS band FROM documents) "
    "SELECT d.band, count(b.band) AS documents FROM (VALUES ('small'), ('medium'), ('large'), ('very_large')) AS d(band) LEFT JOIN b ON b.band = d.band GROUP BY d.band",
)
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = I.documents(spark, sf_dir).groupBy(size_band(F.length("text")).alias("band")).agg(F.count("*").alias("documents"))
    domain = spark.sql("SELECT explode(array('small', 'medium', 'large', 'very_large')) AS band")
    return domain.join(n.hint("shuffle_hash"), "band", "left").fillna(0, ["documents"])


@register("a07_chunk_lengths", f"{W} SELECT min(length(text)) AS shortest, max(length(text)) AS longest, round(avg(length(text)), 6) AS mean, round(quantile_cont(length(text), 0.5), 6) AS median FROM chunks")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return I.chunks(spark, sf_dir).agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"), F.round(F.percentile(n, 0.5), 6).alias("median"))


@register("a08_chunk_histogram", f"{W} SELECT CASE WHEN length(text) > 1000 THEN 'excellent' WHEN length(text) >= 500 THEN 'good' WHEN length(text) >= 200 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n FROM chunks GROUP BY 1")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    band = F.when(n > 1000, "excellent").when(n >= 500, "good").when(n >= 200, "fair").otherwise("poor")
    return I.chunks(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@register("a09_top_files", f"{W} SELECT file_name, count(*) AS chunks FROM chunks GROUP BY 1 ORDER BY chunks DESC, file_name LIMIT 10")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the limit is the feature."""
    return I.chunks(spark, sf_dir).groupBy("file_name").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "file_name").limit(10)


@register(
    "a10_most_chunks",
    f"{W} SELECT file_name, count(*) AS chunks, min(chunk_index) AS first_index, max(chunk_index) AS last_index, CAST(sum(length(text)) AS BIGINT) AS chars, round(avg(length(text)), 6) AS avg_chars "
    "FROM chunks GROUP BY 1 ORDER BY chunks DESC, file_name LIMIT 20",
)
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    rows = I.chunks(spark, sf_dir).groupBy("file_name").agg(F.count("*").alias("chunks"), F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"), F.sum(n).alias("chars"), F.round(F.avg(n), 6).alias("avg_chars"))
    return rows.orderBy(F.desc("chunks"), "file_name").limit(20)


@register("a11_count_histogram", f"{W} SELECT n AS chunks, count(*) AS files FROM (SELECT file_name, count(*) AS n FROM chunks GROUP BY 1) GROUP BY 1")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.chunks(spark, sf_dir).groupBy("file_name").agg(F.count("*").alias("chunks")).groupBy("chunks").agg(F.count("*").alias("files"))


@register(
    "a12_node_statistics",
    f"{W} SELECT count(*) AS nodes, round(avg(length(text)), 6) AS avg_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(avg(len({sql_words('text')})), 6) AS avg_words, "
    "count(DISTINCT file_name) AS files, round(count(*) / count(DISTINCT file_name), 6) AS per_file FROM chunks",
)
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return I.chunks(spark, sf_dir).agg(
        F.count("*").alias("nodes"), F.round(F.avg(n), 6).alias("avg_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.round(F.avg(F.size(T.words(F.col("text")))), 6).alias("avg_words"),
        F.countDistinct("file_name").alias("files"), F.round(F.count("*") / F.countDistinct("file_name"), 6).alias("per_file"),
    )


@register(
    "a13_chunk_quartiles",
    f"{W}, c AS (SELECT file_name, count(*) AS n FROM chunks GROUP BY 1), s AS (SELECT list(n ORDER BY n) AS l FROM c) "
    "SELECT l[len(l) // 4 + 1] AS q1, l[len(l) // 2 + 1] AS q2, l[3 * len(l) // 4 + 1] AS q3 FROM s",
)
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles by index: from a histogram of counts, so no window orders all files."""
    per_file = I.chunks(spark, sf_dir).groupBy("file_name").agg(F.count("*").alias("n"))
    hist = per_file.groupBy("n").agg(F.count("*").alias("files"))
    up_to = hist.select("n", F.sum("files").over(Window.orderBy("n")).alias("below"), F.sum("files").over(Window.partitionBy()).alias("total"))
    at = lambda share: F.min(F.when(F.col("below") > F.floor(F.col("total") * share / 4), F.col("n")))
    return up_to.agg(at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"))


REASON_SQL = f"""CASE WHEN trim(text) = '' THEN 'empty' WHEN length(trim(text)) < 50 THEN 'too_short' WHEN len({sql_words('text')}) <= 5 THEN 'too_few_words'
  WHEN regexp_matches(regexp_replace(trim(text), '\\s+', '', 'g'), '^[0-9]+$') THEN 'digits_only' ELSE 'valid' END"""


@register(
    "a14_chunk_quality",
    f"{W}, r AS (SELECT {REASON_SQL} AS reason FROM chunks) SELECT count(*) AS total, count(*) FILTER (reason = 'valid') AS valid, round(count(*) FILTER (reason = 'valid') / count(*), 6) AS success_rate FROM r",
)
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = validate.chunk_reason(F.col("text")).isNull()
    return I.chunks(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.round(F.count_if(ok) / F.count("*"), 6).alias("success_rate"))


@register("a15_invalid_chunks", f"{W}, r AS (SELECT file_name, {REASON_SQL} AS reason FROM chunks) SELECT file_name, reason, count(*) AS n FROM r WHERE reason <> 'valid' GROUP BY ALL")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.reason_counts(I.chunks(spark, sf_dir), validate.chunk_reason(F.col("text")), "file_name").filter("reason <> 'valid'")


@register(
    "a16_content_issues",
    f"{W} SELECT count(*) FILTER (contains(text, chr(65533))) AS encoding, count(*) FILTER (length(text) < 50) AS short, count(*) FILTER (length(text) > 1536) AS long, "
    "count(*) - count(DISTINCT text) AS duplicates, count(*) FILTER (file_type IS NULL) AS no_type FROM chunks",
)
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return I.chunks(spark, sf_dir).agg(
        F.count_if(F.col("text").contains("�")).alias("encoding"), F.count_if(n < 50).alias("short"), F.count_if(n > 1536).alias("long"),
        (F.count("*") - F.countDistinct("text")).alias("duplicates"), F.count_if(F.col("file_type").isNull()).alias("no_type"),
    )


@register("a18_repeated_chunks", f"{W} SELECT doc_id, sha256(text) AS hash, count(*) AS n, count(*) - 1 AS extra FROM chunks GROUP BY ALL HAVING count(*) > 1")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.chunks(spark, sf_dir).groupBy("doc_id", T.sha256(F.col("text")).alias("hash")).agg(F.count("*").alias("n")).filter("n > 1")
    return rows.withColumn("extra", F.col("n") - 1)


@register(
    "p04_document_reasons",
    f"WITH d AS (SELECT regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents) SELECT CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN length(text) < 50 THEN 'too_short' WHEN len({sql_words('text')}) < 3 THEN 'too_few_words' ELSE 'valid' END AS reason, count(*) AS n FROM d GROUP BY 1",
)
def p04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.reason_counts(read(spark, sf_dir, "documents"), validate.document_reason(F.col("text")))


@register(
    "p06_embedding_reasons",
    f"""{W}, s AS (SELECT text, substr(text, 1, 1000) AS h FROM chunks)
SELECT CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 10 THEN 'too_short'
 WHEN len(regexp_extract_all(h, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{{80}}-\\x{{84}}\\x{{86}}-\\x{{9F}}\\p{{Cf}}\\p{{Co}}]')) / length(h) > 0.9 THEN 'unprintable'
 WHEN len(regexp_extract_all(h, '[\\p{{L}}\\p{{N}}]')) / length(h) < 0.1 THEN 'few_letters' WHEN len({sql_words('text')}) < 3 THEN 'too_few_words' ELSE 'valid' END AS reason, count(*) AS n FROM s GROUP BY 1""",
)
def p06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.reason_counts(I.chunks(spark, sf_dir), validate.embedding_reason(F.col("text")))


@register("p12_document_search", f"{W} SELECT file_name, count(*) AS chunks FROM chunks WHERE file_name LIKE '%_1%' GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.chunks(spark, sf_dir).filter(F.col("file_name").like("%_1%")).groupBy("file_name").agg(F.count("*").alias("chunks")).filter("chunks BETWEEN 2 AND 50")


@register("p13_file_search", f"{W} SELECT DISTINCT file_name, lower(file_name) = 'doc_1.md' AS exact FROM chunks WHERE file_name ILIKE '%DOC_1%'")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.chunks(spark, sf_dir).filter(F.col("file_name").ilike("%DOC_1%")).select("file_name", (F.lower("file_name") == "doc_1.md").alias("exact")).distinct()


@register("p14_longest_chunks", f"{W} SELECT chunk_id, length(text) AS chars FROM chunks WHERE length(text) >= 300 ORDER BY chars DESC, chunk_id LIMIT 20")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.chunks(spark, sf_dir).select("chunk_id", F.length("text").alias("chars")).filter("chars >= 300")
    return rows.orderBy(F.desc("chars"), "chunk_id").limit(20)


@register(
    "f05_content_metrics",
    f"SELECT doc_id, length(text) AS content_length, len({sql_words('text')}) AS word_count, len(string_split(text, chr(10))) AS line_count, "
    "len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p) <> '')) AS paragraph_count FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
)
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.documents(spark, sf_dir).select("doc_id", T.metrics(F.col("text")).alias("m")).select("doc_id", "m.*")


@register("f06_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.sha256(F.col("text")).alias("hash"))


@register(
    "f02_clean_truncate",
    "WITH c AS (SELECT doc_id, text, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS t FROM documents) "
    "SELECT doc_id, length(text) AS original_length, sha256(CASE WHEN length(t) > 2000 THEN substr(t, 1, 2000) || ' [TRUNCATED]' ELSE t END) AS hash FROM c",
)
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", T.clean_truncated(F.col("text"), 2000).alias("c"))
    return rows.select("doc_id", F.col("c.original_length").alias("original_length"), T.sha256(F.col("c.text")).alias("hash"))


@register(
    "f07_quality_score",
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, t, len({sql_words('t')}) AS w, lower(substr(t, 1, 200)) AS e FROM d)
SELECT doc_id, CAST(greatest(0, least(100, 100 - CASE WHEN length(t) < 100 THEN 30 WHEN length(t) < 500 THEN 15 ELSE 0 END - CASE WHEN w < 20 THEN 20 WHEN w < 50 THEN 10 ELSE 0 END
 - CASE WHEN contains(e, 'error') OR contains(e, 'could not') OR contains(e, 'unable to') OR contains(e, 'failed') OR contains(e, 'corrupted') THEN 15 ELSE 0 END + CASE WHEN len(regexp_extract_all(t, '#')) >= 2 THEN 5 ELSE 0 END
 + CASE WHEN len(string_split(t, chr(10) || '-')) > 3 OR len(string_split(t, chr(10) || '*')) > 3 THEN 5 ELSE 0 END)) AS DOUBLE) AS score FROM m""",
)
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.documents(spark, sf_dir).select("doc_id", T.quality_score(F.col("text")).alias("score"))


@register("f11_preview", "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM documents")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text"), 100).alias("preview"))


@register("f12_occurrences", "SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'th', ''))) / 2 AS INTEGER) AS n FROM documents WHERE text IS NOT NULL")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", T.occurrences(F.col("text"), F.lit("TH")).alias("n"))


@register(
    "c01_word_windows",
    f"""WITH d AS (SELECT doc_id, {sql_words("coalesce(text, '')")} AS w FROM documents), n AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, CAST(ceil((len(w) - 128) / 384) AS INTEGER)) END AS total FROM d)
SELECT doc_id, total AS total_chunks, CAST(i AS INTEGER) AS chunk_index, sha256(array_to_string(w[i * 384 + 1 : i * 384 + 512], ' ')) AS hash FROM (SELECT *, unnest(range(0, total)) AS i FROM n)""",
)
def c01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.word_windows(I.documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "total_chunks", "chunk_index", T.sha256(F.col("chunk_text")).alias("hash"))


@register("c01_sentence_packing")
def c01_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.packed_sentences(I.documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "chunk_index", "total_chunks", F.size(T.words(F.col("chunk_text"))).alias("words"))


def _tokens(name: str):
    import public_tokenizers

    return token_chunks.tokenizer_counter(public_tokenizers.path(name))


@register("c01_token_sentences")
def c01_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in chunks of up to 512 tokens; tested by encoding the chunks and against a plain fold."""
    rows = token_chunks.token_sentences(I.documents(spark, sf_dir).select("doc_id", "text"), _tokens("byte_bpe_50k.json"))
    return rows.select("doc_id", "chunk_index", "total_chunks", "tokens", T.sha256(F.col("chunk_text")).alias("hash"))


@register("c02_token_blocks")
def c02_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = chunking.convert_pages(read(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), F.col("markdown").alias("text"))
    rows = token_chunks.token_blocks(pages, _tokens("byte_bpe_50k.json"), 256)
    return rows.select("doc_id", "chunk_index", "total_chunks", "parent_heading", "chunk_type", "tokens", T.sha256(F.col("chunk_text")).alias("hash"))


@register("c02_structure_chunks")
def c02(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = chunking.convert_pages(read(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), F.col("markdown").alias("text"))
    rows = chunking.structure_chunks(pages, 200)
    return rows.select("doc_id", "chunk_index", "total_chunks", "parent_heading", "chunk_type", F.length("chunk_text").alias("chars"))


@register(
    "c07_paragraphs",
    "WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p) <> '') AS l FROM documents WHERE text IS NOT NULL) "
    "SELECT doc_id, CAST(i - 1 AS INTEGER) AS paragraph_index, length(l[i]) AS chars FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM p)",
)
def c07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.paragraphs(I.documents(spark, sf_dir))
    return rows.select("doc_id", "paragraph_index", F.length("paragraph").alias("chars"))


def _html_sql(c: str) -> str:
    def sub(pattern: str, to: str, inner: str) -> str:
        return f"regexp_replace({inner}, '{pattern}', {to}, 'g')"

    nl, out = "chr(10)", sub("(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", "''", c)
    for level in range(1, 7):
        out = sub(f"(?is)<h{level}[^>]*>(.*?)</h{level}>", f"{nl} || {nl} || '{'#' * level} \\1' || {nl} || {nl}", out)
    out = sub('(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', "'[\\2](\\1)'", out)
    out = sub("(?is)<li[^>]*>(.*?)</li>", f"{nl} || '- \\1'", out)
    out = sub("(?i)<br\\s*/?>|</(p|div|tr|ul|ol|table)>", nl, out)
    out = sub("(?s)<[^>]+>", "''", out)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return f"trim({sub('\\n\\s*\\n+', f'{nl} || {nl}', sub('[ \\t]+', chr(39) + ' ' + chr(39), out))}, ' ')"


@register(
    "c08_convert_pages",
    f"WITH m AS (SELECT page_id, length(html) AS original_size, {_html_sql(chr(99) + 'oalesce(html, ' + chr(39) * 2 + ')')} AS markdown FROM pages) "
    "SELECT page_id, original_size, sha256(markdown) AS hash, CASE WHEN length(markdown) < 10 THEN 'rejected' ELSE 'converted' END AS verdict FROM m",
)
def c08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.convert_pages(read(spark, sf_dir, "pages"))
    return rows.select("page_id", "original_size", T.sha256(F.col("markdown")).alias("hash"), "verdict")


@register("l18_constraint_report", "SELECT 'has_text' AS rule, count(*) FILTER (text IS NULL) AS violations FROM documents UNION ALL SELECT 'known_lang', count(*) FILTER (coalesce(lang, '') NOT IN ('en', 'fr', 'de', 'es')) FROM documents UNION ALL SELECT 'size_matches', count(*) FILTER (coalesce(length(text) <> n_chars, true)) FROM documents")
def l18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"has_text": F.col("text").isNotNull(), "known_lang": F.col("lang").isin("en", "fr", "de", "es"), "size_matches": F.length("text") == F.col("n_chars")}
    return validate.rule_report(read(spark, sf_dir, "documents"), rules)
