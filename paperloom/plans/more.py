"""Further functions and reports, each held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as T
from ..functions import vrn
from ..operators import evaluate, fusion, keyword, lifecycle, retrieval, vector
from ..registry import oracle_sql_of, read, register
from ..sources import files
from ..sources.bucket_table import BucketTable
from ..storage import shared_dir, written
from ..streaming import ingest
from . import inputs as I
from .inputs import CANDIDATES, CHUNKS, REGISTRY, SEARCH_QUERIES, USER_QUERIES, VEHICLES, sql_words

C = f"WITH {CANDIDATES}"
K = f"WITH {CHUNKS}"
R = f"WITH {REGISTRY}"
U = f"WITH {USER_QUERIES}"


@register("u01_candidate_union", f"{C} SELECT query_id, chunk_id, 'db' AS side FROM candidates WHERE contains(source_method, 'database') UNION ALL SELECT query_id, chunk_id, 'vec' FROM candidates WHERE contains(source_method, 'vector')")
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, m = I.candidates(spark, sf_dir), F.col("source_method")
    pick = lambda test, name: rows.filter(test).select("query_id", "chunk_id", F.lit(name).alias("side"))
    return pick(fusion.is_database(m), "db").unionByName(pick(fusion.is_vector(m), "vec"))


@register("u02_set_difference", f"{C} SELECT file_name FROM candidates WHERE source_method = 'hybrid' EXCEPT SELECT file_name FROM candidates WHERE similarity_score > 0.9")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.candidates(spark, sf_dir)
    return rows.filter("source_method = 'hybrid'").select("file_name").subtract(rows.filter("similarity_score > 0.9").select("file_name"))


@register("u04_distinct_files", f"{K} SELECT DISTINCT file_name FROM chunks")
def u04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.chunks(spark, sf_dir).select("file_name").distinct()


@register("u05_fallback", f"{C}, h AS (SELECT * FROM candidates WHERE similarity_score >= 0.95), b AS (SELECT query_id, max(similarity_score) AS s FROM candidates WHERE query_id NOT IN (SELECT query_id FROM h) GROUP BY 1) SELECT query_id, similarity_score AS score, false AS fallback FROM h UNION ALL SELECT query_id, s, true FROM b")
def u05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries without a hit get their best candidate instead."""
    rows = I.candidates(spark, sf_dir)
    hits = rows.filter("similarity_score >= 0.95")
    rest = rows.join(hits.select("query_id").distinct().hint("merge"), "query_id", "left_anti").groupBy("query_id").agg(F.max("similarity_score").alias("score"))
    return hits.select("query_id", F.col("similarity_score").alias("score"), F.lit(False).alias("fallback")).union(rest.select("query_id", "score", F.lit(True)))


@register("o01_top_k", f"{C}, r AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, file_name, chunk_index, chunk_id) AS INTEGER) AS rank FROM candidates) SELECT * FROM r WHERE rank <= 3")
def o01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.top_by(I.candidates(spark, sf_dir), F.col("similarity_score"), 3).select("query_id", "chunk_id", "rank")


@register("o03_page", f"{K} SELECT file_name, count(*) AS chunks FROM chunks GROUP BY 1 ORDER BY chunks DESC, file_name LIMIT 25 OFFSET 50")
def o03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a listing: limit and offset are the feature."""
    return I.chunks(spark, sf_dir).groupBy("file_name").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "file_name").offset(50).limit(25)


@register("o04_numeric_order", f"{K}, r AS (SELECT chunk_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(try_cast(string_split(chunk_id, ':')[2] AS INTEGER), 0), chunk_id) AS place FROM chunks) SELECT chunk_id, CAST(place AS INTEGER) AS place FROM r")
def o04(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = F.coalesce(F.split("chunk_id", ":")[1].try_cast("int"), F.lit(0))
    return I.chunks(spark, sf_dir).select("chunk_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(index, "chunk_id")).alias("place"))


@register("o06_top_k_by_query", f"{C}, r AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, file_name, chunk_index, chunk_id) AS INTEGER) AS rank FROM candidates) SELECT * FROM r WHERE rank <= query_id % 4 + 1")
def o06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.top_by(I.candidates(spark, sf_dir), F.col("similarity_score"), F.col("query_id") % 4 + 1).select("query_id", "chunk_id", "rank")


@register("p08_adaptive_cut", f"{C} SELECT query_id, chunk_id FROM candidates WHERE similarity_score >= CASE WHEN len({sql_words('query')}) >= 6 THEN 0.4 ELSE 0.5 END")
def p08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.candidates(spark, sf_dir).filter(F.col("similarity_score") >= Q.smart_threshold(F.col("query"), F.lit(False))).select("query_id", "chunk_id")


@register("p09_word_match", f"{C} SELECT chunk_id, regexp_matches(lower(full_content), '\\bthe\\b') AS the, regexp_matches(lower(full_content), '\\bof\\b') AS of FROM candidates")
def p09(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("full_content")
    return I.candidates(spark, sf_dir).select("chunk_id", T.word_match(F.lit("the"), content).alias("the"), T.word_match(F.lit("of"), content).alias("of"))


@register("p11_relevance", f"{K} SELECT chunk_id, contains(lower(text), 'th') AND contains(lower(text), 'en') AND (contains(lower(text), 'der') OR contains(lower(text), 'the')) AS relevant FROM chunks")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    arr = lambda *w: F.array(*map(F.lit, w))
    return I.chunks(spark, sf_dir).select("chunk_id", evaluate.is_relevant(F.col("text"), arr("th", "en"), arr("der", "the")).alias("relevant"))


@register("p18_content_relevance", f"{C} SELECT chunk_id, CASE WHEN len(list_filter({sql_words('lower(query)')}, lambda w: length(w) > 2)) = 0 THEN true ELSE len(list_filter(list_filter({sql_words('lower(query)')}, lambda w: length(w) > 2), lambda w: contains(lower(full_content), w))) > 0 END AS relevant FROM candidates")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = Q.required_terms(F.col("query"))
    return I.candidates(spark, sf_dir).select("chunk_id", ((F.size(long) == 0) | F.exists(long, lambda w: F.lower("full_content").contains(w))).alias("relevant"))


@register("p19_quality_gate", f"{C} SELECT query_id, count(*) AS n FROM candidates WHERE similarity_score >= 0.6 GROUP BY 1")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.candidates(spark, sf_dir).filter("similarity_score >= 0.6").groupBy("query_id").agg(F.count("*").alias("n"))


@register("p15_autocomplete", f"WITH {VEHICLES} SELECT DISTINCT registration_number FROM vehicles WHERE status = 'active' AND contains(lower(registration_number), '18') ORDER BY 1 LIMIT 20")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.vehicles(spark, sf_dir).filter((F.col("status") == "active") & F.lower("registration_number").contains("18"))
    return rows.select("registration_number").distinct().orderBy("registration_number").limit(20)


@register("p16_registry_by_hash", f"{R} SELECT file_hash, max(id) AS id, arg_max(original_filename, uploaded_at) AS original_filename FROM registry GROUP BY 1")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.registry_rows(spark, sf_dir).select("file_hash", "id", "original_filename", "uploaded_at")
    return lifecycle.newest_by(rows, "file_hash", "uploaded_at").select("file_hash", "id", "original_filename")


@register("f08_mime_types", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' ELSE 'bin' END AS ext, CASE page_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'pdf' ELSE 'unknown' END AS kind FROM pages")
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    mime = F.element_at(F.array(F.lit("text/HTML"), F.lit("application/pdf"), F.lit("x/y")), (F.col("page_id") % 3 + 1).cast("int"))
    ext = T.extension_of_mime(mime)
    return read(spark, sf_dir, "pages").select("page_id", ext.alias("ext"), T.type_of_extension(ext).alias("kind"))


@register("f10_output_paths", "SELECT page_id, 'out/in/' || page_id % 7 || '/p_' || page_id || '.md' AS path FROM pages")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/in/"), F.col("page_id") % 7, F.lit("/p_"), "page_id", F.lit(".html"))
    return read(spark, sf_dir, "pages").select("page_id", T.output_path(path, "out").alias("path"))


@register("f14_exact_score", f"{C} SELECT chunk_id, round(least(0.95, 0.6 + 0.05 * query_occurrences), 6)::DOUBLE AS exact, round(CASE WHEN n_metadata = 0 THEN 0.1 ELSE least(0.6, 0.6 * 0.8 + n_metadata / 7 * 0.2 + least(0.2, query_occurrences * 0.02)) END, 6)::DOUBLE AS terms FROM candidates")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, f = F.col("query_occurrences"), F.col("n_metadata")
    return I.candidates(spark, sf_dir).select("chunk_id", F.round(keyword.exact_score(n), 6).alias("exact"), F.round(keyword.terms_score(f, F.lit(7), n), 6).alias("terms"))


_ACRONYMS = "CASE lower(w) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Q.ACRONYMS.items()) + " ELSE w END"


@register("f31_acronyms", f"{U} SELECT query_id, array_to_string(list_transform({sql_words(chr(39) + 'NCT ' + chr(39) + ' || query')}, lambda w: {_ACRONYMS}), ' ') AS expanded FROM user_queries")
def f31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.user_queries(spark, sf_dir).select("query_id", Q.expand_acronyms(F.concat(F.lit("NCT "), "query")).alias("expanded"))


@register("f43_person_queries", f"{U} SELECT query_id, (contains(lower(query), 'who is') OR contains(lower(query), 'tell me about') OR contains(lower(query), 'show me') OR contains(lower(query), 'find') OR contains(lower(query), 'about')) AND regexp_matches(query, '(^|[^\\p{{L}}\\p{{N}}_])[A-Z][a-z]+($|[^\\p{{L}}\\p{{N}}_])') AS person FROM user_queries")
def f43(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.user_queries(spark, sf_dir)
    return rows.select("query_id", Q.is_person_query(F.col("query")).alias("person"))


@register("f45_semantic_score", f"{C} SELECT chunk_id, round(least(1.0, similarity_score * CASE WHEN length(full_content) BETWEEN 100 AND 2000 THEN 1.1 WHEN length(full_content) < 50 THEN 0.9 ELSE 1.0 END * CASE WHEN similarity_score > 0.7 THEN 1.05 ELSE 1.0 END), 6)::DOUBLE AS score FROM candidates")
def f45(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.candidates(spark, sf_dir).select("chunk_id", F.round(fusion.semantic_score(), 6).alias("score"))


@register("f48_parsed_scores", f"{C} SELECT chunk_id, CASE WHEN query_occurrences = 0 THEN 5.0 ELSE least(10.0, n_metadata * 2.0) END::DOUBLE AS score FROM candidates")
def f48(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.when(F.col("query_occurrences") == 0, "no number").otherwise(F.concat(F.lit("Score: "), (F.col("n_metadata") * 2).cast("string"), F.lit(" of ten")))
    return I.candidates(spark, sf_dir).select("chunk_id", Q.parsed_score(reply).alias("score"))


@register("f49_parsed_decisions", f"{C} SELECT chunk_id, CASE WHEN n_metadata % 2 = 0 THEN 'true,false' ELSE 'true,true,true' END AS decisions FROM candidates")
def f49(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("n_metadata") % 2 == 0, 2).otherwise(3)
    decisions = Q.parsed_decisions(F.lit("1. relevant\n2. NOT_RELEVANT\n"), n)
    return I.candidates(spark, sf_dir).select("chunk_id", F.array_join(F.transform(decisions, lambda d: d.cast("string")), ",").alias("decisions"))


@register("f51_image_marks", "SELECT doc_id, 'a' || doc_id || 'b' || (CASE WHEN doc_id % 2 = 0 THEN lang ELSE '<!-- image -->' END) || 'c' AS text FROM documents")
def f51(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.lit(T.IMAGE_MARK)
    found = F.when(F.col("doc_id") % 2 == 0, F.array(F.col("doc_id").cast("string"), "lang")).otherwise(F.array(F.col("doc_id").cast("string")))
    return read(spark, sf_dir, "documents").select("doc_id", T.fill_images(F.concat(F.lit("a"), mark, F.lit("b"), mark, F.lit("c")), found).alias("text"))


@register("f53_normal_numbers", f"WITH {VEHICLES} SELECT id, upper(trim(registration_number)) AS number, false AS vin FROM vehicles")
def f53(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.vehicles(spark, sf_dir).select("id", vrn.normalize(F.col("registration_number")).alias("number"), vrn.is_valid_vin(F.col("registration_number")).alias("vin"))


@register("f55_to_markdown", "SELECT doc_id, '## ' || lang || chr(10) || chr(10) || '- ' || source || chr(10) || chr(10) || 'end' AS markdown FROM documents")
def f55(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.lit(2).alias("level"), text.alias("text"))
    return read(spark, sf_dir, "documents").select("doc_id", T.to_markdown(F.array(item("heading", F.col("lang")), item("list", F.col("source")), item("text", F.lit("end")))).alias("markdown"))


@register("f59_iso_times", "SELECT event_id, event_id % 2 = 0 AS ok FROM events")
def f59(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("not a time")
    return read(spark, sf_dir, "events").select("event_id", T.is_iso_time(text).alias("ok"))


@register(
    "f62_conversion_verdicts",
    """SELECT page_id, CASE WHEN length(trim(coalesce(html, ''), ' ')) < 10 THEN 'rejected' WHEN contains(html, '```json') AND (contains(html, '"point') OR contains(html, '"bbox')) AND contains(html, '"text') THEN 'extract_again' ELSE 'accepted' END AS verdict FROM pages""",
)
def f62(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.conversion_verdict(F.coalesce("html", F.lit(""))).alias("verdict"))


@register("j07_registry_ids", "WITH k AS (SELECT doc_id, 'docs/d_' || doc_id || '.md' AS path FROM documents) SELECT doc_id, doc_id % 3 = 0 AS is_known FROM k")
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("docs/d_"), "doc_id", F.lit(".md")).alias("path"))
    known = docs.filter("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("id"), F.upper("path").alias("markdown_file_path"), F.col("doc_id").alias("uploaded_at"))
    rows = lifecycle.with_registry_id(docs, known)
    return rows.select("doc_id", (F.col("registry_id") == F.col("doc_id").cast("string")).alias("is_known"))


@register("j12_document_expansion", f"WITH {CHUNKS}, m AS (SELECT DISTINCT doc_id % 10 AS query_id, file_name FROM chunks WHERE length(text) > 900), e AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY file_name, chunk_index, chunk_id) AS rank FROM m JOIN chunks USING (file_name)) SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM e WHERE rank <= 50")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.chunks(spark, sf_dir)
    found = rows.filter(F.length("text") > 900).select((F.col("doc_id") % 10).alias("query_id"), "file_name")
    return keyword.expand_documents(found, rows).select("query_id", "chunk_id", "rank")


@register("j14_file_bands", f"{C}, b AS (SELECT file_name, max(similarity_score) AS best FROM candidates WHERE contains(source_method, 'vector') GROUP BY 1), f AS (SELECT DISTINCT file_name FROM candidates WHERE contains(source_method, 'database')) SELECT f.file_name, best, CASE WHEN best IS NULL THEN 'missing' WHEN best >= 0.8 THEN 'high' WHEN best >= 0.6 THEN 'medium' WHEN best >= 0.4 THEN 'low' ELSE 'poor' END AS band FROM f LEFT JOIN b ON f.file_name = b.file_name")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, m = I.candidates(spark, sf_dir), F.col("source_method")
    best = rows.filter(fusion.is_vector(m)).groupBy("file_name").agg(F.max("similarity_score").alias("best"))
    named = rows.filter(fusion.is_database(m)).select("file_name").distinct()
    return named.join(best.hint("merge"), "file_name", "left").select("file_name", "best", F.when(F.col("best").isNull(), "missing").otherwise(vector.band(F.col("best"))).alias("band"))


@register("a24_conversion_statistics", "SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars, round(avg(length(html)), 6) AS mean, count(*) FILTER (length(html) < 1500) AS small FROM pages GROUP BY 1")
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, n = F.get(F.split(F.get(F.split("url", "://"), F.lit(1)), "/"), F.lit(0)), F.length("html")
    return read(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.sum(n).alias("chars"), F.round(F.avg(n), 6).alias("mean"), F.count_if(n < 1500).alias("small"))


_QUALITY = f"q AS (SELECT d.doc_id, score, lang AS format, n_chars AS size FROM ({oracle_sql_of('f07_quality_score')}) f JOIN documents d ON d.doc_id = f.doc_id)"


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as conversions: quality of the whole text, format and size."""
    return read(spark, sf_dir, "documents").select("doc_id", T.quality_score(F.coalesce("text", F.lit(""))).alias("score"), F.col("lang").alias("format"), F.col("n_chars").alias("size"))


@register(
    "a24_quality_bands",
    f"WITH {_QUALITY} SELECT format, count(*) AS total, count(*) FILTER (score >= 90) AS excellent, count(*) FILTER (score >= 75 AND score < 90) AS good, count(*) FILTER (score >= 50 AND score < 75) AS acceptable, "
    "count(*) FILTER (score < 50) AS poor, count(*) FILTER (score < 75) AS problems, round(avg(score), 6) AS average_quality, CAST(sum(size) AS BIGINT) AS total_size FROM q GROUP BY 1",
)
def a24_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score")
    bands = {"excellent": s >= 90, "good": (s >= 75) & (s < 90), "acceptable": (s >= 50) & (s < 75), "poor": s < 50, "problems": s < 75}
    return _rated(spark, sf_dir).groupBy("format").agg(F.count("*").alias("total"), *(F.count_if(test).alias(name) for name, test in bands.items()), F.round(F.avg(s), 6).alias("average_quality"), F.sum("size").alias("total_size"))


@register("a24_problem_files", f"WITH {_QUALITY} SELECT doc_id, score, format, size FROM q WHERE score < 75")
def a24_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversion of a quality below 75."""
    return _rated(spark, sf_dir).filter("score < 75")


@register("a36_distinct_text", f"{K} SELECT file_name, sha256(string_agg(DISTINCT text, ' ' ORDER BY text)) AS hash, count(DISTINCT text) AS n FROM chunks GROUP BY 1")
def a36_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct texts of each file, sorted and joined; a group is one file."""
    texts = F.array_sort(F.collect_set("text"))
    return I.chunks(spark, sf_dir).groupBy("file_name").agg(texts.alias("t")).select("file_name", T.sha256(F.array_join("t", " ")).alias("hash"), F.size("t").cast("long").alias("n"))


@register("a26_failure_codes", "SELECT regexp_extract(line, ' - ([A-Z_]+)', 1) AS code, count(*) AS n FROM (SELECT 'd_' || doc_id || ' - ' || upper(lang) || '_FAIL at line ' || n_chars AS line FROM documents) GROUP BY 1")
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("d_"), "doc_id", F.lit(" - "), F.upper("lang"), F.lit("_FAIL at line "), "n_chars")
    return read(spark, sf_dir, "documents").groupBy(F.regexp_extract(line, " - ([A-Z_]+)", 1).alias("code")).agg(F.count("*").alias("n"))


@register("a27_throughput", "SELECT event_type, count(*) AS records, round(count(*) / nullif(date_diff('second', min(CAST(ts AS TIMESTAMP)), max(CAST(ts AS TIMESTAMP))), 0), 9) AS per_second FROM events GROUP BY 1")
def a27(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.nullif(F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts")), F.lit(0))
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("records"), F.round(F.count("*") / span, 9).alias("per_second"))


@register("a36_phrase_context", f"WITH {CHUNKS}, {SEARCH_QUERIES}, m AS (SELECT query_id, chunk_id, text, instr(lower(text), lower(query)) AS place FROM search_queries JOIN chunks ON contains(lower(text), lower(query))) SELECT query_id, chunk_id, substr(text, greatest(1, place - 100), 250) AS context FROM m")
def a36(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = keyword.phrase_pairs(I.search_queries(spark, sf_dir), I.chunks(spark, sf_dir), "substring")
    at = F.instr(F.lower("text"), F.lower("query"))
    return pairs.select("query_id", "chunk_id", F.substring("text", F.greatest(F.lit(1), at - 100), F.lit(250)).alias("context"))


@register("a37_loading_summary", "SELECT count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, round(100 * count(text) / count(*), 6) AS success, CASE WHEN 100 * count(text) / count(*) >= 95 THEN 'excellent' WHEN 100 * count(text) / count(*) >= 80 THEN 'good' WHEN 100 * count(text) / count(*) >= 50 THEN 'fair' ELSE 'poor' END AS grade FROM documents")
def a37(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = 100 * F.count("text") / F.count("*")
    return read(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.round(share, 6).alias("success"), F.when(share >= 95, "excellent").when(share >= 80, "good").when(share >= 50, "fair").otherwise("poor").alias("grade"))


@register("a40_chunker_comparison", f"WITH {CHUNKS}, w AS (SELECT CASE WHEN len(x) = 0 THEN 0 ELSE greatest(1, CAST(ceil((len(x) - 128) / 384) AS INTEGER)) END AS n FROM (SELECT {sql_words(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS x FROM documents)) SELECT 'lines' AS chunker, count(*) AS chunks FROM chunks UNION ALL SELECT 'windows', CAST(sum(n) AS BIGINT) FROM w")
def a40(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.chunking import word_windows

    lines = I.chunks(spark, sf_dir).agg(F.lit("lines").alias("chunker"), F.count("*").alias("chunks"))
    return lines.union(word_windows(I.documents(spark, sf_dir)).agg(F.lit("windows"), F.count("*")))


@register("a46_indexed_rows", f"{K}, w AS (SELECT DISTINCT file_name FROM chunks WHERE doc_id % 3 = 0) SELECT file_name, count(*) AS n FROM chunks WHERE file_name IN (SELECT file_name FROM w) GROUP BY 1")
def a46(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.chunks(spark, sf_dir)
    return rows.join(rows.filter("doc_id % 3 = 0").select("file_name").hint("merge"), "file_name", "left_semi").groupBy("file_name").agg(F.count("*").alias("n"))


@register("a48_pending_queue", "SELECT lang AS format, count(*) AS files, round(sum(n_chars) / 1000000, 6) AS mb FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def a48(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return waiting.groupBy(F.col("lang").alias("format")).agg(F.count("*").alias("files"), F.round(F.sum("n_chars") / 1_000_000, 6).alias("mb"))


@register("s10_result_table", f"{C}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, file_name, chunk_index, chunk_id) AS rank FROM candidates) SELECT query_id, CAST(rank AS INTEGER) AS index, file_name, round(similarity_score, 3) AS score, CASE WHEN length(full_content) > 200 THEN substr(full_content, 1, 200) || '...' ELSE full_content END AS preview FROM r")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.top_by(I.candidates(spark, sf_dir), F.col("similarity_score"), F.lit(1_000_000))
    return files.result_table(rows.select("query_id", "rank", "file_name", F.col("similarity_score").alias("score"), F.col("full_content").alias("text")))


@register("l04_already_converted", "SELECT doc_id FROM documents WHERE doc_id % 5 > doc_id % 4")
def l04(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    rows = read(spark, sf_dir, "documents")
    inputs = rows.select("doc_id", F.concat(F.lit("out/"), n).alias("out_path"), (n % 4).alias("modified"))
    return lifecycle.already_converted(inputs, rows.select(F.concat(F.lit("out/"), n).alias("path"), (n % 5).alias("modified"))).select("doc_id")


@register("l05_reconciliation", "WITH s AS (SELECT doc_id, n_chars, lang FROM documents), m AS (SELECT *, doc_id % 11 = 0 AS missing FROM s) SELECT count(*) AS files, count(*) FILTER (missing) AS missing, round(100 * count(*) FILTER (NOT missing) / count(*), 6) AS success FROM m")
def l05(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("d_"), "doc_id", F.lit(".md"))
    scan = read(spark, sf_dir, "documents").select(name.alias("path"), name.alias("file_name"), "doc_id")
    held = scan.filter("doc_id % 11 <> 0").select(F.col("path").alias("file_path"), "file_name")
    gone = lifecycle.missing_in_index(scan, held).select("path", F.lit(True).alias("gone"))
    marked = scan.join(gone.hint("merge"), "path", "left")
    return marked.agg(F.count("*").alias("files"), F.count("gone").alias("missing"), F.round(100 * F.count_if(F.col("gone").isNull()) / F.count("*"), 6).alias("success"))


@register("l07_delete_by_id", f"{K} SELECT chunk_id FROM chunks WHERE doc_id % 6 <> 0")
def l07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ids are deleted by a registry id, others by their path."""
    n = F.col("doc_id")
    uuid = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(n.cast("string"), 12, "0"))
    path = F.concat(F.lit("p/"), n)
    rows = I.chunks(spark, sf_dir).withColumn("registry_id", uuid).withColumn("original_path", path)
    ids = read(spark, sf_dir, "documents").filter(n % 6 == 0).select(F.when(n % 12 == 0, uuid).otherwise(path).alias("document_id"))
    return lifecycle.delete_by(rows, ids).select("chunk_id")


@register("l16_repairs", f"{R} SELECT id, CASE WHEN status = 'uploaded' THEN 'pending_assignment' ELSE status END AS status FROM registry WHERE size >= 20")
def l16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.registry_rows(spark, sf_dir).filter("size >= 20")
    return rows.select("id", F.when(F.col("status") == "uploaded", "pending_assignment").otherwise(F.col("status")).alias("status"))


@register("e05_answer_checks", f"{C} SELECT match_type AS query_type, count(*) AS total, count(*) FILTER (contains(lower(full_content), 'the') AND contains(lower(full_content), 'en')) AS passed FROM candidates GROUP BY 1")
def e05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.candidates(spark, sf_dir).select(F.col("match_type").alias("query_type"), F.col("full_content").alias("answer"), F.array(F.lit("the"), F.lit("en")).alias("expected"), F.lit(False).alias("should_reject"))
    return evaluate.answer_checks(rows)


@register("t02_new_uploads", f"{R} SELECT min(id) AS id FROM registry WHERE file_hash IS NOT NULL GROUP BY file_hash UNION ALL SELECT id FROM registry WHERE file_hash IS NULL")
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows written as upload files, read as a stream, and told from copies by its state; the sink's rows."""
    folder = shared_dir(spark)
    rows = written(I.registry_rows(spark, sf_dir).select("id", "file_hash", "uploaded_at"), f"{folder}/uploads")
    ingest.run_uploads(spark, f"{folder}/uploads", rows.schema, f"{folder}/sink", f"{folder}/checkpoint")
    return spark.read.schema("id long, file_hash string").parquet(f"{folder}/sink").select("id")


_CLEANED = r"regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"


@register(
    "t01_ingest",
    f"""WITH w AS (SELECT doc_id, {sql_words(_CLEANED)} AS ws FROM documents),
n AS (SELECT *, unnest(range(CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(1, CAST(ceil((len(ws) - 128) / 384) AS BIGINT)) END)) AS i FROM w),
c AS (SELECT doc_id, i, array_to_string(ws[384 * i + 1:384 * i + 512], ' ') AS t, len(ws[384 * i + 1:384 * i + 512]) AS n FROM n)
SELECT doc_id || ':' || i AS chunk_id, sha256(t) AS hash FROM c WHERE length(t) >= 50 AND n > 5 AND NOT regexp_full_match(replace(t, ' ', ''), '[0-9]+')""",
)
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files, streamed into a bucket table of their valid chunks; the committed table."""
    folder = shared_dir(spark)
    docs = written(I.documents(spark, sf_dir).select("doc_id", "text"), f"{folder}/documents")
    table = BucketTable(spark, f"{folder}/chunks", ingest.prepare(docs).schema, "chunk_id", 16)
    ingest.ingest_into(spark, f"{folder}/documents", docs.schema, f"{folder}/checkpoint", table).awaitTermination()
    return table.read().select("chunk_id", T.sha256(F.col("chunk_text")).alias("hash"))


@register(
    "r04_vector_variants",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL),
q AS (SELECT CAST(floor(vec_id / 100) AS BIGINT) AS query_id, vec_id % 100 AS variant, v, count(*) OVER (PARTITION BY floor(vec_id / 100)) AS n FROM v WHERE vec_id % 100 < 2),
s AS (SELECT query_id, variant, n, vec_id AS id, round(list_cosine_similarity(q.v, v.v), 12) AS score FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, variant, id, round(score, 6) AS score FROM r WHERE rank <= floor(10 / n) + 2""",
)
def r04(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = rows.filter("id % 100 < 2").select(F.floor(F.col("id") / 100).alias("query_id"), (F.col("id") % 100).cast("int").alias("variant"), "vec")
    return vector.variant_search(asked, rows, 10).select("query_id", "variant", "id", F.round("score", 6).alias("score"))


@register("r06_document_flags", f"{U} SELECT query_id, regexp_matches(query, '(?i)\\d{{2,3}}-[A-Z]-\\d{{4,5}}') OR {' OR '.join(f'''contains(lower(query), '{p}')''' for p in (*Q.COUNT_PHRASES, *Q.DOCUMENT_PHRASES))} AS whole FROM user_queries")
def r06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.user_queries(spark, sf_dir).select("query_id", Q.document_kind(F.col("query")).isNotNull().alias("whole"))


@register("l14_links", f"WITH {REGISTRY}, q AS (SELECT id AS document_id, id % 50 + 1 AS vehicle_id FROM registry WHERE vehicle_id IS NULL AND id % 2 = 1) SELECT r.id, CASE WHEN q.document_id IS NOT NULL THEN q.vehicle_id WHEN r.id % 8 = 0 THEN NULL ELSE r.vehicle_id END AS vehicle_id, CASE WHEN q.document_id IS NOT NULL THEN 'assigned' WHEN r.id % 8 = 0 THEN 'unassigned' ELSE r.status END AS status FROM registry r LEFT JOIN q ON q.document_id = r.id")
def l14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = I.registry_rows(spark, sf_dir).select("id", "vehicle_id", "status"), F.col("id")
    asked = rows.filter("vehicle_id IS NULL AND id % 2 = 1").select(n.alias("document_id"), (n % 50 + 1).alias("vehicle_id"))
    cars = spark.range(1, 60)
    linked = lifecycle.apply_links(rows, lifecycle.link_outcomes(asked, rows, cars))
    return lifecycle.unlink(linked, rows.filter("id % 8 = 0").select("id")).select("id", "vehicle_id", "status")


@register("l10_new_entries", "SELECT count(*) AS n FROM documents WHERE doc_id % 3 <> 0")
def l10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("docs/d_"), "doc_id", F.lit(".md")).alias("path"))
    known = docs.filter("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("id"), F.col("path").alias("markdown_file_path"), F.col("doc_id").alias("uploaded_at"))
    return lifecycle.new_entries(lifecycle.with_registry_id(docs, known)).agg(F.count("*").alias("n"))


@register("l19_reindex", f"{K} SELECT chunk_id, CASE WHEN doc_id % 4 = 0 THEN 'again' ELSE 'kept' END AS state FROM chunks")
def l19(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.chunks(spark, sf_dir).select("chunk_id", "doc_id", "file_name").withColumn("state", F.lit("kept"))
    part = rows.filter("doc_id % 4 = 0")
    return lifecycle.reindexed(rows, part.select("file_name"), part.withColumn("state", F.lit("again"))).select("chunk_id", "state")


@register("u03_key_sets", "SELECT count(*) AS n, 'lang' AS only_a, 'size' AS only_b, 'id' AS both FROM documents")
def u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = read(spark, sf_dir, "documents").select(F.create_map(F.lit("id"), F.col("doc_id").cast("string"), F.lit("lang"), "lang").alias("a"), F.create_map(F.lit("id"), F.lit("x"), F.lit("size"), F.lit("y")).alias("b"))
    sets = lifecycle.key_sets(maps, "a", "b").select(*(F.array_join(c, ",").alias(c) for c in ("only_a", "only_b", "both")))
    return sets.groupBy("only_a", "only_b", "both").agg(F.count("*").alias("n"))


@register("a47_conversion_summary", "SELECT count(*) AS total, count(*) FILTER (length(html) >= 1000) AS ok, count(*) FILTER (length(html) < 1000) AS failed, round(avg(length(html)) FILTER (length(html) >= 1000), 6) AS mean FROM pages")
def a47(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("html")
    return read(spark, sf_dir, "pages").agg(F.count("*").alias("total"), F.count_if(n >= 1000).alias("ok"), F.count_if(n < 1000).alias("failed"), F.round(F.avg(F.when(n >= 1000, n)), 6).alias("mean"))


@register("a39_metrics_summary", f"{K}, c AS (SELECT count(DISTINCT file_name) AS files, count(*) AS chunks, round(quantile_cont(length(text), 0.5), 6) AS median FROM chunks), v AS (SELECT count(*) AS vectors FROM embeddings WHERE len(embedding) = 64), e AS (SELECT count(DISTINCT event_type) AS kinds FROM events) SELECT * FROM c, v, e")
def a39(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three one-row reports side by side."""
    chunks = I.chunks(spark, sf_dir).agg(F.countDistinct("file_name").alias("files"), F.count("*").alias("chunks"), F.round(F.percentile(F.length("text"), 0.5), 6).alias("median"))
    vectors = read(spark, sf_dir, "embeddings").agg(F.count_if(F.size("embedding") == 64).alias("vectors"))
    kinds = read(spark, sf_dir, "events").agg(F.countDistinct("event_type").alias("kinds"))
    return chunks.join(F.broadcast(vectors)).join(F.broadcast(kinds))


_REPLY = "CASE turn % 5 WHEN 0 THEN 'Name: ' || text WHEN 1 THEN 'ANSWER=\"' || array_to_string(ws[1:2], ' ') || '\"' WHEN 2 THEN array_to_string(ws[1:3], ' ') || ' is' WHEN 3 THEN text || ' ' || text ELSE 'who ' || text END"
_NAME = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(reply, '(?i)^(name|answer|result)[:=]\\s*', ''), '(?i)\\s*(is|the|answer|result)$', ''), '^[\"'']+|[\"'']+$', '', 'g'), '\\s+', ' ', 'g'))"


@register(
    "f34_cleaned_extractions",
    f"""WITH w AS (SELECT conv_id, turn, text, {sql_words("text")} AS ws FROM conversations), r AS (SELECT conv_id, turn, text, {_REPLY} AS reply FROM w), n AS (SELECT *, {_NAME} AS entity FROM r)
SELECT conv_id, turn, entity, CASE WHEN length(entity) < 2 THEN 0.0 WHEN list_has_any({sql_words("lower(entity)")}, [{", ".join(f"'{w}'" for w in retrieval.QUESTION_WORDS)}]) THEN 0.2 WHEN length(entity) > length(text) THEN 0.1
 WHEN regexp_full_match(entity, '[A-Z][a-z]+(?: [A-Z][a-z]+)*') THEN 0.9 WHEN len({sql_words("entity")}) <= 3 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM n""",
)
def f34(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of an extractor, made from each turn: with a label, quotes or a filler word, twice as long as the query, or with a question word."""
    ws, n = T.words(F.col("text")), F.col("turn") % 5
    few = lambda k: F.array_join(F.slice(ws, 1, k), " ")
    reply = F.when(n == 0, F.concat(F.lit("Name: "), "text")).when(n == 1, F.concat(F.lit('ANSWER="'), few(2), F.lit('"'))).when(n == 2, F.concat(few(3), F.lit(" is")))
    reply = reply.when(n == 3, F.concat_ws(" ", "text", "text")).otherwise(F.concat(F.lit("who "), "text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", retrieval.cleaned_extraction(reply, F.col("text")).alias("e")).select("conv_id", "turn", "e.*")


@register("f54_first_values", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS owner FROM documents")
def f54(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.retrieval import first_value

    values = F.create_map(F.lit("owner"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(" "), F.lit("holder"), F.col("source"))
    return read(spark, sf_dir, "documents").select("doc_id", first_value(values, "owner", "absent", "holder").alias("owner"))


@register("r05_strategy_search")
def r05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search for all queries of the benchmark, then hashed-embedding search of all chunks for those that need it."""
    place = F.shiftleft(F.col("doc_id"), 24) + F.col("chunk_index")
    chunks = I.chunks(spark, sf_dir)
    shards = vector.sharded(vector.embed(chunks.filter("text <> ''").select(place.alias("id"), "text"), "text", dim=64).drop("text"))

    def by_word(asked: DataFrame) -> DataFrame:
        return keyword.exact_search(asked, chunks).select("query_id", place.alias("id"), "score", F.lit("database_exact").alias("source_method"))

    def by_vector(asked: DataFrame) -> DataFrame:
        found = written(vector.exact_top_k(vector.embed(asked.select("query_id", "query"), "query", dim=64), None, 50, shards=shards))
        joined = found.join(asked.select("query_id", "top_k", "threshold").hint("merge"), "query_id").filter("rank <= top_k AND score >= threshold")
        return joined.select("query_id", "id", "score", F.lit("vector_search").alias("source_method"))

    planned = retrieval.plan(I.search_queries(spark, sf_dir))
    return retrieval.execute(planned, by_word, by_vector).select("query_id", "id", "source_method", F.round("score", 6).alias("score"))
