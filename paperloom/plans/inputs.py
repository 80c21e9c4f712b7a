"""The relations that queries run on, made from the fixed tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import read

WORDS_SQL = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"


def sql_words(c: str) -> str:
    return WORDS_SQL.format(c)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each line of each document."""
    rows = documents(spark, sf_dir).withColumn("_l", F.split("text", "\n"))
    return rows.select(
        "doc_id",
        F.concat(F.lit("doc_"), "doc_id", F.lit(".md")).alias("file_name"),
        F.col("lang").alias("file_type"),
        F.size("_l").alias("total_chunks"),
        F.posexplode("_l").alias("chunk_index", "text"),
    ).withColumn("chunk_id", F.concat_ws(":", "doc_id", "chunk_index"))


CHUNKS = """
_lines AS (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
chunks AS (SELECT doc_id, 'doc_' || doc_id || '.md' AS file_name, lang AS file_type, len(l) AS total_chunks, CAST(i - 1 AS INTEGER) AS chunk_index,
                  l[i] AS text, doc_id || ':' || (i - 1) AS chunk_id
           FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM _lines))
"""

PREFIXES = ("tell me about ", "how many ", "who is John ", "insurance for 191-D-12345 ", "", "SELECT * FROM ", "list all vehicles ", "show me ")


def user_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): each whole user turn after a phrase that depends on the conversation."""
    rows = read(spark, sf_dir, "conversations").filter("role = 'user'")
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), (F.pmod("conv_id", F.lit(len(PREFIXES))) + 1).cast("int"))
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(prefix, "text").alias("query"))


USER_QUERIES = f"""
user_queries AS (SELECT conv_id * 1000 + turn AS query_id, [{", ".join(f"'{p}'" for p in PREFIXES)}][CAST(conv_id % {len(PREFIXES)} AS INTEGER) + 1] || text AS query
                 FROM conversations WHERE role = 'user')
"""


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): three words from the fourth on of each benchmark item."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(words, 4, 3), " ").alias("query"))


SEARCH_QUERIES = f"search_queries AS (SELECT item_id AS query_id, array_to_string(({sql_words('text')})[4:6], ' ') AS query FROM benchmark)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked candidates of several methods, two for each whole document, for twenty queries in a hundred documents."""
    base = documents(spark, sf_dir).select("doc_id", F.col("text").alias("full_content"))
    rows = base.withColumn("m", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("h", F.pmod(F.col("doc_id") * 37 + F.col("m") * 211, F.lit(1000)))
    methods = F.array(*map(F.lit, ("database_hybrid", "llamaindex_vector", "hybrid")))
    kinds = F.array(*map(F.lit, ("exact_phrase", "flexible_terms", "exact_match")))
    return rows.select(
        F.floor(F.col("doc_id") / 5).alias("query_id"),
        F.concat(F.lit("find "), F.split("full_content", " ")[0]).alias("query"),
        F.concat_ws(":", "doc_id", "m").alias("chunk_id"),
        F.concat(F.lit("doc_"), F.pmod("doc_id", F.lit(50)), F.lit(".md")).alias("file_name"),
        F.col("m").alias("chunk_index"),
        "full_content",
        (F.col("h") / 1000).alias("similarity_score"),
        F.element_at(methods, (F.pmod(F.col("doc_id") + F.col("m"), F.lit(3)) + 1).cast("int")).alias("source_method"),
        F.element_at(kinds, (F.pmod("doc_id", F.lit(3)) + 1).cast("int")).alias("match_type"),
        F.lit(None).cast("string").alias("database_strategy"),
        F.pmod("h", F.lit(4)).cast("int").alias("query_occurrences"),
        F.pmod("h", F.lit(7)).cast("int").alias("n_metadata"),
        (F.col("doc_id") * 2 + F.col("m")).alias("arrival_ord"),
    )


CANDIDATES = """
_base AS (SELECT doc_id, m, (doc_id * 37 + m * 211) % 1000 AS h, coalesce(text, '') AS full_content
          FROM documents, (VALUES (0), (1)) AS t(m)),
candidates AS (SELECT CAST(floor(doc_id / 5) AS BIGINT) AS query_id, 'find ' || string_split(full_content, ' ')[1] AS query, doc_id || ':' || m AS chunk_id,
                      'doc_' || (doc_id % 50) || '.md' AS file_name, m AS chunk_index, full_content, h / 1000 AS similarity_score,
                      ['database_hybrid', 'llamaindex_vector', 'hybrid'][CAST((doc_id + m) % 3 AS INTEGER) + 1] AS source_method,
                      ['exact_phrase', 'flexible_terms', 'exact_match'][CAST(doc_id % 3 AS INTEGER) + 1] AS match_type,
                      h % 4 AS query_occurrences, h % 7 AS n_metadata, doc_id * 2 + m AS arrival_ord FROM _base)
"""


def mixed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of whole documents, whose queries differ in methods, number and words, so that every fusion strategy occurs."""
    kind = F.pmod("query_id", F.lit(6))
    rows = candidates(spark, sf_dir).withColumn("k", kind)
    method = (
        F.when(F.col("k") == 2, "database_hybrid")
        .when(F.col("k") == 3, "llamaindex_vector")
        .when(F.col("k") == 4, F.when(F.col("chunk_index") == 0, "hybrid").otherwise("fallback"))
        .otherwise(F.col("source_method"))
    )
    query = F.when(F.col("k") == 0, "who is John").when(F.col("k") == 4, "count all rows that any of these many words give").otherwise("plain words")
    one = (F.col("k") != 5) | ((F.pmod(F.floor(F.col("arrival_ord") / 2), F.lit(5)) == 0) & (F.col("chunk_index") == 0))
    return rows.filter(one).withColumn("source_method", method).withColumn("query", query).drop("k")


MIXED = CANDIDATES + """, mixed_candidates AS (
  SELECT * REPLACE (CASE query_id % 6 WHEN 2 THEN 'database_hybrid' WHEN 3 THEN 'llamaindex_vector' WHEN 4 THEN CASE WHEN chunk_index = 0 THEN 'hybrid' ELSE 'fallback' END ELSE source_method END AS source_method,
                    CASE query_id % 6 WHEN 0 THEN 'who is John' WHEN 4 THEN 'count all rows that any of these many words give' ELSE 'plain words' END AS query)
  FROM candidates WHERE query_id % 6 <> 5 OR (arrival_ord // 2 % 5 = 0 AND chunk_index = 0))
"""


def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels as registry rows."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "processed").when(F.col("quality") == 0, "pending_assignment").otherwise("uploaded")
    return rows.select(
        F.col("doc_id").alias("id"),
        F.when(F.pmod("doc_id", F.lit(4)) == 0, F.pmod("doc_id", F.lit(50))).alias("vehicle_id"),
        F.concat(F.lit("doc_"), F.pmod("doc_id", F.lit(800)), F.lit(".md")).alias("original_filename"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("file_hash"),
        F.col("lang").alias("document_type"),
        status.alias("status"),
        F.col("n_chars").alias("size"),
        F.col("source"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lpad((F.pmod("doc_id", F.lit(20)) + 170).cast("string"), 3, "0"), F.lit("-D-"), (F.pmod("doc_id", F.lit(90)) + 10000).cast("string"))).alias("vrn"),
        F.col("doc_id").alias("uploaded_at"),
    )


REGISTRY = """
registry AS (SELECT d.doc_id AS id, CASE WHEN d.doc_id % 4 = 0 THEN d.doc_id % 50 END AS vehicle_id, 'doc_' || (d.doc_id % 800) || '.md' AS original_filename,
                    sha256(text) AS file_hash, lang AS document_type,
                    CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'processed' WHEN quality = 0 THEN 'pending_assignment' ELSE 'uploaded' END AS status,
                    n_chars AS size, source,
                    CASE WHEN d.doc_id % 3 = 0 THEN lpad(CAST(d.doc_id % 20 + 170 AS VARCHAR), 3, '0') || '-D-' || (d.doc_id % 90 + 10000) END AS vrn, d.doc_id AS uploaded_at
             FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as vehicles with three expiry dates."""
    day = F.to_date("o_orderdate")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lpad((F.pmod("o_orderkey", F.lit(20)) + 170).cast("string"), 3, "0"), F.lit("-d-"), (F.pmod("o_orderkey", F.lit(200)) + 10000).cast("string")).alias("registration_number"),
        F.col("o_custkey").alias("owner_id"),
        F.element_at(F.array(*map(F.lit, ("active", "inactive", "maintenance"))), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int")).alias("status"),
        day.alias("insurance_expiry"),
        F.date_add(day, F.pmod("o_orderkey", F.lit(60)).cast("int")).alias("tax_expiry"),
        F.when(F.pmod("o_orderkey", F.lit(5)) != 0, F.date_add(day, 30)).alias("nct_expiry"),
    )


VEHICLES = """
vehicles AS (SELECT o_orderkey AS id, lpad(CAST(o_orderkey % 20 + 170 AS VARCHAR), 3, '0') || '-d-' || (o_orderkey % 200 + 10000) AS registration_number, o_custkey AS owner_id,
                    ['active', 'inactive', 'maintenance'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS status, CAST(o_orderdate AS DATE) AS insurance_expiry,
                    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS tax_expiry,
                    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + 30 END AS nct_expiry FROM orders)
"""
AS_OF = "1998-01-01"


def with_vrns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a line that names registration numbers, dates and telephone numbers, made from each document's id."""
    n = F.col("doc_id")
    forms = F.array(
        F.concat(F.lit("seen 12-05-2024, car "), F.pmod(n, F.lit(30)) + 170, F.lit("-ky-"), n + 100, F.lit(" parked")),
        F.concat(F.lit("old "), F.lpad(F.pmod(n, F.lit(12)).cast("string"), 2, "0"), F.lit("-D-"), n + 1000, F.lit(" and 191D"), n + 10),
        F.concat(F.lit("call 123-456-7890 on 2024-05-12 about d-"), n + 5),
        F.concat(F.lit("no number here "), n),
    )
    return read(spark, sf_dir, "documents").select("doc_id", F.element_at(forms, (F.pmod(n, F.lit(4)) + 1).cast("int")).alias("text"))


WITH_VRNS = """
with_vrns AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'seen 12-05-2024, car ' || (doc_id % 30 + 170) || '-ky-' || (doc_id + 100) || ' parked'
                     WHEN 1 THEN 'old ' || lpad(CAST(doc_id % 12 AS VARCHAR), 2, '0') || '-D-' || (doc_id + 1000) || ' and 191D' || (doc_id + 10)
                     WHEN 2 THEN 'call 123-456-7890 on 2024-05-12 about d-' || (doc_id + 5) ELSE 'no number here ' || doc_id END AS text FROM documents)
"""


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file_name, text): whole texts, each with its line of numbers, and names that start as the text does, a third of them with a number."""
    lines = with_vrns(spark, sf_dir).withColumnRenamed("text", "line")
    number = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit(" 191-D-"), "doc_id")).otherwise("")
    name = F.concat(F.substring("text", 1, 20), number, F.when(F.pmod("doc_id", F.lit(2)) == 0, "_nct.pdf").otherwise(".pdf"))
    return documents(spark, sf_dir).join(lines.hint("merge"), "doc_id").select("doc_id", name.alias("file_name"), F.concat_ws("\n", "text", "line").alias("text"))


def sql_plain(c: str) -> str:
    """Letters and digits outside ASCII as underscores, so that the ASCII word borders of the SQL are those of all scripts."""
    return f"regexp_replace(replace({c}, 'ß', '__'), '[^\\x00-\\x7F\\P{{L}}]|[^\\x00-\\x7F\\P{{N}}]', '_', 'g')"


NUMBERED = WITH_VRNS.rstrip() + f""", _whole AS (
  SELECT doc_id, substr(coalesce(d.text, ''), 1, 20) || CASE WHEN doc_id % 3 = 0 THEN ' 191-D-' || doc_id ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '_nct.pdf' ELSE '.pdf' END AS file_name,
         coalesce(d.text, '') || chr(10) || v.text AS text FROM documents d JOIN with_vrns v USING (doc_id)),
numbered AS (SELECT doc_id, {sql_plain("file_name")} AS file_name, {sql_plain("text")} AS text FROM _whole)
"""
