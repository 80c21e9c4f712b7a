"""Nested metadata made of whole documents, its census and its cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metadata
from ..registry import read, register


def _metadata() -> Column:
    """A document's metadata: a size that is a number or a text, an object with an array of lines, and the whole text."""
    size = F.when(F.col("lang") == "en", F.to_json(F.struct(F.col("n_chars").alias("word_count")))).otherwise(F.to_json(F.struct(F.col("n_chars").cast("string").alias("word_count"))))
    rest = F.to_json(F.struct(F.col("source").alias("file_name"), F.struct("lang", F.struct(F.split("text", "\n").alias("lines")).alias("body")).alias("origin"), "text"))
    return F.concat(F.regexp_replace(size, r"\}$", ""), F.when(size != "{}", ",").otherwise(""), F.substring(rest, 2, 2**31 - 1))


_LINES = "SELECT unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL"


@register(
    "a33_metadata_census",
    f"""WITH v AS (SELECT 'word_count' AS path, 'word_count' AS key, 'content' AS g, CASE WHEN lang = 'en' THEN 'BIGINT' ELSE 'STRING' END AS t, CAST(n_chars AS VARCHAR) AS s FROM documents WHERE n_chars IS NOT NULL
UNION ALL SELECT 'file_name', 'file_name', 'file', 'STRING', source FROM documents WHERE source IS NOT NULL UNION ALL SELECT 'text', 'text', 'content', 'STRING', text FROM documents WHERE text IS NOT NULL
UNION ALL SELECT 'origin', 'origin', 'other', 'OBJECT', NULL FROM documents UNION ALL SELECT 'origin.lang', 'lang', 'other', 'STRING', lang FROM documents WHERE lang IS NOT NULL
UNION ALL SELECT 'origin.body', 'body', 'other', 'OBJECT', NULL FROM documents UNION ALL SELECT 'origin.body.lines', 'lines', 'other', 'ARRAY', NULL FROM documents WHERE text IS NOT NULL
UNION ALL SELECT 'origin.body.lines[]', NULL, 'other', 'STRING', l FROM ({_LINES}))
SELECT path, max(key) AS key, max(g) AS "group", count(*) AS present, array_to_string(list_sort(list_distinct(list(t))), ',') AS types, coalesce(min(substr(s, 1, 100)), '') AS least, coalesce(max(substr(s, 1, 100)), '') AS greatest FROM v GROUP BY path""",
)
def a33_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metadata.key_census(read(spark, sf_dir, "documents").select(_metadata().alias("metadata")), "metadata")
    end = lambda i: F.coalesce(F.try_element_at("samples", F.lit(i)), F.lit(""))
    return rows.select("path", "key", "group", "present", "types", end(1).alias("least"), end(-1).alias("greatest"))


@register(
    "f03_clean_metadata",
    "SELECT doc_id, sha256(substr(replace(text, chr(0), ''), 1, 1000)) AS text_hash, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda l: substr(replace(l, chr(0), ''), 1, 1000)), chr(10))) AS lines_hash, n_chars FROM documents",
)
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of the object, and of the array two levels down, are cut; numbers and texts of numbers stay."""
    shape = "struct<word_count:string,text:string,origin:struct<body:struct<lines:array<string>>>>"
    rows = read(spark, sf_dir, "documents").select("doc_id", F.from_json(metadata.clean_json(_metadata()), shape).alias("m"))
    return rows.select("doc_id", T.sha256(F.col("m.text")).alias("text_hash"), T.sha256(F.array_join("m.origin.body.lines", "\n")).alias("lines_hash"), F.col("m.word_count").cast("long").alias("n_chars"))
