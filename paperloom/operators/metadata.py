"""Nested metadata: census of keys by walking variants, cleaning of strings at any depth."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Keys of each group.
GROUPS = {
    "file": ("file_path", "file_name", "file_size", "file_type", "creation_date", "last_modified_date", "last_accessed_date"),
    "content": ("text", "content_length", "word_count", "paragraph_count"),
    "processing": ("indexed_at", "quality_score", "encoding_method", "ocr_extracted"),
}


def key_group(key: Column) -> Column:
    found = F.lit("other")
    for name, keys in GROUPS.items():
        found = F.when(key.isin(*keys), name).otherwise(found)
    return found


def walked(rows: DataFrame, json_col: str) -> DataFrame:
    """(path, key, type, sample) of every value in the objects and arrays of ``json_col``, at any depth.

    ``a.b`` is a key of an object, ``a[]`` an item of an array; type is the variant's, ``VOID`` for a null; a container's sample is null and a value's its first
    100 characters.  A text that is no JSON, or no object or array, has none.  Each level of nesting is a round, written, and the next
    one reads the containers of it alone, so there are as many rounds as the deepest row has levels.
    """
    spark = rows.sparkSession
    level = rows.select(F.lit("").alias("path"), F.col(json_col).alias("value"))
    parts = []
    while True:
        opened = level.select("path", F.try_parse_json("value").alias("v")).filter(F.regexp_like(F.schema_of_variant("v"), F.lit("^(OBJECT|ARRAY)")))
        found = spark.sql("SELECT path AS parent, e.key AS key, e.value AS v FROM {opened}, LATERAL variant_explode(v) AS e", opened=opened)
        path = F.when(F.col("key").isNull(), F.concat("parent", F.lit("[]"))).otherwise(F.concat_ws(".", F.nullif("parent", F.lit("")), "key"))
        kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
        holds = kind.isin("OBJECT", "ARRAY")
        text = F.when(kind == "STRING", F.variant_get("v", "$", "string")).otherwise(F.to_json("v"))
        step = written(found.select(path.alias("path"), "key", kind.alias("type"), F.when(~holds, F.substring(text, 1, 100)).alias("sample"), F.when(holds, F.to_json("v")).alias("value")))
        parts.append(step.drop("value"))
        level = step.filter("value IS NOT NULL").select("path", "value")
        if level.isEmpty():
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def key_census(rows: DataFrame, json_col: str) -> DataFrame:
    """path, key, group, present, types and two samples, the least and the greatest, of every key at any depth."""
    ends = F.array_distinct(F.array_compact(F.array(F.min("sample"), F.max("sample"))))
    return (
        walked(rows, json_col)
        .groupBy("path")
        .agg(F.max("key").alias("key"), F.count("*").alias("present"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"), ends.alias("samples"))
        .select("path", "key", key_group(F.col("key")).alias("group"), "present", "types", "samples")
    )


def clean_json(values: Column, limit: int = 1000) -> Column:
    """JSON text with NUL taken from every string value and the rest cut to ``limit`` characters, at any depth; keys stay; null for what is no JSON.

    No built-in rewrites values of an unknown shape, so batches go through Python.
    """

    return F.arrow_udf("string")(_cleaner(limit))(values)


def _cleaner(limit: int):
    """Of a batch, which has up to 64 MB, 200 texts and their parts are held at once."""

    def plain(v):
        if isinstance(v, str):
            return v.replace("\0", "")[:limit]
        if isinstance(v, list):
            return [plain(x) for x in v]
        return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v

    def one(text):
        try:
            return json.dumps(plain(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError, RecursionError):
            return None

    def cleaned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for i in range(0, len(batch), 200):
                yield pa.array([one(x.as_py()) for x in batch.slice(i, 200)], pa.string())

    return cleaned
