"""From query texts to response rows: plan, retrieve, dedup, fuse, gate and shape, for a whole table of queries.

Each stage is written before the next one reads it, and the second search gets only the queries that the first left open.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import query as Q
from ..storage import written
from . import evaluate, fusion, grams, keyword, retrieval, vector


class Found(NamedTuple):
    """``planned``: a row for each valid query; ``hits``: what the searches found; ``fused``: ranked rows after dedup, fusion and filter; ``decisions``: whether re-ranking may be skipped."""

    planned: DataFrame
    hits: DataFrame
    fused: DataFrame
    decisions: DataFrame


def candidate_rows(hits: DataFrame, planned: DataFrame, method: str, after: int) -> DataFrame:
    """Hits (query_id, chunk_id, file_name, chunk_index, text, score, match_type, occurrences, place) as the rows that fusion takes."""
    asked = planned.select("query_id", "query")
    return hits.join(asked.hint("merge"), "query_id").select(
        "query_id",
        "query",
        "chunk_id",
        "file_name",
        "chunk_index",
        F.col("text").alias("full_content"),
        F.col("score").alias("similarity_score"),
        F.lit(method).alias("source_method"),
        "match_type",
        F.lit(None).cast("string").alias("database_strategy"),
        F.col("occurrences").cast("int").alias("query_occurrences"),
        F.lit(0).alias("n_metadata"),
        (F.col("place") + after).cast("long").alias("arrival_ord"),
    )


def search(queries: DataFrame, chunks: DataFrame, index: grams.GramIndex | None = None, vectors: DataFrame | None = None, dim: int = 16) -> Found:
    """Run every stage for ``queries`` (query_id, query) over ``chunks`` (chunk_id, file_name, chunk_index, text).

    ``index`` and ``vectors`` (id = the index's ord, vec) are built where none are given.  Invalid queries have no row anywhere.
    """
    index = index or grams.build(chunks)
    if vectors is None:
        vectors = vector.embed(index.chunks.select(F.col("ord").alias("id"), "text"), "text", dim=dim).select("id", "vec")
    shards = vector.sharded(vectors)
    planned = written(retrieval.plan(queries))

    def by_word(asked: DataFrame) -> DataFrame:
        rows = keyword.keyword_search(asked.select("query_id", "query"), chunks, index=index)
        placed = rows.join(index.chunks.select("chunk_id", F.col("ord").alias("place")).hint("merge"), "chunk_id")
        return candidate_rows(placed, asked, "database_hybrid", 0)

    def by_vector(asked: DataFrame) -> DataFrame:
        found = written(vector.exact_top_k(vector.embed(asked.select("query_id", "query"), "query", dim=dim), None, 50, shards=shards))
        near = found.join(asked.select("query_id", "top_k", "threshold").hint("merge"), "query_id").filter("rank <= top_k AND score >= threshold")
        rows = near.join(index.chunks.withColumnRenamed("ord", "id").hint("merge"), "id")
        rows = rows.select("query_id", "chunk_id", "file_name", "chunk_index", "text", "score", F.lit(None).cast("string").alias("match_type"), F.lit(None).alias("occurrences"), F.col("rank").alias("place"))
        return candidate_rows(rows, asked, "llamaindex_vector", 0).withColumn("arrival_ord", F.col("arrival_ord") + (1 << 62))  # after all of the first search

    hits = written(retrieval.execute(planned, by_word, by_vector))
    # fusion reads a query's entity and terms many times a row, so they are found once a row and written
    unique = fusion.dedup_retrieved(hits).withColumn("_name", Q.entity(F.col("query"))).withColumn("_entity", F.when(F.col("_name.confidence") > 0.7, F.col("_name.entity"))).drop("_name")
    unique = written(unique.withColumn("_terms", F.coalesce(Q.required_terms(F.col("_entity")), F.array().cast("array<string>"))))
    fused = written(fusion.fuse(unique, entity=F.col("_entity"), terms=F.col("_terms")).drop("_entity", "_terms"))
    return Found(planned, hits, fused, fusion.rerank_gate(fused))


def responses(found: Found) -> DataFrame:
    """Response rows of each query, up to its top_k, with whether re-ranking may be skipped."""
    rows = found.fused.join(found.planned.select("query_id", "top_k").hint("merge"), "query_id")
    shown = fusion.response(rows, F.col("top_k"))
    return shown.join(found.decisions.hint("merge"), "query_id")


def measured(found: Found, least: int = 3) -> DataFrame:
    """Precision, recall and reciprocal rank of each planned query, a row being relevant if it holds the query's words in a row."""
    ranked = found.fused.select("query_id", "rank", F.lower("full_content").contains(F.lower("query")).alias("relevant"))
    return evaluate.metrics(ranked, found.planned.select("query_id", F.lit(least).alias("min_relevant")))
