"""Retrieval quality over tables of ranked results and relevant sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_relevant(text: Column, all_of: Column, any_of: Column) -> Column:
    """Whether a text holds all of the one and any of the other words (an empty or null array asks for nothing)."""
    low = F.lower(text)
    every = F.coalesce(F.forall(all_of, lambda w: low.contains(F.lower(w))), F.lit(True))
    some = F.when(F.coalesce(F.size(any_of), F.lit(0)) <= 0, True).otherwise(F.exists(any_of, lambda w: low.contains(F.lower(w))))
    return every & some


def metrics(ranked: DataFrame, queries: DataFrame, k: int = 5, recall_k: int = 10) -> DataFrame:
    """query_id, precision, recall, reciprocal_rank of ``ranked`` (query_id, rank, relevant) for every one of ``queries`` (query_id, min_relevant)."""
    hits = ranked.groupBy("query_id").agg(
        F.count_if(F.col("relevant") & (F.col("rank") <= k)).alias("in_k"),
        F.count_if(F.col("relevant") & (F.col("rank") <= recall_k)).alias("in_recall"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
    )
    joined = queries.join(hits.hint("merge"), "query_id", "left")
    need = F.greatest(F.lit(1), F.col("min_relevant"))
    return joined.select(
        "query_id",
        F.round(F.coalesce("in_k", F.lit(0)) / k, 6).alias("precision"),
        F.round(F.least(F.lit(1.0), F.coalesce("in_recall", F.lit(0)) / need), 6).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )


def summary(measured: DataFrame, expected: Column, share: float = 0.8) -> DataFrame:
    """Averages, and the share of queries that reach ``share`` of the expected precision."""
    return measured.agg(
        F.count("*").alias("queries"),
        F.round(F.avg("precision"), 6).alias("precision"),
        F.round(F.avg("recall"), 6).alias("recall"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
        F.round(F.avg((F.col("precision") >= expected * share).cast("int")), 6).alias("pass_rate"),
    )


def answer_checks(answers: DataFrame) -> DataFrame:
    """query_type, total, passed of (query_type, answer, expected array, should_reject): expected words are there, or the answer is a refusal where one is due."""
    refusal = F.regexp_like(F.lower("answer"), F.lit("cannot|can't|not able|no information|not found"))
    held = F.forall("expected", lambda w: F.lower("answer").contains(F.lower(w)))
    ok = F.when(F.col("should_reject"), refusal).otherwise(held)
    return answers.groupBy("query_type").agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"))


def field_coverage(chunks: DataFrame, fields: dict[str, str], key: str = "file_name") -> DataFrame:
    """Per file and expected field whether any chunk holds its value.  No texts are joined: a maximum of tests is enough."""
    one = chunks.groupBy(key).agg(*(F.max(F.lower("text").contains(v.lower())).alias(n) for n, v in fields.items()))
    return one.select(key, F.explode(F.create_map(*(x for n in fields for x in (F.lit(n), F.col(n))))).alias("field", "found"))


def compare_counts(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    return expected.join(found.hint("merge"), key, "full_outer").select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"), (F.coalesce("found", F.lit(0)) - F.coalesce("expected", F.lit(0))).alias("delta"))
