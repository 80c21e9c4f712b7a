"""The search of a whole table of queries: which searches each query needs, and the union of what they find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as T
from ..storage import written

Search = Callable[[DataFrame], DataFrame]

ENOUGH_DATABASE_HITS = 10


def plan(queries: DataFrame) -> DataFrame:
    """query_id, query as searched, strategy, top_k and threshold of each valid query."""
    q = F.col("query")
    rows = queries.withColumn("v", Q.validate(q)).filter("v.is_valid").withColumn("e", Q.entity(F.col("v.sanitized")))
    named = F.col("e.confidence") > 0.7
    params = Q.search_params(F.col("v.sanitized"), named)
    return rows.select("query_id", Q.rewrite_count_query(F.col("v.sanitized")).alias("query"), Q.search_strategy(F.col("v.sanitized"), named).alias("strategy"), params["top_k"].alias("top_k"), Q.smart_threshold(q, named).alias("threshold"))


def execute(planned: DataFrame, keyword: Search, vector: Search, enough: int = ENOUGH_DATABASE_HITS) -> DataFrame:
    """Rows of both searches for each query.

    Keyword search is for all; a query of strategy database_priority with ``enough`` hits is done.
    Vector search gets the others alone; queries without any row get a second
    vector search with twice their top_k (50 at most) and no threshold.  Each search takes queries and gives rows with
    query_id; the queries it is given are decided by joins, so nothing is searched in vain.  Queries and hits are written between the steps.
    """
    planned = written(planned)  # a row for each query
    hits = written(keyword(planned))
    counts = hits.groupBy("query_id").agg(F.count("*").alias("_hits"))
    judged = planned.join(counts.hint("merge"), "query_id", "left")
    open_ = judged.filter((F.col("strategy") != "database_priority") | (F.coalesce("_hits", F.lit(0)) < enough)).drop("_hits")
    found = hits.unionByName(written(vector(written(open_))), allowMissingColumns=True)
    empty = written(planned.join(found.select("query_id").distinct().hint("merge"), "query_id", "left_anti"))
    if empty.isEmpty():
        return found
    wider = empty.withColumn("top_k", F.least(F.lit(50), F.col("top_k") * 2)).withColumn("threshold", F.lit(0.0))
    return found.unionByName(vector(wider), allowMissingColumns=True)


#: Words of a question that are no name.
QUESTION_WORDS = "question query extract name tell about who is find show".split()


def cleaned_extraction(text: Column, query: Column) -> Column:
    """Struct (entity, confidence) of an external extractor's reply to ``query``: a label before, a filler word behind, and quotes go."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)^(name|answer|result)[:=]\s*", ""), r"(?i)\s*(is|the|answer|result)$", "")
    name = T.stripped(F.regexp_replace(F.regexp_replace(bare, "^[\"']+|[\"']+$", ""), r"\s+", " "))
    confidence = (
        F.when(F.length(name) < 2, 0.0)
        .when(F.arrays_overlap(T.words(F.lower(name)), F.array(*map(F.lit, QUESTION_WORDS))), 0.2)
        .when(F.length(name) > F.length(query), 0.1)
        .when(F.regexp_like(name, F.lit("^[A-Z][a-z]+(?: [A-Z][a-z]+)*$")), 0.9)
        .when(F.size(T.words(name)) <= 3, 0.7)
        .otherwise(0.5)
    )
    return F.struct(name.alias("entity"), confidence.alias("confidence"))


def first_value(values: Column, *keys: str) -> Column:
    """The first non-empty value of a map among ``keys``."""
    return F.coalesce(*(F.nullif(F.trim(values[k]), F.lit("")) for k in keys))
