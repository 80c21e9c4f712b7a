"""Deduplication, score fusion and re-ranking of candidates from several search methods.

Candidates carry query_id, query, chunk_id, file_name, chunk_index, full_content,
similarity_score, source_method, and, where known, match_type, database_strategy,
query_occurrences, n_metadata and arrival_ord.  All operators work on any number of queries at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as T
from ..functions import vrn
from ..params import SEARCH, SearchParams

#: Weights of methods, and boosts of match types and strategies.
METHOD_WEIGHTS = {
    "llamaindex_vector": 0.7,
    "vector_search": 0.7,
    "vector_smart_threshold": 0.7,
    "database_hybrid": 1.0,
    "database_exact": 1.0,
    "database_direct": 1.0,
    "hybrid": 1.1,
    "spacy": 0.8,
}
STRATEGY_BOOSTS = {
    "exact_phrase": 1.4,
    "person_name_match": 1.3,
    "exact_match": 1.2,
    "database_only": 1.1,
    "vector_better": 1.0,
    "database_better": 1.2,
    "found_by_both": 1.15,
}
TRAINING_WORDS = ("training", "certificate", "certification", "course", "completed", "achieved")
SIGNATURE_WORDS = ("signature", "signed", "form", "date:", "location:")


def _lookup(values: dict[str, float], key: Column, default: float = 1.0) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key], F.lit(default))


def is_database(method: Column) -> Column:
    return method.contains("database")


def is_vector(method: Column) -> Column:
    return method.contains("vector") | method.contains("llamaindex")


def tie_break() -> list[Column]:
    return [F.col("file_name"), F.col("chunk_index"), F.col("chunk_id")]


def first_of(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each group; partial ranks are cut before the shuffle by Spark's window group limit."""
    return rows.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_first = 1").drop("_first")


def dedup_retrieved(rows: DataFrame) -> DataFrame:
    """Of candidates with the same first 200 characters: database before vector, then the higher score, then the earlier one."""
    database_first = F.when(F.col("source_method").startswith("database"), 0).otherwise(1)
    return first_of(rows, ["query_id", F.substring("full_content", 1, 200)], [database_first, F.desc("similarity_score"), "arrival_ord", *tie_break()])


def dedup_fused(rows: DataFrame) -> DataFrame:
    """As above, then by method weight and richer metadata.  The keys are compared one after the other, which makes the rule a total order."""
    database_first = F.when(is_database(F.col("source_method")), 0).otherwise(1)
    order = [database_first, F.desc("similarity_score"), F.desc(_lookup(METHOD_WEIGHTS, F.col("source_method"))), F.desc("n_metadata"), "arrival_ord", *tie_break()]
    return first_of(rows, ["query_id", F.substring("full_content", 1, 200)], order)


def hybrid_score(rows: DataFrame, entity: Column | None = None, params: SearchParams = SEARCH) -> Column:
    """Similarity times method weight, with boosts for registration numbers, entity and length; at most 10."""
    method, content, q = F.col("source_method"), F.col("full_content"), F.col("query")
    database = method.startswith("database")
    holds = F.upper(content).contains(F.upper(q))
    score = F.col("similarity_score") * F.when(database, params.database_weight).otherwise(params.vector_weight)
    number = F.when(vrn.is_vrn(q) & holds, F.when(database, 4.5).otherwise(3.0)).when(~vrn.is_vrn(q) & vrn.is_partial_vrn(q) & holds, 2.0).otherwise(1.0)
    score = score * number
    if entity is not None:
        score = score * F.when(F.lower(content).contains(F.lower(entity)), params.exact_boost).otherwise(1.0)
    return F.least(F.lit(10.0), score * F.when(F.length(content).between(100, 2000), 1.05).otherwise(1.0))


def top_by(rows: DataFrame, score: Column, n: int | Column, name: str = "fused_score") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(name), *tie_break())
    return rows.withColumn(name, score).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _matched_words(keywords, content: Column) -> Column:
    return sum((F.when(T.word_match(F.lit(k), content), 1).otherwise(0) for k in keywords[1:]), F.when(T.word_match(F.lit(keywords[0]), content), 1).otherwise(0))


def context_factor(content: Column, entity: Column, person: Column) -> Column:
    training, signature = _matched_words(TRAINING_WORDS, content), _matched_words(SIGNATURE_WORDS, content)
    return F.when(~person | F.coalesce(entity == "", F.lit(True)), 1.0).when(training > 0, 1.1).when(signature >= 2, 0.9).otherwise(1.0)


def weighted_score(entity: Column, terms: Column, params: SearchParams = SEARCH) -> Column:
    """Similarity x method weight x boosts of strategy, match type, exact match, entity, term coverage, occurrences, length and context.

    ``entity`` may be null, ``terms`` is an array that may be empty.
    """
    q, content = F.col("query"), F.lower(F.concat_ws(" ", T.preview(F.col("full_content"), 500), "full_content", "file_name"))
    person = Q.is_person_query(q, entity)
    length, n = F.length("full_content"), F.coalesce(F.col("query_occurrences"), F.lit(0))
    coverage = F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: T.word_match(t, content))) / F.size(terms)).otherwise(0.0)
    boosts = [
        _lookup(STRATEGY_BOOSTS, F.col("database_strategy")),
        _lookup(STRATEGY_BOOSTS, F.col("match_type")),
        F.when(T.word_match(q, content), F.when(person, params.exact_boost).otherwise(1.2)).otherwise(1.0),
        F.when(F.coalesce(T.word_match(entity, content), F.lit(False)), F.when(person, params.exact_boost).otherwise(1.2)).otherwise(1.0),
        F.when(coverage > 0.5, 1.0 + coverage * 0.3).otherwise(1.0),
        F.when(n > 1, F.least(F.lit(1.3), 1.0 + n * 0.1)).otherwise(1.0),
        F.when(length.between(100, 2000), 1.1).when(length < 50, 0.8).otherwise(1.0),
        context_factor(content, F.coalesce(entity, F.lit("")), person),
    ]
    out = F.col("similarity_score") * _lookup(METHOD_WEIGHTS, F.col("source_method"))
    for b in boosts:
        out = out * b
    return out


def priority_score(kind: str) -> Column:
    """``database``: database rows x 1.3; ``vector``: vector rows x 1.2; others as they are."""
    test, factor = {"database": (is_database(F.col("source_method")), 1.3), "vector": (is_vector(F.col("source_method")), 1.2)}[kind]
    return F.col("similarity_score") * F.when(test, factor).otherwise(1.0)


def person_score(entity: Column) -> Column:
    content, n = F.lower("full_content"), F.coalesce(F.col("query_occurrences"), F.lit(0))
    training = _matched_words(TRAINING_WORDS[:5], content)
    score = F.col("similarity_score") * F.when(T.word_match(F.coalesce(entity, F.col("query")), content), 1.4).otherwise(1.0)
    return F.least(F.lit(1.0), score * (1.0 + training * 0.1) * F.when(n > 1, F.least(F.lit(1.3), 1.0 + n * 0.1)).otherwise(1.0))


def semantic_score() -> Column:
    length, s = F.length("full_content"), F.col("similarity_score")
    return F.least(F.lit(1.0), s * F.when(length.between(100, 2000), 1.1).when(length < 50, 0.9).otherwise(1.0) * F.when(s > 0.7, 1.05).otherwise(1.0))


def person_priority(rows: DataFrame, entity: Column) -> DataFrame:
    """Database rows by person score, then vector rows by semantic score, then others."""
    method = F.col("source_method")
    block = F.when(is_database(method), 0).when(is_vector(method), 1).otherwise(2)
    score = F.when(block == 0, person_score(entity)).when(block == 1, semantic_score()).otherwise(F.col("similarity_score"))
    marked = rows.withColumn("block", block).withColumn("fused_score", score)
    return marked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("block", F.desc("fused_score"), *tie_break())))


def reciprocal_rank(rows: DataFrame, k: int = SEARCH.rrf_k) -> DataFrame:
    """query_id, file_name, key, rrf_score, methods, rank.

    Each method ranks its own rows, ties by arrival.  A result (file and first 100 characters) has the weight of the row that came first, whatever
    the method of the others; each of its rows adds weight / (k + the result's best rank in that row's method).
    The sum is x 1.4 if database and vector both have it, else x (1 + 0.2 for each further method).
    """
    arrival = ["arrival_ord", "chunk_id"]
    by_method = Window.partitionBy("query_id", "source_method").orderBy(F.desc("similarity_score"), "arrival_ord", *tie_break())
    keyed = rows.withColumn("method_rank", F.row_number().over(by_method)).withColumn("key", F.substring("full_content", 1, 100))
    first = F.struct(*arrival, _lookup(METHOD_WEIGHTS, F.col("source_method")).alias("weight"))
    ranked = keyed.groupBy("query_id", "file_name", "key", "source_method").agg(F.min("method_rank").alias("best"), F.count("*").alias("n"), F.min(first).alias("first"))
    summed = ranked.groupBy("query_id", "file_name", "key").agg(
        (F.sum(F.col("n") / (k + F.col("best"))) * F.min("first")["weight"]).alias("sum"),
        F.count("*").alias("methods"),
        F.max(is_database(F.col("source_method"))).alias("db"),
        F.max(is_vector(F.col("source_method"))).alias("vec"),
    )
    boost = F.when(F.col("methods") <= 1, 1.0).when(F.col("db") & F.col("vec"), 1.4).otherwise(1.0 + (F.col("methods") - 1) * 0.2)
    scored = summed.withColumn("rrf_score", F.round(F.col("sum") * boost, 12)).drop("sum", "db", "vec")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "file_name", "key")))


def strategies(rows: DataFrame, entity: Column | None = None) -> DataFrame:
    """(query_id, strategy) by what each query has: person, database, vector, reciprocal rank, weighted, or a single result."""
    method = F.col("source_method")
    person = Q.is_person_query(F.col("query"), entity)
    have = rows.groupBy("query_id").agg(F.max(is_database(method)).alias("db"), F.max(is_vector(method)).alias("vec"), F.countDistinct("source_method").alias("methods"), F.count("*").alias("n"), F.max(person).alias("person"), F.max(Q.complexity(F.col("query"))).alias("complexity"))
    strategy = (
        F.when(F.col("n") == 1, "single_result")
        .when(F.col("person") & F.col("db"), "hybrid_person_priority")
        .when(F.col("db") & F.col("vec"), "hybrid_weighted_fusion")
        .when(F.col("db"), "database_priority")
        .when(F.col("vec"), "vector_priority")
        .when((F.col("complexity") == "complex") & (F.col("methods") >= 2), "reciprocal_rank_fusion")
        .otherwise("hybrid_weighted_fusion")
    )
    return have.select("query_id", strategy.alias("strategy"), F.col("person").alias("is_person"))


def final_filter(rows: DataFrame, score: Column | None = None, params: SearchParams = SEARCH) -> DataFrame:
    """Rows (with rank, fused_score, is_person) whose ``score`` reaches half the first row's similarity, 0.3 at least; 0.25 for a person with database rows; then the first ``max_results``.

    ``score`` is the fused score where none is given.
    """
    whole = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    least = F.greatest(F.lit(0.3), F.first("similarity_score").over(whole) * 0.5)
    with_db = F.max(is_database(F.col("source_method"))).over(whole)
    reached = F.col("fused_score") if score is None else score
    kept = rows.withColumn("_least", F.when(F.col("is_person") & with_db, 0.25).otherwise(least)).filter(reached >= F.col("_least")).drop("_least")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= params.max_results)


def rank_merged(rows: DataFrame) -> DataFrame:
    """Rows with ``fused_score`` by reciprocal ranks: of the rows of one result, told by file and first 100 characters, the one that came first."""
    key = ["query_id", "file_name", "key"]
    keyed = rows.withColumn("key", F.substring("full_content", 1, 100))
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("arrival_ord", "chunk_id"))).filter("_n = 1").drop("_n")
    scores = reciprocal_rank(rows).select(*key, F.col("rrf_score").alias("fused_score"))
    return first.join(scores.hint("merge"), key).drop("key")


def fuse(rows: DataFrame, params: SearchParams = SEARCH, entity: Column | None = None, terms: Column | None = None) -> DataFrame:
    """Dedup, choose each query's strategy, score, order and filter; all queries in one plan.

    ``entity`` (string, may be null) and ``terms`` (array) are columns over ``rows``.  Only the weighted
    strategy is filtered by its fused score; the others by similarity.
    """
    named = rows.withColumn("_entity", (F.lit(None) if entity is None else entity).cast("string"))
    named = named.withColumn("_terms", F.coalesce((F.array() if terms is None else terms).cast("array<string>"), F.array().cast("array<string>")))
    unique = dedup_fused(named)
    chosen = unique.join(strategies(unique, F.col("_entity")).hint("merge"), "query_id")
    name, s, method = F.col("_entity"), F.col("strategy"), F.col("source_method")
    score = (
        F.when(s == "hybrid_person_priority", F.when(is_database(method), person_score(name)).when(is_vector(method), semantic_score()).otherwise(F.col("similarity_score")))
        .when(s == "database_priority", priority_score("database"))
        .when(s == "vector_priority", priority_score("vector"))
        .when(s == "single_result", F.col("similarity_score"))
        .otherwise(weighted_score(name, F.col("_terms"), params))
    )
    by_rank = s == "reciprocal_rank_fusion"
    scored = chosen.filter(~by_rank).withColumn("fused_score", score).unionByName(rank_merged(chosen.filter(by_rank)))
    block = F.when(s == "hybrid_person_priority", F.when(is_database(method), 0).when(is_vector(method), 1).otherwise(2)).otherwise(0)
    order = Window.partitionBy("query_id").orderBy("_block", F.desc("fused_score"), *tie_break())
    ordered = scored.withColumn("_block", block).withColumn("rank", F.row_number().over(order)).drop("_block", "_entity", "_terms")
    return final_filter(ordered, F.when(s == "hybrid_weighted_fusion", F.col("fused_score")).otherwise(F.col("similarity_score")), params)


def fusion_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per query: counts before and after, ratio, score range, sources, and which source dominates."""
    db, vec = is_database(F.col("source_method")), is_vector(F.col("source_method"))
    b = before.groupBy("query_id").agg(F.count("*").alias("original_count"))
    a = after.groupBy("query_id").agg(F.count("*").alias("final_count"), F.round(F.avg("fused_score"), 6).alias("avg_score"), F.round(F.min("fused_score"), 6).alias("min_score"), F.round(F.max("fused_score"), 6).alias("max_score"), F.count_if(db).alias("database_results"), F.count_if(vec & ~db).alias("vector_results"))
    joined = b.join(a.hint("merge"), "query_id", "left").fillna(0, ["final_count", "database_results", "vector_results"])
    return joined.select("*", F.round(F.col("final_count") / F.col("original_count"), 6).alias("dedup_ratio"), ((F.col("database_results") > 0) & (F.col("vector_results") > 0)).alias("mixed_sources"), (F.abs(F.col("database_results") - F.col("vector_results")) <= 2).alias("balanced"))


def rerank(rows: DataFrame, scores: DataFrame, top_k: int | None = None, params: SearchParams = SEARCH) -> DataFrame:
    """By supplied scores (query_id, chunk_id, llm_score); 5 where one is missing.  A low score is flagged, not dropped."""
    joined = rows.drop("llm_score").join(scores.select("query_id", "chunk_id", "llm_score").hint("merge"), ["query_id", "chunk_id"], "left").withColumn("llm_score", F.coalesce("llm_score", F.lit(5.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("llm_score"), "rank", *tie_break())
    out = joined.withColumn("rerank", F.row_number().over(order)).withColumn("is_relevant", F.col("llm_score") >= params.rerank_min_score)
    return out if top_k is None else out.filter(F.col("rerank") <= top_k)


def rerank_gate(rows: DataFrame) -> DataFrame:
    """(query_id, decision): whether re-ranking may be skipped, from counts and scores of a query's rows."""
    s = F.col("similarity_score")
    have = rows.groupBy("query_id").agg(
        F.count_if(is_database(F.col("source_method")) & (s >= 0.85)).alias("strong"),
        F.countDistinct("file_name").alias("files"),
        F.min(s).alias("low"),
        F.min(F.when(F.col("rank") <= 3, s)).alias("top3"),
    )
    decision = F.when(F.col("strong") >= 3, "keep_strong").when((F.col("files") <= 2) & (F.col("low") >= 0.70), "skip_few_files").when((F.col("files") <= 3) & (F.col("top3") >= 0.80), "skip_top_high").otherwise("score")
    return have.select("query_id", decision.alias("decision"))


def best_per_file(rows: DataFrame) -> DataFrame:
    """The best row of each file for each query, and which sources found the file."""
    return rows.groupBy("query_id", "file_name").agg(F.max("similarity_score").alias("best_score"), F.array_sort(F.collect_set("source_method")).alias("found_by"), F.count("*").alias("chunks"))


def display_score(llm: Column, match_type: Column, similarity: Column) -> Column:
    value = F.when(llm.isNotNull(), llm / 10).when(match_type == "exact_phrase", 0.95).when(match_type == "strong_match", 0.85).otherwise(similarity)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def response(rows: DataFrame, top_k: Column) -> DataFrame:
    """Final rows: up to ``top_k`` a query with preview and display score, all rows of document queries."""
    whole = Q.document_kind(F.col("query")).isNotNull()
    shown = rows.filter(whole | (F.col("rank") <= top_k))
    score = display_score(F.lit(None).cast("double"), F.col("match_type"), F.col("similarity_score"))
    return shown.select("query_id", "rank", "file_name", "chunk_index", T.preview(F.col("full_content"), 200).alias("preview"), F.round(score, 6).alias("display_score"))
