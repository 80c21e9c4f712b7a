"""Batch search: keyword, vector, fusion and its measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions.text import sha256
from ..operators import evaluate, fusion, keyword, vector
from ..registry import oracle_sql_of, read, register
from . import inputs as I
from .inputs import CANDIDATES, CHUNKS, SEARCH_QUERIES, sql_words

K = f"WITH {CHUNKS}, {SEARCH_QUERIES}"
C = f"WITH {CANDIDATES}"

_EXACT = """
exact AS (SELECT query_id, chunk_id, file_name, chunk_index, text, CAST((length(lower(text)) - length(replace(lower(text), lower(query), ''))) / length(query) AS INTEGER) AS occurrences
          FROM search_queries JOIN chunks ON contains(lower(text), lower(query)) AND query <> ''
           AND regexp_matches(lower(text), '(^|[^a-z0-9])' || regexp_escape(lower(query)) || '([^a-z0-9]|$)')
           AND len(list_filter(string_split_regex(lower(query), '[^a-z0-9]+'), lambda t: t <> '')) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(text), file_name, chunk_index, chunk_id) AS rank FROM exact)
"""


@register("p02_exact_phrase", f"{K}, {_EXACT} SELECT query_id, chunk_id, occurrences, round(least(0.95, 0.6 + 0.05 * occurrences), 6)::DOUBLE AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 20")
def p02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyword.exact_search(I.search_queries(spark, sf_dir), I.chunks(spark, sf_dir))
    return rows.select("query_id", "chunk_id", "occurrences", F.round("score", 6).alias("score"), "rank")


@register("p02_substring", f"{K} SELECT query_id, count(*) AS n FROM search_queries JOIN chunks ON contains(lower(text), lower(query)) GROUP BY 1")
def p02s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.phrase_pairs(I.search_queries(spark, sf_dir), I.chunks(spark, sf_dir), "substring").groupBy("query_id").agg(F.count("*").alias("n"))


_STOP = "[" + ", ".join(f"'{w}'" for w in Q.SEARCH_STOP_WORDS) + "]"
_COUNTED = "list_sum(list_transform(t, lambda w: (length(lower(text)) - length(replace(lower(text), w, ''))) // length(w)))"
_TERMS = f"""
terms AS (SELECT query_id, list_filter({sql_words("lower(query)")}, lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w)) AS t FROM search_queries),
by_term AS (SELECT DISTINCT query_id, unnest(t) AS term FROM terms),
met AS (SELECT DISTINCT query_id, chunk_id FROM by_term JOIN chunks ON contains(lower(text), term)),
loose AS (SELECT m.query_id, m.chunk_id, len(list_filter(t, lambda w: contains(lower(text), w))) AS found, CAST({_COUNTED} AS BIGINT) AS occurrences,
          row_number() OVER (PARTITION BY m.query_id ORDER BY length(text), file_name, chunk_index, m.chunk_id) AS rank,
          least(0.6, 0.6 * 0.8 + len(list_filter(t, lambda w: contains(lower(text), w))) / len(t) * 0.2 + least(0.2, {_COUNTED} * 0.02)) AS score
          FROM met m JOIN terms USING (query_id) JOIN chunks c ON m.chunk_id = c.chunk_id)
"""


@register("p03_any_term", f"{K}, {_TERMS} SELECT query_id, chunk_id, CAST(found AS INTEGER) AS found, occurrences, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM loose WHERE rank <= 20")
def p03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyword.terms_search(I.search_queries(spark, sf_dir), I.chunks(spark, sf_dir))
    return rows.select("query_id", "chunk_id", "found", "occurrences", F.round("score", 6).alias("score"), "rank")


_SUBSTRING = """
held AS (SELECT s.query_id, c.chunk_id, CAST((length(lower(text)) - length(replace(lower(text), lower(query), ''))) / length(query) AS INTEGER) AS occurrences,
         row_number() OVER (PARTITION BY query_id ORDER BY length(text), file_name, chunk_index, chunk_id) AS rank
         FROM search_queries s JOIN chunks c ON contains(lower(text), lower(query)) AND query <> ''),
best AS (SELECT * FROM held WHERE rank <= 20),
n AS (SELECT query_id, count(*) AS n FROM best GROUP BY 1),
rest AS (SELECT l.query_id, l.chunk_id, l.score, row_number() OVER (PARTITION BY l.query_id ORDER BY l.rank) AS rank FROM loose l LEFT JOIN best b USING (query_id, chunk_id) WHERE b.rank IS NULL)
"""


@register(
    "r02_keyword_search",
    f"{K}, {_TERMS}, {_SUBSTRING} SELECT query_id, chunk_id, 'exact_phrase' AS match_type, round(least(0.95, 0.6 + 0.05 * occurrences), 6)::DOUBLE AS score FROM best "
    "UNION ALL SELECT query_id, chunk_id, 'flexible_terms' AS match_type, round(score, 6)::DOUBLE AS score FROM rest LEFT JOIN n USING (query_id) WHERE rank <= 20 - coalesce(n, 0)",
)
def r02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyword.keyword_search(I.search_queries(spark, sf_dir), I.chunks(spark, sf_dir))
    return rows.select("query_id", "chunk_id", "match_type", F.round("score", 6).alias("score"))


@register("r03_full_documents", f"{K}, {_EXACT}, f AS (SELECT DISTINCT query_id, file_name FROM ranked WHERE rank <= 3), e AS (SELECT f.query_id, c.chunk_id, row_number() OVER (PARTITION BY f.query_id ORDER BY c.file_name, c.chunk_index, c.chunk_id) AS rank FROM f JOIN chunks c USING (file_name)) SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM e WHERE rank <= 50")
def r03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.chunks(spark, sf_dir)
    found = keyword.exact_search(I.search_queries(spark, sf_dir), rows, 3)
    return keyword.expand_documents(found, rows).select("query_id", "chunk_id", "rank")


@register("e06_false_substrings", f"WITH {CHUNKS} SELECT count(*) AS n FROM chunks WHERE contains(lower(text), 'another') AND NOT regexp_matches(lower(text), '(^|[^a-z0-9_])other([^a-z0-9_]|$)')")
def e06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.false_substrings(I.chunks(spark, sf_dir), "other", "another").agg(F.count("*").alias("n"))


# Vector search ------------------------------------------------------------------------------------------------------

_NORM = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_SCORES = f"""
WITH v AS (SELECT vec_id, {_NORM} AS v, label FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(q.v, c.v), 9) AS score, q.label = c.label AS relevant FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return rows.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "vec", "label"), rows


def _found(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    queries, rows = _vectors(spark, sf_dir)
    found = vector.exact_top_k(queries, rows, k + 1).filter("query_id <> id").withColumn("score", F.round("score", 9))
    return vector.ranked(found.drop("rank"), k)


@register("v02_exact_cosine", f"{_SCORES} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20")
def v02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, 20).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@register("v03_cell_probe")
def v03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate: 14 of 16 cells, as vectors without clusters need, by their codes, and 100 rows a query exactly.  The tests measure its recall against ``v02_exact_cosine``; a query's own row is no hit."""
    queries, rows = _vectors(spark, sf_dir)
    found = vector.probe_top_k(queries, rows, 21, cells=16, probes=14, rerank=100).filter("query_id <> id").drop("rank")
    return vector.ranked(found, 20).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@register("v06_similarity_bands", f"{_SCORES} SELECT CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.6 THEN 'medium' WHEN score >= 0.4 THEN 'low' ELSE 'poor' END AS band, count(*) AS n FROM r WHERE rank <= 20 GROUP BY 1")
def v06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, 20).groupBy(vector.band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


@register("v08_answer_confidence", f"{_SCORES} SELECT query_id, round(avg(score), 6) AS confidence FROM r WHERE rank <= 5 GROUP BY 1")
def v08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.answer_confidence(_found(spark, sf_dir, 20))


@register("v09_normalized", f"SELECT vec_id, round(sqrt(list_sum(list_transform({_NORM}, lambda x: x * x))), 6) AS norm, round(1.0, 6)::DOUBLE AS unit FROM embeddings")
def v09(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    unit = vector.normalize(F.col("embedding"))
    return rows.select("vec_id", F.round(F.sqrt(vector.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"), F.round(F.sqrt(vector.dot(unit, unit)), 6).alias("unit"))


@register("a22_dimension_census", "SELECT len(embedding) AS dim, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM embeddings), 6) AS percent, coalesce(len(embedding) = 64, false) AS expected FROM embeddings GROUP BY 1")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.dimension_census(read(spark, sf_dir, "embeddings"), 64, "embedding")


@register("v01_hashed_embedding")
def v01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "benchmark").select("item_id", vector.hashed_embedding(F.coalesce("text", F.lit("")), 16).alias("vec"))
    return rows.select("item_id", F.array_join(F.transform("vec", lambda x: F.round(x, 6).cast("string")), ",").alias("vec"))


@register(
    "e01_retrieval_metrics",
    f"{_SCORES} SELECT q.vec_id AS query_id, round(coalesce(count(*) FILTER (relevant AND rank <= 5), 0) / 5, 6) AS precision, round(least(1.0, coalesce(count(*) FILTER (relevant AND rank <= 10), 0) / 3), 6)::DOUBLE AS recall, "
    "round(coalesce(1 / min(CASE WHEN relevant THEN rank END), 0), 6)::DOUBLE AS reciprocal_rank FROM (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL) q LEFT JOIN (SELECT * FROM r WHERE rank <= 20) x ON x.query_id = q.vec_id GROUP BY 1",
)
def e01(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, rows = _vectors(spark, sf_dir)
    found = _found(spark, sf_dir, 20).join(rows.select("id", F.col("label").alias("c")).hint("merge"), "id").join(queries.select("query_id", F.col("label").alias("q")).hint("merge"), "query_id")
    ranked = found.select("query_id", "rank", (F.col("q") == F.col("c")).alias("relevant"))
    return evaluate.metrics(ranked, queries.filter("vec IS NOT NULL").select("query_id", F.lit(3).alias("min_relevant")))


@register(
    "e04_summary",
    f"WITH m AS ({oracle_sql_of('e01_retrieval_metrics')}) SELECT count(*) AS queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS mrr, round(avg(CASE WHEN precision >= 0.4 THEN 1 ELSE 0 END), 6) AS pass_rate FROM m",
)
def e04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(e01(spark, sf_dir), F.lit(0.5))


# Fusion -------------------------------------------------------------------------------------------------------------

_W = "CASE source_method WHEN 'llamaindex_vector' THEN 0.7 WHEN 'database_hybrid' THEN 1.0 WHEN 'hybrid' THEN 1.1 ELSE 1.0 END"
_TIE = "file_name, chunk_index, chunk_id"


def _first(order: str, rows: str = "candidates") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, substr(full_content, 1, 200) ORDER BY {order}) AS o FROM {rows}) WHERE o = 1"


@register("r07_dedup_retrieved", f"{C} SELECT query_id, chunk_id FROM ({_first(f'''CASE WHEN source_method LIKE 'database%' THEN 0 ELSE 1 END, similarity_score DESC, arrival_ord, {_TIE}''')})")
def r07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.dedup_retrieved(I.candidates(spark, sf_dir)).select("query_id", "chunk_id")


_FUSED_ORDER = f"CASE WHEN contains(source_method, 'database') THEN 0 ELSE 1 END, similarity_score DESC, {_W} DESC, n_metadata DESC, arrival_ord, {_TIE}"
_FUSED = _first(_FUSED_ORDER)


@register("r08_dedup_fused", f"{C} SELECT query_id, chunk_id FROM ({_FUSED})")
def r08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.dedup_fused(I.candidates(spark, sf_dir)).select("query_id", "chunk_id")


@register(
    "f15_hybrid_score",
    f"{C} SELECT query_id, chunk_id, round(least(10.0, similarity_score * CASE WHEN source_method LIKE 'database%' THEN 1.0 ELSE 0.7 END * CASE WHEN length(full_content) BETWEEN 100 AND 2000 THEN 1.05 ELSE 1.0 END), 6)::DOUBLE AS score FROM candidates",
)
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.candidates(spark, sf_dir)
    return rows.select("query_id", "chunk_id", F.round(fusion.hybrid_score(rows), 6).alias("score"))


def _priority(test: str, factor: float) -> str:
    return f"{C} SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity_score * CASE WHEN {test} THEN {factor}::DOUBLE ELSE 1.0::DOUBLE END DESC, {_TIE}) AS INTEGER) AS rank FROM candidates"


@register("r12_database_priority", _priority("contains(source_method, 'database')", 1.3))
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.candidates(spark, sf_dir)
    return fusion.top_by(rows, fusion.priority_score("database"), F.lit(1_000_000)).select("query_id", "chunk_id", "rank")


@register("r13_vector_priority", _priority("contains(source_method, 'vector')", 1.2))
def r13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.candidates(spark, sf_dir)
    return fusion.top_by(rows, fusion.priority_score("vector"), F.lit(1_000_000)).select("query_id", "chunk_id", "rank")


_DB = "contains(source_method, 'database')"
_VEC = "(contains(source_method, 'vector') OR contains(source_method, 'llamaindex'))"


def _by_rank(rows: str) -> str:
    """The scores of ``reciprocal_rank`` over a relation, as ``rrf``."""
    return f"""m AS (SELECT *, substr(full_content, 1, 100) AS key, row_number() OVER (PARTITION BY query_id, source_method ORDER BY similarity_score DESC, arrival_ord, {_TIE}) AS mr FROM {rows}),
b AS (SELECT query_id, file_name, key, source_method, min(mr) AS best, count(*) AS n FROM m GROUP BY ALL),
w AS (SELECT query_id, file_name, key, arg_min({_W}::DOUBLE, arrival_ord) AS weight FROM m GROUP BY ALL),
g AS (SELECT query_id, file_name, key, sum(n / (60 + best)) AS s, count(*) AS methods, bool_or({_DB}) AS db, bool_or({_VEC}) AS vec FROM b GROUP BY ALL),
rrf AS (SELECT query_id, file_name, key, s * weight * CASE WHEN methods <= 1 THEN 1.0 WHEN db AND vec THEN 1.4 ELSE 1.0 + (methods - 1) * 0.2 END::DOUBLE AS rrf_score, methods FROM g JOIN w USING (query_id, file_name, key))"""


@register("r14_reciprocal_rank", f"{C}, {_by_rank('candidates')} SELECT query_id, file_name, sha256(key) AS key, round(rrf_score, 9) AS rrf_score, methods FROM rrf")
def r14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.reciprocal_rank(I.candidates(spark, sf_dir))
    return rows.select("query_id", "file_name", sha256(F.col("key")).alias("key"), F.round("rrf_score", 9).alias("rrf_score"), "methods")


@register(
    "r09_strategies",
    f"""WITH {I.MIXED}, h AS (SELECT query_id, count(*) AS n, bool_or(contains(source_method, 'database')) AS db, bool_or(contains(source_method, 'vector') OR contains(source_method, 'llamaindex')) AS vec,
 count(DISTINCT source_method) AS methods, bool_or(starts_with(query, 'who is')) AS person, max(len(string_split(query, ' '))) AS words FROM mixed_candidates GROUP BY 1)
SELECT query_id, CASE WHEN n = 1 THEN 'single_result' WHEN person AND db THEN 'hybrid_person_priority' WHEN db AND vec THEN 'hybrid_weighted_fusion' WHEN db THEN 'database_priority' WHEN vec THEN 'vector_priority'
 WHEN words > 6 AND methods >= 2 THEN 'reciprocal_rank_fusion' ELSE 'hybrid_weighted_fusion' END AS strategy, person AS is_person FROM h""",
)
def r09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.strategies(I.mixed_candidates(spark, sf_dir))


_LETTER = r"[\p{L}\p{N}_]"
_OTHER = r"[^\p{L}\p{N}_]"


def _holds(phrase: str, content: str) -> str:
    """Whether a phrase stands at word borders in a lower-case text."""
    before = f"CASE WHEN regexp_matches({phrase}, '^{_LETTER}') THEN '(^|{_OTHER})' ELSE '{_LETTER}' END"
    after = f"CASE WHEN regexp_matches({phrase}, '{_LETTER}$') THEN '($|{_OTHER})' ELSE '{_LETTER}' END"
    return f"CASE WHEN trim({phrase}) <> '' AND contains({content}, lower({phrase})) THEN regexp_matches({content}, {before} || regexp_escape(lower({phrase})) || {after}) ELSE false END"


def _count_held(phrases: tuple[str, ...], content: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {_holds(repr(p), content)} THEN 1 ELSE 0 END" for p in phrases) + ")"


_PERSON = (
    f"((contains(lower(query), 'who is') OR contains(lower(query), 'tell me about') OR contains(lower(query), 'show me') OR contains(lower(query), 'find') OR contains(lower(query), 'about')) "
    f"AND regexp_matches(query, '(^|{_OTHER})[A-Z][a-z]+($|{_OTHER})') OR coalesce(regexp_matches(entity, '(^|{_OTHER})[A-Za-z][A-Za-z]+\\s+[A-Za-z][A-Za-z]+($|{_OTHER})'), false))"
)
_LENGTH = "CASE WHEN length(full_content) BETWEEN 100 AND 2000 THEN 1.1 WHEN length(full_content) < 50 THEN {0} ELSE 1.0 END::DOUBLE"
_OFTEN = "CASE WHEN query_occurrences > 1 THEN least(1.3::DOUBLE, 1.0::DOUBLE + query_occurrences * 0.1::DOUBLE) ELSE 1.0 END::DOUBLE"
#: ``seen``: the relation ``named`` (candidates with entity and terms) with what its scores ask of the texts.
_SEEN = f"""
seen AS (SELECT *, CASE WHEN length(full_content) > 500 THEN substr(full_content, 1, 500) || '...' ELSE full_content END || ' ' || full_content || ' ' || file_name AS shown, {_PERSON} AS person FROM named),
told AS (SELECT * REPLACE (lower(shown) AS shown), {_holds("query", "lower(shown)")} AS exact, {_holds("entity", "lower(shown)")} AS names_entity,
                {_holds("coalesce(entity, query)", "lower(full_content)")} AS text_names_entity, {_count_held(fusion.TRAINING_WORDS[:5], "lower(full_content)")} AS text_training,
                CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: {_holds("t", "lower(shown)")})) / len(terms) ELSE 0 END::DOUBLE AS coverage,
                {_count_held(fusion.TRAINING_WORDS, "lower(shown)")} AS training, {_count_held(fusion.SIGNATURE_WORDS, "lower(shown)")} AS signature FROM seen),
scored AS (SELECT *,
  similarity_score * {_W}::DOUBLE * CASE match_type WHEN 'exact_phrase' THEN 1.4 WHEN 'exact_match' THEN 1.2 ELSE 1.0 END::DOUBLE
   * CASE WHEN exact THEN CASE WHEN person THEN 1.3 ELSE 1.2 END ELSE 1.0 END::DOUBLE * CASE WHEN names_entity THEN CASE WHEN person THEN 1.3 ELSE 1.2 END ELSE 1.0 END::DOUBLE
   * CASE WHEN coverage > 0.5 THEN 1.0::DOUBLE + coverage * 0.3::DOUBLE ELSE 1.0 END::DOUBLE * {_OFTEN} * {_LENGTH.format(0.8)}
   * CASE WHEN NOT person OR coalesce(entity, '') = '' THEN 1.0 WHEN training > 0 THEN 1.1 WHEN signature >= 2 THEN 0.9 ELSE 1.0 END::DOUBLE AS weighted,
  least(1.0::DOUBLE, similarity_score * CASE WHEN text_names_entity THEN 1.4 ELSE 1.0 END::DOUBLE * ((1.0::DOUBLE + text_training * 0.1::DOUBLE) * {_OFTEN})) AS by_person,
  least(1.0::DOUBLE, similarity_score * {_LENGTH.format(0.9)} * CASE WHEN similarity_score > 0.7 THEN 1.05 ELSE 1.0 END::DOUBLE) AS by_meaning,
  CASE WHEN {_DB} THEN 0 WHEN {_VEC} THEN 1 ELSE 2 END AS block FROM told)
"""
_PERSON_BLOCKS = "CASE block WHEN 0 THEN by_person WHEN 1 THEN by_meaning ELSE similarity_score END"
_UNNAMED = "named AS (SELECT *, NULL::VARCHAR AS entity, []::VARCHAR[] AS terms FROM {0})"


def _rank(order: str) -> str:
    return f"CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS INTEGER) AS rank"


def _fuse_sql(named: str) -> str:
    """The rows of ``fuse`` as ``fused``, from a relation ``named`` made of ``uniq``, the deduplicated candidates."""
    return f"""WITH {I.MIXED}, uniq AS ({_first(_FUSED_ORDER, "mixed_candidates")}), {named}, {_SEEN},
h AS (SELECT query_id, count(*) AS n, bool_or({_DB}) AS with_db, bool_or({_VEC}) AS with_vec, count(DISTINCT source_method) AS methods, bool_or(person) AS is_person,
             max(len(list_filter(string_split(query, ' '), lambda t: t <> ''))) AS query_words FROM scored GROUP BY 1),
s AS (SELECT *, CASE WHEN n = 1 THEN 'single_result' WHEN is_person AND with_db THEN 'hybrid_person_priority' WHEN with_db AND with_vec THEN 'hybrid_weighted_fusion' WHEN with_db THEN 'database_priority'
      WHEN with_vec THEN 'vector_priority' WHEN query_words > 6 AND methods >= 2 THEN 'reciprocal_rank_fusion' ELSE 'hybrid_weighted_fusion' END AS strategy FROM h),
chosen AS (SELECT * EXCLUDE (n, methods) FROM scored JOIN s USING (query_id)), ranked_only AS (SELECT * FROM chosen WHERE strategy = 'reciprocal_rank_fusion'),
{_by_rank("ranked_only")},
whole AS (SELECT * EXCLUDE (mr, key, firsts), round(rrf_score, 12) AS fused_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_name, key ORDER BY arrival_ord, chunk_id) AS firsts FROM m)
           JOIN (SELECT query_id, file_name, key, rrf_score FROM rrf) USING (query_id, file_name, key) WHERE firsts = 1),
every AS (SELECT query_id, chunk_id, file_name, chunk_index, source_method, similarity_score, strategy, is_person, with_db, 0 AS part, fused_score FROM whole
          UNION ALL SELECT query_id, chunk_id, file_name, chunk_index, source_method, similarity_score, strategy, is_person, with_db, CASE WHEN strategy = 'hybrid_person_priority' THEN block ELSE 0 END AS part,
           CASE strategy WHEN 'hybrid_person_priority' THEN {_PERSON_BLOCKS} WHEN 'database_priority' THEN similarity_score * CASE WHEN {_DB} THEN 1.3 ELSE 1.0 END::DOUBLE
            WHEN 'vector_priority' THEN similarity_score * CASE WHEN {_VEC} THEN 1.2 ELSE 1.0 END::DOUBLE WHEN 'single_result' THEN similarity_score ELSE weighted END AS fused_score
          FROM chosen WHERE strategy <> 'reciprocal_rank_fusion'),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, fused_score DESC, {_TIE}) AS place FROM every),
bound AS (SELECT query_id, greatest(0.3::DOUBLE, max(similarity_score) FILTER (place = 1) * 0.5::DOUBLE) AS least FROM placed GROUP BY 1),
kept AS (SELECT * FROM placed JOIN bound USING (query_id) WHERE CASE WHEN strategy = 'hybrid_weighted_fusion' THEN fused_score ELSE similarity_score END >= CASE WHEN is_person AND with_db THEN 0.25::DOUBLE ELSE least END),
fused AS (SELECT * FROM (SELECT *, {_rank("place")} FROM kept) WHERE rank <= 50)"""


@register("r10_weighted_fusion", f"{C}, {_UNNAMED.format('candidates')}, {_SEEN} SELECT query_id, chunk_id, round(weighted, 6) AS score, {_rank(f'weighted DESC, {_TIE}')} FROM scored")
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = fusion.weighted_score(F.lit(None).cast("string"), F.array().cast("array<string>"))
    return fusion.top_by(I.candidates(spark, sf_dir), score, F.lit(1_000_000)).select("query_id", "chunk_id", F.round("fused_score", 6).alias("score"), "rank")


@register(
    "r11_person_priority",
    f"{C}, {_UNNAMED.format('candidates')}, {_SEEN} SELECT query_id, chunk_id, block, round({_PERSON_BLOCKS}, 6) AS score, {_rank(f'block, {_PERSON_BLOCKS} DESC, {_TIE}')} FROM scored",
)
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.person_priority(I.candidates(spark, sf_dir), F.lit(None).cast("string"))
    return rows.select("query_id", "chunk_id", "block", F.round("fused_score", 6).alias("score"), "rank")


_NAMED = "named AS (SELECT *, CASE WHEN query_id % 6 = 0 THEN string_split(full_content, ' ')[1] END AS entity, string_split(query, ' ') AS terms FROM uniq)"


@register("r15_fuse", f"{_fuse_sql(_NAMED)} SELECT query_id, chunk_id, strategy, round(fused_score, 6) AS score, rank FROM fused")
def r15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.mixed_candidates(spark, sf_dir)
    entity = F.when(F.pmod("query_id", F.lit(6)) == 0, F.element_at(F.split("full_content", " "), 1))
    return fusion.fuse(rows, entity=entity, terms=F.split("query", " ")).select("query_id", "chunk_id", "strategy", F.round("fused_score", 6).alias("score"), "rank")


@register(
    "a29_fusion_metrics",
    f"""{_fuse_sql(_UNNAMED.format("uniq"))}, before AS (SELECT query_id, count(*) AS original_count FROM mixed_candidates GROUP BY 1),
after AS (SELECT query_id, count(*) AS n, round(avg(fused_score), 6) AS avg_score, round(min(fused_score), 6) AS min_score, round(max(fused_score), 6) AS max_score,
                 count(*) FILTER ({_DB}) AS d, count(*) FILTER ({_VEC} AND NOT {_DB}) AS v FROM fused GROUP BY 1)
SELECT query_id, original_count, coalesce(n, 0) AS final_count, avg_score, min_score, max_score, coalesce(d, 0) AS database_results, coalesce(v, 0) AS vector_results,
       round(coalesce(n, 0) / original_count, 6) AS dedup_ratio, coalesce(d, 0) > 0 AND coalesce(v, 0) > 0 AS mixed_sources, abs(coalesce(d, 0) - coalesce(v, 0)) <= 2 AS balanced
FROM before LEFT JOIN after USING (query_id)""",
)
def a29(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.mixed_candidates(spark, sf_dir)
    return fusion.fusion_metrics(rows, fusion.fuse(rows))


_RANKED = f"x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, {_TIE}) AS rank FROM candidates)"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.top_by(I.candidates(spark, sf_dir), F.col("similarity_score"), F.lit(1_000_000))


@register(
    "r16_rerank",
    f"{C}, {_RANKED}, s AS (SELECT *, CASE WHEN n_metadata > 2 THEN CAST(n_metadata AS DOUBLE) ELSE 5.0 END AS llm_score FROM x) SELECT query_id, chunk_id, llm_score, llm_score >= 2.5 AS is_relevant, "
    f"CAST(row_number() OVER (PARTITION BY query_id ORDER BY llm_score DESC, rank, {_TIE}) AS INTEGER) AS rerank FROM s",
)
def r16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir)
    scores = I.candidates(spark, sf_dir).filter("n_metadata > 2").select("query_id", "chunk_id", F.col("n_metadata").cast("double").alias("llm_score"))
    return fusion.rerank(rows, scores).select("query_id", "chunk_id", "llm_score", "is_relevant", "rerank")


@register(
    "r17_rerank_gate",
    f"{C}, {_RANKED}, h AS (SELECT query_id, count(*) FILTER (contains(source_method, 'database') AND similarity_score >= 0.85) AS strong, count(DISTINCT file_name) AS files, min(similarity_score) AS low, min(similarity_score) FILTER (rank <= 3) AS top3 FROM x GROUP BY 1) "
    "SELECT query_id, CASE WHEN strong >= 3 THEN 'keep_strong' WHEN files <= 2 AND low >= 0.70 THEN 'skip_few_files' WHEN files <= 3 AND top3 >= 0.80 THEN 'skip_top_high' ELSE 'score' END AS decision FROM h",
)
def r17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rerank_gate(_ranked(spark, sf_dir))


@register("r18_best_per_file", f"{C} SELECT query_id, file_name, max(similarity_score) AS best_score, array_to_string(list_sort(list(DISTINCT source_method)), ',') AS found_by, count(*) AS chunks FROM candidates GROUP BY ALL")
def r18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.best_per_file(I.candidates(spark, sf_dir))
    return rows.withColumn("found_by", F.array_join("found_by", ","))


@register(
    "r19_response",
    f"{C}, {_RANKED} SELECT query_id, CAST(rank AS INTEGER) AS rank, file_name, chunk_index, CASE WHEN length(full_content) > 200 THEN substr(full_content, 1, 200) || '...' ELSE full_content END AS preview, "
    "round(CASE WHEN match_type = 'exact_phrase' THEN 0.95 ELSE similarity_score END, 6)::DOUBLE AS display_score FROM x WHERE rank <= 4",
)
def r19(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir).withColumn("query", F.lit("plain words"))
    return fusion.response(rows, F.lit(4))


@register("a30_quality_histogram", f"{C} SELECT query_id, count(*) FILTER (similarity_score >= 0.8) AS excellent, count(*) FILTER (similarity_score >= 0.6 AND similarity_score < 0.8) AS good, count(*) FILTER (similarity_score >= 0.4 AND similarity_score < 0.6) AS moderate, count(*) FILTER (similarity_score < 0.4) AS low FROM candidates GROUP BY 1")
def a30(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("similarity_score")
    return I.candidates(spark, sf_dir).groupBy("query_id").agg(F.count_if(s >= 0.8).alias("excellent"), F.count_if((s >= 0.6) & (s < 0.8)).alias("good"), F.count_if((s >= 0.4) & (s < 0.6)).alias("moderate"), F.count_if(s < 0.4).alias("low"))


@register("a31_method_quality", f"{C} SELECT source_method, count(*) AS n, round(avg(similarity_score), 6) AS mean, round(stddev_samp(similarity_score), 6) AS std, min(similarity_score) AS low, max(similarity_score) AS high, round(100 * count(*) / (SELECT count(*) FROM candidates), 6) AS percent FROM candidates GROUP BY 1")
def a31(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("similarity_score")
    rows = I.candidates(spark, sf_dir).groupBy("source_method").agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("mean"), F.round(F.stddev_samp(s), 6).alias("std"), F.min(s).alias("low"), F.max(s).alias("high"))
    return rows.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@register("a32_by_document", f"{C} SELECT query_id, file_name, max(similarity_score) AS best, count(*) AS n, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunks FROM candidates GROUP BY ALL")
def a32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.candidates(spark, sf_dir).groupBy("query_id", "file_name").agg(F.max("similarity_score").alias("best"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("chunk_id")), ",").alias("chunks"))


@register("a49_query_summary", f"{C} SELECT query_id, count(*) FILTER (contains(source_method, 'database')) AS database, count(*) FILTER (contains(source_method, 'vector')) AS vector, count(*) FILTER (similarity_score >= 0.8) AS high, count(*) FILTER (similarity_score >= 0.7 AND similarity_score < 0.8) AS medium FROM candidates GROUP BY 1")
def a49(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, m = F.col("similarity_score"), F.col("source_method")
    return I.candidates(spark, sf_dir).groupBy("query_id").agg(F.count_if(fusion.is_database(m)).alias("database"), F.count_if(fusion.is_vector(m)).alias("vector"), F.count_if(s >= 0.8).alias("high"), F.count_if((s >= 0.7) & (s < 0.8)).alias("medium"))


@register("j13_run_difference", f"{C}, a AS (SELECT DISTINCT file_name FROM candidates WHERE source_method = 'hybrid'), b AS (SELECT DISTINCT file_name FROM candidates WHERE similarity_score > 0.9) SELECT coalesce(a.file_name, b.file_name) AS file_name, CASE WHEN b.file_name IS NULL THEN 'only_a' WHEN a.file_name IS NULL THEN 'only_b' ELSE 'both' END AS side FROM a FULL OUTER JOIN b ON a.file_name = b.file_name")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.candidates(spark, sf_dir)
    a = rows.filter("source_method = 'hybrid'").select("file_name").distinct().withColumn("a", F.lit(True))
    b = rows.filter("similarity_score > 0.9").select("file_name").distinct().withColumn("b", F.lit(True))
    return a.join(b.hint("merge"), "file_name", "full_outer").select("file_name", F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("both").alias("side"))
