"""Query planning functions over user turns, and registration numbers in text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import vrn
from ..functions.text import words
from ..registry import register
from . import inputs as I
from .inputs import USER_QUERIES, NUMBERED, sql_words

U = f"WITH {USER_QUERIES}"
V = f"WITH {NUMBERED}"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _any(c: str, phrases) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{p}')" for p in phrases) + ")"


def _forms(c: str, forms, flags: str = "(?i)") -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, '{flags}{f}')" for f in forms) + ")"


_TRIMMED = "regexp_replace(query, '^\\s+|\\s+$', '', 'g')"


@register(
    "f26_validate_query",
    f"""{U}, t AS (SELECT query_id, query, {_TRIMMED} AS q FROM user_queries), e AS (SELECT query_id, query,
  CASE WHEN query IS NULL OR query = '' THEN 'empty' WHEN length(query) > 1000 THEN 'too_long' WHEN q = '' THEN 'empty' WHEN {_forms("q", Q.SQL_ATTACKS)} THEN 'sql_pattern'
   WHEN {_forms("q", Q.SCRIPT_ATTACKS)} THEN 'script_pattern' WHEN length(regexp_replace(q, '[\\p{{L}}\\p{{N}}\\s\\-_.,?!''"]', '', 'g')) > length(q) * 0.3 THEN 'special_characters' END AS error FROM t)
SELECT query_id, error IS NULL AS is_valid, CASE WHEN error IS NULL THEN trim(regexp_replace(query, '\\s+', ' ', 'g')) ELSE '' END AS sanitized, error FROM e""",
)
def f26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.user_queries(spark, sf_dir).select("query_id", Q.validate(F.col("query")).alias("v")).select("query_id", "v.*")


@register("f27_clamp_params", f"{U} SELECT query_id, greatest(1, least(50, length(query) - 20)) AS top_k, length(query) - 20 BETWEEN 1 AND 50 AS k_valid, greatest(0.0, least(1.0, (length(query) - 50) / 40)) AS threshold, (length(query) - 50) / 40 BETWEEN 0 AND 1 AS t_valid FROM user_queries")
def f27(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("query")
    rows = I.user_queries(spark, sf_dir).select("query_id", Q.clamp_top_k(n - 20).alias("k"), Q.clamp_threshold((n - 50) / 40).alias("t"))
    return rows.select("query_id", F.col("k.value").alias("top_k"), F.col("k.was_valid").alias("k_valid"), F.col("t.value").alias("threshold"), F.col("t.was_valid").alias("t_valid"))


@register("f28_precheck", f"{U} SELECT coalesce(CASE WHEN query IS NULL OR trim(query) = '' THEN 'empty' WHEN length(trim(query)) < 2 THEN 'too_short' WHEN regexp_matches(query, '^[^a-zA-Z0-9]+$') THEN 'only_special' END, 'fine') AS verdict, count(*) AS n FROM user_queries GROUP BY 1")
def f28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.user_queries(spark, sf_dir).groupBy(F.coalesce(Q.precheck(F.col("query")), F.lit("fine")).alias("verdict")).agg(F.count("*").alias("n"))


_IS_STOP = f"list_contains({_list(Q.STOP_WORDS)}, lower(regexp_replace(w, '[^A-Za-z0-9_]', '', 'g')))"


@register(
    "f29_stop_words",
    f"{U}, w AS (SELECT query_id, {sql_words('query')} AS ws FROM user_queries) SELECT query_id, array_to_string(list_filter(ws, lambda w: NOT {_IS_STOP}), ' ') AS kept, len(list_filter(ws, lambda w: {_IS_STOP})) AS removed FROM w",
)
def f29(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.user_queries(spark, sf_dir).select("query_id", Q.without_stop_words(F.col("query")).alias("s"))
    return rows.select("query_id", F.col("s.kept").alias("kept"), F.size("s.removed").alias("removed"))


_TRIPLE = "len(list_filter(range(1, length(t) - 1), lambda i: substr(t, i, 1) = substr(t, i + 1, 1) AND substr(t, i, 1) = substr(t, i + 2, 1))) > 0"
_EXPANDED = "CASE lower(w) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Q.ACRONYMS.items()) + " ELSE w END"


@register(
    "f30_needs_enhancement",
    f"""{U}, w AS (SELECT query_id, query, {sql_words("lower(query)")} AS ws FROM user_queries)
SELECT query_id, (len(ws) = 1 AND length(ws[1]) <= 4) OR list_has_any(ws, {_list(Q.ACRONYMS)}) OR len(list_filter(ws, lambda t: length(t) > 3 AND {_TRIPLE})) > 0 AS needed,
 array_to_string(list_transform({sql_words("query")}, lambda w: {_EXPANDED}), ' ') AS expanded FROM w""",
)
def f30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.user_queries(spark, sf_dir).select("query_id", Q.needs_enhancement(F.col("query")).alias("needed"), Q.expand_acronyms(F.col("query")).alias("expanded"))


def _has(values) -> str:
    return f"list_has_any(string_split_regex(lower(query), '\\s+'), {_list(values)})"


@register(
    "f32_intent",
    f"""{U}, t AS (SELECT query_id, trim(query) AS q, query, len({sql_words("lower(query)")}) AS n FROM user_queries)
SELECT query_id, CASE WHEN q = '' OR length(q) < 2 THEN 'invalid' WHEN n = 1 AND list_contains({_list(Q.SINGLE_STOP_WORDS)}, lower(q)) THEN 'invalid'
 WHEN regexp_matches(q, '\\d{{2,3}}-[A-Z]-\\d{{4,5}}') THEN 'vehicle_search' WHEN regexp_matches(q, '(^|[^\\p{{L}}\\p{{N}}_])[A-Z][a-z]+(?: [A-Z][a-z]+)+($|[^\\p{{L}}\\p{{N}}_])') THEN 'person_search'
 WHEN {_has(Q.VEHICLE_WORDS)} THEN 'vehicle_search' WHEN {_has(Q.PERSON_WORDS)} THEN 'person_search' WHEN {_has(Q.DOCUMENT_WORDS)} THEN 'document_search' WHEN {_has(Q.DATE_WORDS)} THEN 'date_search'
 WHEN n >= 2 THEN 'unknown' ELSE 'invalid' END AS intent FROM t""",
)
def f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.user_queries(spark, sf_dir)
    return rows.select("query_id", Q.intent(F.col("query"))["intent"].alias("intent"))


@register("f33_entities")
def f33(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.user_queries(spark, sf_dir).withColumn("e", Q.entity(F.col("query")))
    return rows.select("query_id", "e.entity", "e.confidence", "e.method", F.array_join(Q.variants(F.col("e"), F.col("query")), "|").alias("variants"), Q.validate_entity(F.col("e.entity"), F.col("query"))["confidence"].alias("validity"))


@register("f37_rewrites")
def f37(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.user_queries(spark, sf_dir).withColumn("r", Q.rewrites(F.col("query"), 3))
    return rows.select("query_id", F.posexplode("r").alias("position", "rewrite"))


def _words(c: str) -> str:
    return f"len({sql_words(c)})"


@register("f38_rewrite_count", f"{U} SELECT query_id, CASE WHEN {_words('query')} <= 2 THEN 2 WHEN {_words('query')} >= 6 THEN 3 ELSE 2 END AS n FROM user_queries")
def f38(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.user_queries(spark, sf_dir).select("query_id", Q.rewrite_count(F.col("query")).alias("n"))


@register(
    "f18_document_kind",
    f"{U} SELECT query_id, CASE WHEN regexp_matches(query, '(?i)\\d{{2,3}}-[A-Z]-\\d{{4,5}}') THEN 'VRN' WHEN {_any('query', Q.COUNT_PHRASES)} THEN 'Aggregation' WHEN {_any('query', Q.DOCUMENT_PHRASES)} THEN 'Document' END AS kind, "
    f"{_forms('trim(lower(query))', Q.COUNT_FORMS, '^')} AS counts FROM user_queries",
)
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("query")
    return I.user_queries(spark, sf_dir).select("query_id", Q.document_kind(q).alias("kind"), Q.is_count_query(q).alias("counts"))


_REWRITE = " ".join(f"WHEN regexp_matches(trim(lower(query)), '^{f}') THEN '{t}'" for f, t in Q.COUNT_REWRITES)


@register("f40_count_rewrite", f"{U} SELECT query_id, CASE {_REWRITE} WHEN {_forms('trim(lower(query))', Q.COUNT_FORMS, '^')} THEN '{Q.COUNT_REWRITE}' ELSE query END AS rewritten FROM user_queries")
def f40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.user_queries(spark, sf_dir).select("query_id", Q.rewrite_count_query(F.col("query")).alias("rewritten"))


_VERB = _any("query", ("tell", "show", "find", "give"))


@register(
    "f41_search_params",
    f"""{U} SELECT query_id, CASE WHEN {_words("query")} >= 4 THEN 0.4 WHEN {_VERB} THEN 0.45 ELSE 0.5 END::DOUBLE AS threshold, CASE WHEN {_words("query")} >= 4 THEN 30 WHEN {_VERB} THEN 50 ELSE 20 END AS top_k,
 CASE WHEN {_any("query", ("who is", "tell me about", "show me"))} THEN 'database_priority' WHEN {_words("query")} >= 6 THEN 'vector_priority' ELSE 'hybrid' END AS strategy,
 CASE WHEN {_words("query")} <= 3 THEN 'simple' WHEN {_words("query")} <= 6 THEN 'medium' ELSE 'complex' END AS complexity FROM user_queries""",
)
def f41(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, no = F.col("query"), F.lit(False)
    rows = I.user_queries(spark, sf_dir).withColumn("p", Q.search_params(q, no))
    return rows.select("query_id", "p.threshold", "p.top_k", Q.search_strategy(q, no).alias("strategy"), Q.complexity(q).alias("complexity"))


@register("f39_overlap", f"{U}, w AS (SELECT query_id, list_distinct({sql_words('lower(query)')}) AS a, list_distinct({sql_words('lower(reverse(query))')}) AS b FROM user_queries) SELECT query_id, round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) AS overlap FROM w")
def f39(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.user_queries(spark, sf_dir).select("query_id", F.round(Q.overlap(F.col("query"), F.reverse("query")), 6).alias("overlap"))


@register("r01_query_plan")
def r01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan of each query in one projection."""
    q = F.col("query")
    rows = I.user_queries(spark, sf_dir).withColumn("v", Q.validate(q)).withColumn("e", Q.entity(q))
    has = F.col("e.confidence") > 0.7
    return rows.select(
        "query_id", F.col("v.is_valid").alias("is_valid"), F.when(has, F.col("e.entity")).alias("entity"), Q.rewrite_count_query(F.col("v.sanitized")).alias("searched"),
        F.size(Q.rewrites(q)).alias("variants"), Q.search_strategy(q, has).alias("strategy"), Q.search_params(q, has)["top_k"].alias("top_k"), Q.smart_threshold(q, has).alias("threshold"),
    )


#: Text that may be the start of a registration number, and a number without hyphens.
_PAIR = r"[^\s-]+-[^\s-]+"
_JOINED = r"(?i)\d{2,3} ?[A-Z]{1,2} ?\d{1,6}"


@register("f16_vrn_tests", f"{V} SELECT doc_id, regexp_matches(text, '(?i)\\d{{2,3}}-[A-Z]{{1,2}}-\\d{{4,5}}') AS is_vrn, regexp_matches(trim(regexp_extract(text, '{_PAIR}', 0)), '(?i)^\\d{{2,3}}-[A-Z]{{1,2}}$') AS is_partial FROM numbered")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.numbered(spark, sf_dir).select("doc_id", vrn.is_vrn(F.col("text")).alias("is_vrn"), vrn.is_partial_vrn(F.regexp_extract("text", _PAIR, 0)).alias("is_partial"))


def _norm_sql(c: str) -> str:
    raw = f"replace(upper(trim({c})), ' ', '')"
    whole = f"regexp_replace({raw}, '^(\\d{{2,3}})([A-Z]{{1,2}})(\\d{{1,6}})$', '\\1-\\2-\\3')"
    return f"regexp_replace({whole}, '^([A-Z]{{1,2}})(\\d{{1,6}})$', '\\1-\\2')"


def _first_sql(c: str, whole: bool) -> str:
    out = []
    for form in vrn.FIRST_FORMS:
        joined = f"regexp_extract({c}, '{form}', 0)" if whole else " || ".join(f"regexp_extract({c}, '{form}', {i + 1})" for i in range(form.count("(")))
        out.append(f"CASE WHEN regexp_matches({c}, '{form}') THEN {_norm_sql('(' + joined + ')')} END")
    return f"coalesce({', '.join(out)})"


@register("f20_first_vrn", f"{V} SELECT doc_id, {_first_sql('text', False)} AS vrn, {_norm_sql(f"regexp_extract(text, '{_JOINED}', 0)")} AS normal FROM numbered")
def f20(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = vrn.normalize(F.regexp_extract("text", _JOINED, 0))
    return I.numbered(spark, sf_dir).select("doc_id", vrn.first_in_text(F.col("text")).alias("vrn"), normal.alias("normal"))


@register("f23_vrn_in_filename", f"{V} SELECT doc_id, {_first_sql('file_name', True)} AS vrn FROM numbered")
def f23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.numbered(spark, sf_dir).select("doc_id", vrn.first_in_filename(F.col("file_name")).alias("vrn"))


def _county_sql(c: str) -> str:
    hyphened = f"CASE WHEN regexp_matches({c}, '(?i)^[^-]*-[A-Z]{{1,2}}(-|$)') THEN upper(string_split({c}, '-')[2]) END"
    return f"coalesce({hyphened}, upper(nullif(regexp_extract({c}, '(?i)^\\d{{2,3}}([A-Z]{{1,2}})\\d+$', 1), '')))"


_VALID = f"length(m) >= 5 AND NOT regexp_matches(m, '{vrn.FALSE_FORMS}') AND {_county_sql('m')} IS NOT NULL"
_COUNTY_LIST = ", ".join(f"'{c}'" for c in vrn.COUNTIES)


def _found_sql(form: str) -> str:
    return f"list_filter(regexp_extract_all(text, '{form}'), lambda m: {_VALID})"


def _scored_sql(form: str, new: bool, rank: int) -> str:
    score = f"CASE WHEN contains(m, '-') THEN 10 ELSE 0 END + {5 if new else 0} + greatest(0, 101 - strpos(upper(text), upper(m))) + CASE WHEN {_county_sql('m')} IN ({_COUNTY_LIST}) THEN 20 ELSE 0 END"
    return f"list_transform({_found_sql(form)}, lambda m, i: {{'score': {score}, 'place': -{rank} * 100000 - i, 'vrn': upper(m)}})"


def _joined_sql(parts: list[str]) -> str:
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


_BEST = f"list_sort({_joined_sql([_scored_sql(form, new, i) for i, (form, new) in enumerate(vrn.SCORED_FORMS)])}, 'DESC')[1].vrn"
_EVERY = f"list_transform({_joined_sql([_found_sql(form) for form, _ in vrn.SCORED_FORMS])}, lambda m: upper(m))"
_DISTINCT = "array_to_string(list_filter(every, lambda v, i: list_position(every, v) = i), ',')"
_LOOSE = "list_concat(list_transform(regexp_extract_all(text, '(?i)\\b\\d{2,3}[- ]?[A-Z]{1,2}[- ]?\\d{1,6}\\b'), lambda v: upper(replace(v, ' ', '-'))), regexp_extract_all(text, '\\b\\d{6,9}\\b'))"


@register("f21_best_vrn", f"{V}, e AS (SELECT doc_id, {_BEST} AS best, {_EVERY} AS every FROM numbered) SELECT doc_id, best, {_DISTINCT} AS every FROM e")
def f21(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return I.numbered(spark, sf_dir).select("doc_id", vrn.best_in_text(t).alias("best"), F.array_join(vrn.all_in_text(t), ",").alias("every"))


@register("f22_all_numbers", f"{V}, e AS (SELECT doc_id, {_EVERY} AS every FROM numbered) SELECT doc_id, {_DISTINCT} AS numbers FROM e")
def f22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.numbered(spark, sf_dir).select("doc_id", F.array_join(vrn.all_in_text(F.col("text")), ",").alias("numbers"))


@register("f24_loose_numbers", f"{V} SELECT doc_id, array_to_string(list_sort(list_distinct({_LOOSE})), ',') AS numbers FROM numbered")
def f24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.numbered(spark, sf_dir).select("doc_id", F.array_join(vrn.loose_in_text(F.col("text")), ",").alias("numbers"))


_METHOD = f"CASE WHEN {_first_sql('file_name', True)} IS NOT NULL THEN 'filename' WHEN {_first_sql('text', False)} IS NOT NULL THEN 'text' ELSE 'not_found' END"


@register("a43_vrn_statistics", f"{V} SELECT {_METHOD} AS method, count(*) AS n, count(DISTINCT coalesce({_first_sql('file_name', True)}, {_first_sql('text', False)})) AS numbers FROM numbered GROUP BY 1")
def a43(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.numbered(spark, sf_dir).select(vrn.first_in_filename(F.col("file_name")).alias("named"), vrn.first_in_text(F.col("text")).alias("read"))
    method = F.when(F.col("named").isNotNull(), "filename").when(F.col("read").isNotNull(), "text").otherwise("not_found")
    return rows.groupBy(method.alias("method")).agg(F.count("*").alias("n"), F.countDistinct(F.coalesce("named", "read")).alias("numbers"))


@register("l12_vrn_enrichment", f"{V} SELECT doc_id, coalesce({_first_sql('file_name', True)}, {_first_sql('text', False)}) AS vrn FROM numbered")
def l12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's number from its name, else from its text."""
    number = F.coalesce(vrn.first_in_filename(F.col("file_name")), vrn.first_in_text(F.col("text")))
    return I.numbered(spark, sf_dir).select("doc_id", number.alias("vrn"))


@register("f57_required_terms", f"{U} SELECT query_id, array_to_string(list_filter({sql_words('lower(query)')}, lambda w: length(w) > 2), ' ') AS terms FROM user_queries")
def f57(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.user_queries(spark, sf_dir).select("query_id", F.array_join(Q.required_terms(F.col("query")), " ").alias("terms"))


@register("f61_word_counts", f"{U} SELECT {_words('query')} AS words, count(*) AS n FROM user_queries GROUP BY 1")
def f61(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.user_queries(spark, sf_dir).groupBy(F.size(words(F.col("query"))).alias("words")).agg(F.count("*").alias("n"))
