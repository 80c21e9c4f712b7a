"""Hooks for outside models beside their native defaults, and the parsing of what models answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as T
from ..operators import chunking, hooks, validate
from ..registry import read, register
from ..sources import files
from .corpus import REASON_SQL
from .inputs import sql_words


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, query, text): each turn and the one after it."""
    turns = read(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    return turns.select("conv_id", "turn", F.col("text").alias("query")).join(later.hint("merge"), ["conv_id", "turn"])


_ANSWERS = "a AS (SELECT q.conv_id, q.turn, coalesce(q.text, '') AS query, coalesce(t.text, '') AS text FROM conversations q JOIN conversations t ON t.conv_id = q.conv_id AND t.turn = q.turn + 1)"


@register(
    "x02_relevance_hook",
    f"WITH {_ANSWERS}, w AS (SELECT *, list_distinct({sql_words('lower(query)')}) AS words FROM a), s AS (SELECT conv_id, turn, CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda w: contains(lower(text), w))) * 10.0::DOUBLE / len(words) ELSE 0 END AS s FROM w) "
    "SELECT conv_id, turn, round(s, 6) AS native, round(s, 6) AS hook FROM s",
)
def x02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default score and the same as an outside scorer, of every turn and its answer."""
    q, t = F.col("query"), F.col("text")
    return _answers(spark, sf_dir).select("conv_id", "turn", F.round(hooks.relevance(q, t), 6).alias("native"), F.round(hooks.relevance(q, t, hooks.word_scorer), 6).alias("hook"))


@register("x03_extraction_hook")
def x03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity of every turn by an outside extractor and the rules, whether it stands, and the variants to search for; the choice is tested in plain Python."""
    q = F.col("text")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", hooks.extracted(q, "names", hooks.name_extractor).alias("o"), hooks.rules(q).alias("r"))
    rows = rows.withColumn("e", hooks.extraction(q, F.col("o"), F.col("r")))
    standing = Q.validate_entity(F.col("e.entity"), q)
    return rows.select(
        "conv_id", "turn", F.col("o.entity").alias("outside"), F.col("o.confidence").alias("outside_confidence"), "e.entity", "e.confidence", "e.method",
        standing["is_valid"].alias("stands"), F.array_join(Q.variants(F.col("e"), F.coalesce(q, F.lit(""))), "|").alias("variants"),
    )


_NAME = r"'^\s*(\S+(?:\s\S+)?)', 1"


@register(
    "f35_standing_entities",
    f"""WITH n AS (SELECT doc_id, coalesce(string_split(text, chr(10))[1], '') AS query, regexp_extract(coalesce(string_split(text, chr(10))[-1], ''), {_NAME}) AS name FROM documents)
SELECT doc_id, CAST(CASE WHEN length(trim(name)) < 2 THEN 0 WHEN lower(name) IN ('and the', 'the and') THEN 0.95 WHEN len(list_intersect({sql_words('lower(name)')}, ['question', 'query', 'extract', 'name', 'tell', 'about', 'who', 'is', 'find', 'show'])) > 0 THEN 0.1
 WHEN length(name) > length(query) THEN 0.1 ELSE 0.6 END AS DOUBLE) AS confidence FROM n""",
)
def f35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of a document's last line as an entity of its first line."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    name = F.regexp_extract(F.element_at(lines, -1), r"^\s*(\S+(?:\s\S+)?)", 1)
    return read(spark, sf_dir, "documents").select("doc_id", Q.validate_entity(name, lines[0], ("and the", "the and"))["confidence"].alias("confidence"))


@register(
    "f50_parsed_replies",
    "SELECT doc_id, lang = 'en' AS is_valid, CASE lang WHEN 'en' THEN 'person_search' WHEN 'de' THEN 'date_query' ELSE 'unknown' END AS intent, CASE WHEN lang = 'fr' THEN 0.5 ELSE CAST('0.' || n_chars AS DOUBLE) END AS confidence, "
    "sha256(trim(replace(text, chr(10), ' '), ' ' || chr(9) || chr(13))) AS reason FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL",
)
def f50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with a whole text as reason, in lines around an earlier answer; one language's names no number, two name no known intent."""
    line = lambda key, value: F.concat(F.lit(f" {key}: "), value)
    lang, text = F.col("lang"), F.col("text")
    intent = F.when(lang == "en", "Person_Search").when(lang == "de", "date_query").otherwise(lang)
    confidence = F.when(lang == "fr", "high").otherwise(F.concat(F.lit("0."), F.col("n_chars").cast("string")))
    reply = F.concat_ws("\n", F.lit("VALID: maybe"), text, line("VALID", F.when(lang == "en", "Yes, it is").otherwise("no")), line("INTENT", intent), F.lit(""), line("CONFIDENCE", confidence), line("REASON", F.replace(text, F.lit("\n"), F.lit(" "))))
    rows = read(spark, sf_dir, "documents").filter("text IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL").select("doc_id", Q.parsed_validation(reply).alias("r"))
    return rows.select("doc_id", "r.is_valid", "r.intent", "r.confidence", T.sha256(F.col("r.reason")).alias("reason"))


@register(
    "f04_repaired_bytes",
    r"SELECT doc_id, sha256(regexp_replace(CASE WHEN lang IN ('fr', 'de') THEN regexp_replace(text, '[^\x00-\x{FF}]', '?', 'g') ELSE text END, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{95}]', '', 'g')) AS hash FROM documents",
)
def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of two languages as bytes of Latin-1, the others as UTF-8, read again without knowing which."""
    narrow = F.encode(F.regexp_replace("text", r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    content = F.when(F.col("lang").isin("fr", "de"), narrow).otherwise(F.encode("text", "UTF-8"))
    return read(spark, sf_dir, "documents").select("doc_id", T.sha256(files.repaired(content)).alias("hash"))


@register(
    "c04_enriched_chunks",
    f"WITH p AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), '. ') AS l FROM documents))) "
    f"SELECT doc_id, chunk_index, '2024-01-01' AS indexed_at, length(text) AS content_length, len({sql_words('text')}) AS word_count, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '\\S'))) AS paragraph_count FROM p WHERE {REASON_SQL} = 'valid'",
)
def c04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid chunks between full stops, with their counts."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\. ")).alias("chunk_index", "text"))
    good, _ = validate.split_valid(rows, validate.chunk_reason(F.col("text")))
    return validate.enriched(good, F.lit("2024-01-01")).select("doc_id", "chunk_index", "indexed_at", "content_length", "word_count", "paragraph_count")


@register(
    "c09_chosen_readings",
    "WITH c AS (SELECT *, CAST(strlen(html) * 7 % 100 AS DOUBLE) / 100 AS p, CAST(strlen(url) * 11 % 100 AS DOUBLE) / 100 AS s FROM pages) SELECT page_id, sha256(CASE WHEN p >= 0.5 OR s <= p THEN url ELSE html END) AS hash FROM c WHERE url IS NOT NULL AND html IS NOT NULL",
)
def c09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of each page: the first, unless it is unsure and the second is surer."""
    rows = read(spark, sf_dir, "pages").filter("url IS NOT NULL AND html IS NOT NULL")
    sure = lambda c, by: (F.pmod(F.octet_length(c) * by, F.lit(100)) / F.lit(100.0)).alias("confidence")
    first = rows.select(F.col("page_id").alias("doc_id"), F.lit(0).alias("image"), F.lit("primary").alias("engine"), F.col("url").alias("text"), sure("html", 7))
    second = rows.select(F.col("page_id").alias("doc_id"), F.lit(0).alias("image"), F.lit("second").alias("engine"), F.col("html").alias("text"), sure("url", 11))
    return chunking.choose_ocr(first.unionByName(second)).select(F.col("doc_id").alias("page_id"), T.sha256(F.col("text")).alias("hash"))
