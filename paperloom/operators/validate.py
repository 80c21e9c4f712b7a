"""Validity of documents and chunks: a reason for each row, rejected rows apart, and reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def document_reason(text: Column, min_chars: int = 50, min_words: int = 3) -> Column:
    """Null for a valid document; sizes are those of the text without white space at its ends."""
    bare = T.stripped(text)
    return F.when(text.isNull() | (bare == ""), "empty").when(F.length(bare) < min_chars, "too_short").when(F.size(T.words(bare)) < min_words, "too_few_words")


def chunk_reason(text: Column, min_chars: int = 50, max_few_words: int = 5) -> Column:
    """Null for a valid chunk; tests in this order: empty, too short, too few words, digits only."""
    trimmed = F.trim(text)
    return (
        F.when(text.isNull() | (trimmed == ""), "empty")
        .when(F.length(trimmed) < min_chars, "too_short")
        .when(F.size(T.words(text)) <= max_few_words, "too_few_words")
        .when(F.regexp_like(F.regexp_replace(trimmed, r"\s+", ""), F.lit("^[0-9]+$")), "digits_only")
    )


#: Characters that no text has: controls but tab and line ends, and, of any script, format, private and unassigned ones.
BINARY = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{80}-\x{84}\x{86}-\x{9F}\p{Cf}\p{Co}\p{Cn}]"


def embedding_reason(text: Column, sample: int = 1000) -> Column:
    """Null for a text fit for an embedder: long enough, not binary, with letters or digits of any script, and words."""
    head = F.substring(text, 1, sample)
    return (
        F.when(text.isNull() | (F.length(T.stripped(text)) < 10), "too_short")
        .when(F.regexp_count(head, F.lit(BINARY)) / F.length(head) > 0.9, "unprintable")
        .when(F.regexp_count(head, F.lit(r"[\p{L}\p{N}]")) / F.length(head) < 0.1, "few_letters")
        .when(F.size(T.words(text)) < 3, "too_few_words")
    )


def null_byte_reason(text: Column, min_chars: int = 10) -> Column:
    return F.when(text.contains("\u0000"), "null_bytes").when(F.length(F.trim(text)) < min_chars, "too_short")


def split_valid(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their reason)."""
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def reason_counts(rows: DataFrame, reason: Column, *keys: str) -> DataFrame:
    return rows.withColumn("reason", F.coalesce(reason, F.lit("valid"))).groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def rule_report(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): every rule in one pass."""
    one = rows.agg(*(F.count_if(~F.coalesce(test, F.lit(False))).alias(name) for name, test in rules.items()))
    return one.select(F.explode(F.create_map(*(x for name in rules for x in (F.lit(name), F.col(name))))).alias("rule", "violations"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def enriched(chunks: DataFrame, indexed_at: Column, text_col: str = "text") -> DataFrame:
    """``chunks`` with the time, and the characters, words and paragraphs of each text."""
    text = F.col(text_col)
    paragraphs = F.filter(F.split(text, "\n\n"), lambda p: T.stripped(p) != "")
    return chunks.withColumns({"indexed_at": indexed_at, "content_length": F.length(text), "word_count": F.size(T.words(text)), "paragraph_count": F.size(paragraphs)})
