"""From raw documents to training tokens: language ID, near-dedup, substring dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and returns a DataFrame that is written as Parquet and read back as the next
one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontaminate, langid, lexicon, simhash, substrings
from paperloom.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Posterior below which a document's language counts as unknown.
LEAST_SCORE = 0.5
#: SQL can't express these stages; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those without a letter, or with a posterior below ``LEAST_SCORE``, go.

    The model learns from the labelled rows that aren't held out.  Without any label nothing can be told, and all stay.
    """
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs.filter(~langid.held_out()).select("text", "lang"))
    if not model[0]:
        return docs
    found = langid.predict(docs, model)
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document of smallest id; rows that repeat its id once.  Rows without an id belong to no group and stay."""
    docs = docs.select(*COLUMNS)
    groups = simhash.near_groups(docs.filter("doc_id IS NOT NULL").select("doc_id", "text"))
    keep = materialize(groups.filter("doc_id = component_id").select("doc_id").distinct())
    first = docs.join(keep.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return first.select(*COLUMNS).unionByName(docs.filter("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte ranges that an earlier document has; a character cut in two goes whole.  A document of which nothing but space is left goes."""
    found = substrings.deduplicate(docs.select(*COLUMNS))
    cut = F.size("spans") > 0
    whole = F.col("kept").cast("string")
    found = found.withColumn("text", F.when(cut, F.replace(F.make_valid_utf8(whole), F.lit("�"), F.lit(""))).otherwise(whole))
    found = found.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.filter(~(cut & (F.trim("text") == ""))).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with passages of ``benchmark``.  Rows are told apart by id and text, so rows without an id are judged too."""
    docs = docs.select(*COLUMNS)
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("doc_id"), "text")
    judged = decontaminate.contamination(keyed, table(spark, sf_dir, "benchmark"))
    gone = materialize(judged.filter("contaminated").select(F.col("doc_id.doc_id").alias("gone_id"), F.col("doc_id.text_hash").alias("gone_hash")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash"))
    return docs.join(gone.hint("merge"), same, "left_anti").select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text, as the query of operator 6 gives them."""
    import public_tokenizers

    return lexicon.digests(lexicon.round_trip(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
