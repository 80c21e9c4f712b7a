"""Operator 5: benchmark decontamination by a distributed positional inverted index.

Only DataFrame functions.  Corpus frequencies of the benchmark's terms are
counted over all texts; each benchmark window is anchored at its two rarest
terms; postings of anchor terms are stored, those of a rarest term with the
words around it; the offset-adjusted lists are intersected, and what remains is
compared word by word (exact phrase) or by presence within a distance (proximity).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

WINDOW = 13
#: Bytes, as text, up to which a table made from the benchmark is broadcast; beyond, it is joined by sort-merge.
BROADCAST_BYTES = 32 << 20
#: Term of the posting that ends each document; no word is empty.
END_MARK = ""
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    """Words of a text, capitals kept; null text: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAPS), "")


def small(df: DataFrame) -> bool:
    """Whether a written table made from the benchmark may be broadcast, by the bytes it holds."""
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= BROADCAST_BYTES


def bounded(df: DataFrame) -> DataFrame:
    """A table made from the benchmark, written out, with the join strategy its measured size allows."""
    df = materialize(df)
    return F.broadcast(df) if small(df) else df.hint("merge")


def windows_of(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(wid, item_id, words): every run of ``window`` words of an item, or the whole item if it has fewer; none if it has no word."""
    items = benchmark.select(F.col(id_col).alias("item_id"), raw_words(F.col(text_col)).alias("raw")).filter(F.size("raw") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("raw") - window + 1))
    runs = items.withColumn("at", F.explode(starts)).select("item_id", F.slice("raw", F.col("at"), window).alias("raw"))
    return runs.select("item_id", F.transform("raw", ascii_lower).alias("words")).select(F.xxhash64("words").alias("wid"), "item_id", "words").distinct()


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, cf): occurrences of each of ``terms`` (a bounded table) in all texts; terms that don't occur are left out."""
    words = docs.select(F.explode(raw_words(F.col(text_col))).alias("raw")).select(ascii_lower(F.col("raw")).alias("term"))
    return words.join(terms, "term").groupBy("term").agg(F.count("*").alias("cf"))


def anchored(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(wid, words, term, offset, term2, offset2) of every window all of whose terms occur: its rarest term, and the next rarest place."""
    distinct = windows.select("wid", "words").dropDuplicates(["wid"])
    places = distinct.select("wid", F.posexplode("words").alias("offset", "term")).join(counts.hint("merge"), "term", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("cf", F.lit(0)).alias("cf"), F.col("offset").alias("offset"), F.col("term").alias("term"))))
    picked = places.groupBy("wid").agg(order.alias("o"))  # a window's words, so 13 rows at most
    first, second = F.col("o")[0], F.when(F.size("o") > 1, F.element_at("o", 2)).otherwise(F.col("o")[0])
    chosen = picked.filter(first["cf"] > 0).select(
        "wid", first["term"].alias("term"), first["offset"].alias("offset"), second["term"].alias("term2"), second["offset"].alias("offset2")
    )
    return distinct.join(chosen.hint("merge"), "wid")


def build_index(docs: DataFrame, anchors: DataFrame, reach: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings (row, doc_id, term, pos, near_at, near) of the anchors' terms.

    ``near`` holds the words within ``reach`` of a rarest term.  Every row has a
    posting of the end mark, at the number of its words.
    """
    first = anchors.select("term", F.lit(True).alias("rarest"))
    terms = first.union(anchors.select("term2", F.lit(False))).union(docs.sparkSession.sql(f"SELECT '{END_MARK}', false"))
    terms = materialize(terms.groupBy("term").agg(F.max("rarest").alias("rarest")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), raw_words(F.col(text_col)).alias("words"))
    places = F.posexplode(F.concat("words", F.array(F.lit(END_MARK)))).alias("pos", "raw")
    if small(terms):
        postings = rows.select("row", "doc_id", "words", places)
        postings = postings.withColumn("term", ascii_lower(F.col("raw"))).join(F.broadcast(terms), "term")
    else:
        # words are shuffled alone and meet their text again a row at a time, so no text travels once for each of its words
        rows = materialize(rows)
        found = rows.select("row", places).select("row", "pos", ascii_lower(F.col("raw")).alias("term")).join(terms.hint("merge"), "term")
        found = found.groupBy("row").agg(F.collect_list(F.struct("pos", "term", "rarest")).alias("found"))  # words of one text
        postings = rows.join(found.hint("merge"), "row").select("row", "doc_id", "words", F.inline("found"))
    near_at = F.greatest(F.lit(0), F.col("pos") - reach)
    near = F.when(F.col("rarest"), F.slice("words", near_at + 1, F.col("pos") - near_at + 1 + reach))
    return materialize(postings.select("row", "doc_id", "term", "pos", near_at.alias("near_at"), near.alias("near")))


def phrase_hits(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(row, wid, start, n): exact occurrences.  The lists of a window's two rarest terms, shifted by their offsets, are intersected, then all words compared."""
    lists = index.filter(F.col("near").isNotNull()).join(anchors, "term")
    lists = lists.withColumn("start", F.col("pos") - F.col("offset")).filter("start >= 0")
    others = index.select("row", F.col("term").alias("term2"), F.col("pos").alias("pos2"))
    both = lists.withColumn("pos2", F.col("start") + F.col("offset2")).join(others.hint("shuffle_hash"), ["row", "term2", "pos2"], "left_semi")
    there = F.transform(F.slice("near", F.col("start") - F.col("near_at") + 1, F.size("words")), ascii_lower)
    return both.filter(there == F.col("words")).select("row", "wid", "start", F.size("words").alias("n"))


def proximity_hits(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(row, wid, pos): places of a window's rarest term with all its other terms within the index's reach, in any order."""
    lists = index.filter(F.col("near").isNotNull()).join(anchors, "term")
    near = F.transform("near", ascii_lower)
    return lists.filter(F.size(F.array_except("words", near)) == 0).select("row", "wid", "pos").distinct()


def index_for(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows, anchors, index) of ``docs`` for ``benchmark``; ``slop`` widens the words kept around a rarest term."""
    windows = materialize(windows_of(benchmark, window))
    terms = bounded(windows.select(F.explode("words").alias("term")).distinct())
    counts = materialize(term_counts(docs, terms))
    anchors = bounded(anchored(windows, counts))
    return windows, anchors, build_index(docs, anchors, window - 1 + slop)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """One row for each of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words).

    Null and empty texts have no words; items without words have no window; an item without an id
    hits words but is not among the items; rows that
    repeat a doc_id, or have none, are judged each on its own.  Empty tables: no row, or no hit.  Other columns are left
    out, whatever their names.
    """
    windows, anchors, index = index_for(docs, benchmark, window)
    hits = materialize(phrase_hits(index, anchors).distinct())
    covered = hits.select("row", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct()
    n_hit = covered.groupBy("row").agg(F.count("*").alias("n_hit"))
    owners = bounded(windows.select("wid", F.col("item_id").cast("string").alias("item")))
    found = hits.select("row", "wid").distinct().join(owners, "wid").filter("item IS NOT NULL").select("row", "item").distinct()
    items = found.groupBy("row").agg(F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"), F.count("*").alias("n_items"))
    ends = index.filter(F.col("term") == END_MARK).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    judged = ends.join(materialize(n_hit).hint("merge"), "row", "left").join(materialize(items).hint("merge"), "row", "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return judged.select(
        "doc_id",
        "n_words",
        hit.cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hits AS (SELECT doc_id, i, l.n, win.item_id FROM p CROSS JOIN lens l JOIN win ON win.n = l.n AND array_to_string(w[i : i + l.n - 1], ' ') = win.s
         WHERE i + l.n - 1 <= len(w)),
cov AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""
