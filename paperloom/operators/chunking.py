"""Chunkers and chunk rows.  All work is inside a row, so no order over rows is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..params import CHUNK, ChunkParams


def word_windows(docs: DataFrame, params: ChunkParams = CHUNK, text_col: str = "text") -> DataFrame:
    """A row for each window of ``size`` words, each starting ``size - overlap`` after the one before; empty texts have none.

    Adds chunk_index, total_chunks and chunk_text; the other columns are copied.
    """
    step = params.size - params.overlap
    n = F.size("_words")
    count = F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((n - params.overlap) / step))).cast("int")
    rows = docs.withColumn("_words", T.words(F.col(text_col))).withColumn("total_chunks", count).filter("total_chunks > 0")
    rows = rows.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)))
    chunk = F.array_join(F.slice("_words", F.col("chunk_index") * step + 1, params.size), " ")
    return rows.withColumn("chunk_text", chunk).drop("_words")


def sentences(text: Column) -> Column:
    """Sentences, paragraph by paragraph, with their end marks."""
    marked = F.regexp_replace(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), r"\n\n+", "\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def packed_sentences(docs: DataFrame, params: ChunkParams = CHUNK, text_col: str = "text") -> DataFrame:
    """Greedy packing: a chunk takes sentences while it holds at most ``size`` words; the next one starts with the last sentences of up to ``overlap`` words.

    A sentence of more words is a chunk to itself.  The fold runs inside each row.
    """
    state = "struct<done:array<array<struct<s:string,n:int>>>,open:array<struct<s:string,n:int>>,n:int>"
    empty = F.from_json(F.lit('{"done":[],"open":[],"n":0}'), state)
    counted = F.transform(sentences(F.col(text_col)), lambda s: F.struct(s.alias("s"), F.size(F.split(s, r"\s+")).alias("n")))  # words are counted once a sentence
    total = lambda ss: F.aggregate(ss, F.lit(0), lambda a, x: a + x["n"])

    def tail(open_: Column) -> Column:
        """The last sentences that fit the overlap."""
        start = F.from_json(F.lit('{"kept":[],"n":0,"full":false}'), "struct<kept:array<struct<s:string,n:int>>,n:int,full:boolean>")

        def back(acc: Column, x: Column) -> Column:
            fits = ~acc["full"] & (acc["n"] + x["n"] <= params.overlap)
            return F.struct(
                F.when(fits, F.concat(F.array(x), acc["kept"])).otherwise(acc["kept"]).alias("kept"),
                F.when(fits, acc["n"] + x["n"]).otherwise(acc["n"]).alias("n"),
                (~fits).alias("full"),
            )

        return F.aggregate(F.reverse(open_), start, back, lambda a: a["kept"])

    def take(acc: Column, x: Column) -> Column:
        over = (F.size(acc["open"]) > 0) & (acc["n"] + x["n"] > params.size)
        none = F.slice(acc["open"], 1, 0)
        rest = T.bind(tail(acc["open"]), lambda kept: F.when(total(kept) + x["n"] > params.size, none).otherwise(kept))
        closed = T.bind(rest, lambda r: F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), F.concat(r, F.array(x)).alias("open"), (total(r) + x["n"]).alias("n")))
        grown = F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(x)).alias("open"), (acc["n"] + x["n"]).alias("n"))
        return F.when(over, closed).otherwise(grown)

    end = lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
    rows = docs.withColumn("_chunks", F.aggregate(counted, empty, take, end))
    # outer: of a plain one Spark infers a filter on the array, which would have each text packed again
    rows = rows.select("*", F.size("_chunks").alias("total_chunks"), F.posexplode_outer("_chunks").alias("chunk_index", "_sentences")).filter("chunk_index IS NOT NULL")
    return rows.withColumn("chunk_text", F.array_join(F.transform("_sentences", lambda x: x["s"]), " ")).drop("_chunks", "_sentences")


def markdown_blocks(text: Column) -> Column:
    """Blocks between blank lines as structs (kind, text): heading, list, table or text."""
    block = lambda b: F.struct(
        F.when(F.regexp_like(b, F.lit(r"^#{1,6} ")), "heading").when(F.regexp_like(b, F.lit(r"^\s*([-*]|\d+\.) ")), "list").when(F.regexp_like(b, F.lit(r"^\|")), "table").otherwise("text").alias("kind"),
        b.alias("text"),
    )
    return F.transform(F.filter(F.transform(F.split(text, r"\n\n+"), lambda s: F.trim(s)), lambda b: b != ""), block)


def structure_chunks(docs: DataFrame, max_words: int = CHUNK.size, text_col: str = "text") -> DataFrame:
    """Blocks under one heading packed together up to ``max_words``, each chunk with its heading, type and text.

    chunk_type: table before list before mixed (over two kinds) before text.
    """
    state = "struct<done:array<struct<heading:string,kinds:array<string>,texts:array<string>,n:int>>,heading:string>"
    empty = F.from_json(F.lit('{"done":[],"heading":""}'), state)

    def take(acc: Column, b: Column) -> Column:
        n = F.size(T.words(b["text"]))
        last = F.get(acc["done"], F.size(acc["done"]) - 1)
        fresh = F.struct(acc["heading"].alias("heading"), F.array(b["kind"]).alias("kinds"), F.array(b["text"]).alias("texts"), n.alias("n"))
        joins = (F.size(acc["done"]) > 0) & (last["heading"] == acc["heading"]) & (last["n"] + n <= max_words)
        grown = F.struct(last["heading"].alias("heading"), F.concat(last["kinds"], F.array(b["kind"])).alias("kinds"), F.concat(last["texts"], F.array(b["text"])).alias("texts"), (last["n"] + n).alias("n"))
        is_heading = b["kind"] == "heading"
        done = F.when(is_heading, acc["done"]).when(joins, F.concat(F.slice(acc["done"], 1, F.greatest(F.lit(0), F.size(acc["done"]) - 1)), F.array(grown))).otherwise(F.concat(acc["done"], F.array(fresh)))
        return F.struct(done.alias("done"), F.when(is_heading, F.regexp_replace(b["text"], "^#+ ", "")).otherwise(acc["heading"]).alias("heading"))

    rows = docs.withColumn("_chunks", F.aggregate(markdown_blocks(F.col(text_col)), empty, take, lambda a: a["done"]))
    # outer: of a plain one Spark infers a filter on the array, which would have each text packed again
    rows = rows.select("*", F.size("_chunks").alias("total_chunks"), F.posexplode_outer("_chunks").alias("chunk_index", "_c")).filter("chunk_index IS NOT NULL").drop("_chunks")
    body = F.array_join(F.col("_c.texts"), "\n\n")
    return rows.select(
        "*",
        F.nullif(F.col("_c.heading"), F.lit("")).alias("parent_heading"),
        chunk_type(F.col("_c.kinds")).alias("chunk_type"),
        F.when(F.col("_c.heading") != "", F.concat(F.col("_c.heading"), F.lit("\n"), body)).otherwise(body).alias("chunk_text"),
    ).drop("_c")


def chunk_type(kinds: Column) -> Column:
    return F.when(F.array_contains(kinds, "table"), "table").when(F.array_contains(kinds, "list"), "list").when(F.size(F.array_distinct(kinds)) > 2, "mixed").otherwise("text")


def with_fallback(docs: DataFrame, chunks: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``chunks``, and window chunks of the documents that have none there."""
    missing = docs.join(chunks.select(key).distinct().hint("merge"), key, "left_anti")
    return chunks.unionByName(word_windows(missing, text_col=text_col), allowMissingColumns=True)


def paragraphs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    rows = docs.withColumn("_p", F.filter(F.split(F.col(text_col), "\n\n"), lambda p: F.trim(p) != ""))
    return rows.select("*", F.posexplode("_p").alias("paragraph_index", "paragraph")).drop("_p")


def html_to_markdown(html: Column) -> Column:
    """Headings, list items, links and paragraphs of a page as markdown; scripts, styles, comments and other tags go."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", "")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", "\n\n" + "#" * level + " $1\n\n")
    out = F.regexp_replace(out, r'(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', "[$2]($1)")
    out = F.regexp_replace(out, r"(?is)<li[^>]*>(.*?)</li>", "\n- $1")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|tr|ul|ol|table)>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n\s*\n+", "\n\n"))


def convert_pages(pages: DataFrame, min_chars: int = 10) -> DataFrame:
    """page_id, url, markdown, metrics, quality and verdict of every raw page."""
    rows = pages.select("page_id", "url", F.length("html").alias("original_size"), html_to_markdown(F.coalesce("html", F.lit(""))).alias("markdown"))
    return rows.select("*", T.metrics(F.col("markdown")).alias("m"), T.quality_score(F.col("markdown")).alias("quality"), F.when(F.length("markdown") < min_chars, "rejected").otherwise("converted").alias("verdict"))


def choose_ocr(results: DataFrame, fallback_below: float = 0.5, primary: str = "primary") -> DataFrame:
    """Text for each image from several engines' (doc_id, image, engine, text, confidence): the primary engine's, or below the threshold the most confident."""
    best = F.max_by("text", F.struct("confidence", F.col("engine") == primary, "engine"))
    own = F.max_by("text", F.when(F.col("engine") == primary, F.col("confidence")))
    sure = F.max(F.when(F.col("engine") == primary, F.col("confidence"))) >= fallback_below
    return results.groupBy("doc_id", "image").agg(F.when(F.coalesce(sure, F.lit(False)), own).otherwise(best).alias("text"))
