"""Keyword search of a table of queries against a table of chunks.

Queries carry query_id and query; chunks carry chunk_id, file_name, chunk_index and text.  The shortest chunks that
hold a phrase or a term come from a stored gram index.  Where all pairs are asked for, candidates come from an equi join on
tokens, or on grams where a phrase has no whole token, and are verified on the pair; the queries' keys are
broadcast if the queries' text is small, so chunks aren't shuffled; beyond that, ids alone are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as T
from ..params import SEARCH, SearchParams
from ..storage import written
from . import grams

#: Characters of query text up to which the queries are broadcast; beyond it, joins are by sorting and merging.
BROADCAST_CHARS = 4 << 20


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def token_index(chunks: DataFrame) -> DataFrame:
    """(token, chunk_id): an inverted index, a row for each distinct token of a chunk."""
    return chunks.select("chunk_id", F.explode(tokens(F.col("text"))).alias("token"))


def stretches(text: Column, sizes=(1, 2, 3)) -> Column:
    """Distinct stretches of ``sizes`` characters of the lower-case text."""
    chars = F.split(F.lower(text), "")
    found = {1: chars}
    for n in range(2, max(sizes) + 1):
        found[n] = F.zip_with(found[n - 1], F.slice(chars, n, F.size(chars)), lambda a, b: F.concat(a, b))  # null past the end
    return F.array_compact(F.array_distinct(F.concat(*(found[n] for n in sizes))))


def inner_tokens(query: Column) -> Column:
    """Tokens with a border on both sides inside the query: whole tokens wherever it occurs."""
    return F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])"), F.lit(0)))


def strategy(queries: DataFrame) -> str:
    """The join hint for tables of ``queries``' keys, by the measured size of their text."""
    chars = queries.agg(F.sum(F.length("query") + 16)).first()[0] or 0
    return "broadcast" if chars <= BROADCAST_CHARS else "merge"


def meet(queries: DataFrame, chunks: DataFrame, asked: Column, held: Column, hint: str) -> DataFrame:
    """Pairs of a query and a chunk that hold the rarest key of the query; ``asked`` and ``held`` are the keys of each."""
    keys = queries.select("query_id", F.explode(asked).alias("_key"))
    index = chunks.select("chunk_id", F.explode(held).alias("_key"))
    counts = index.join(keys.select("_key").distinct().hint(hint), "_key", "left_semi").groupBy("_key").agg(F.count("*").alias("_n"))
    order = F.struct(F.coalesce("_n", F.lit(0)), "_key")
    rarest = keys.join(counts.hint(hint), "_key", "left").groupBy("query_id").agg(F.min_by("_key", order).alias("_key"))
    keyed = queries.join(rarest.hint(hint), "query_id")
    if hint == "broadcast":  # the text stays in its row until a key is met
        return chunks.withColumn("_key", F.explode(held)).join(keyed.hint("broadcast"), "_key").drop("_key")
    return keyed.hint("merge").join(index, "_key").drop("_key").hint("merge").join(chunks, "chunk_id")


def phrase_pairs(queries: DataFrame, chunks: DataFrame, mode: str = "token") -> DataFrame:
    """Pairs whose chunk holds the query's phrase; an empty phrase has none.

    ``token``: at token borders; pairs meet on the query's rarest token, the others are verified.
    ``substring``: anywhere in the text; pairs meet on the rarest token inside the phrase, or the rarest gram where it has none.
    """
    named, hint = chunks.filter("file_name IS NOT NULL"), strategy(queries)
    low_text, low_query = F.lower("text"), F.lower("query")
    if mode == "substring":
        whole = F.size(inner_tokens(F.col("query"))) > 0
        by_token = meet(queries.filter(whole), named, inner_tokens(F.col("query")), tokens(F.col("text")), hint)
        loose = queries.filter(~whole & (F.length("query") > 0))
        sizes = sorted(r[0] for r in loose.select(F.least(F.lit(3), F.length("query"))).distinct().collect())  # three values at most
        if not sizes:
            return by_token.filter(low_text.contains(low_query))
        short = F.filter(stretches(F.col("query"), sizes), lambda g: F.length(g) == F.least(F.lit(3), F.length("query")))
        return by_token.unionByName(meet(loose, named, short, stretches(F.col("text"), sizes), hint)).filter(low_text.contains(low_query))
    met = meet(queries, named, tokens(F.col("query")), tokens(F.col("text")), hint)
    return met.filter(F.regexp_like(low_text, F.concat(F.lit("(?<![a-z0-9])"), T.quoted(low_query), F.lit("(?![a-z0-9])"))))


def exact_search(queries: DataFrame, chunks: DataFrame, limit: int = 20, mode: str = "token", params: SearchParams = SEARCH, index: grams.GramIndex | None = None) -> DataFrame:
    """The ``limit`` shortest chunks with the phrase for each query, scored by its occurrences.

    Phrases of three characters or more are looked up in ``index``, which is built where none is given; each phrase once, whatever queries ask
    for it.  Shorter ones are joined by ``phrase_pairs``.
    """
    index = index or grams.build(chunks)
    asked = queries.withColumn("string", F.lower("query"))
    border = F.regexp_like("low", F.concat(F.lit("(?<![a-z0-9])"), T.quoted(F.col("string")), F.lit("(?![a-z0-9])")))
    long = asked.filter(F.length("string") >= grams.SIZE)
    if mode == "token":
        long = long.filter(F.size(tokens(F.col("query"))) > 0)
    hits = written(long.join(grams.shortest_holding(index, long, limit, border if mode == "token" else None).hint("merge"), "string"))
    found = index.chunks.join(hits.hint(small(hits)), "ord").drop("ord", "n_chars", "string")
    short = queries.filter(F.length(F.lower("query")) < grams.SIZE)
    if not short.isEmpty():
        order = Window.partitionBy("query_id").orderBy(F.length("text"), "file_name", "chunk_index", "chunk_id")
        pairs = phrase_pairs(short, chunks, mode).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
        found = found.unionByName(pairs)
    scored = found.withColumn("occurrences", T.occurrences(F.col("text"), F.col("query")))
    return scored.withColumn("score", exact_score(F.col("occurrences"), params)).withColumn("match_type", F.lit("exact_phrase"))


def small(rows: DataFrame) -> str:
    """The join hint for written rows of some numbers and short strings, by their count."""
    return "broadcast" if rows.count() <= grams.BROADCAST_PAIRS else "merge"


def exact_score(occurrences: Column, params: SearchParams = SEARCH) -> Column:
    return F.least(F.lit(params.exact_cap), params.base_score + params.per_occurrence * occurrences)


def terms_score(found: Column, terms: Column, occurrences: Column, params: SearchParams = SEARCH) -> Column:
    """By the share of terms found and their occurrences; 0.1 if none is found."""
    score = params.base_score * 0.8 + found / terms * 0.2 + F.least(F.lit(0.2), occurrences * 0.02)
    return F.when(found == 0, 0.1).otherwise(F.least(F.lit(params.base_score), score))


def terms_search(queries: DataFrame, chunks: DataFrame, limit: int = 20, exclude: DataFrame | None = None, params: SearchParams = SEARCH, index: grams.GramIndex | None = None) -> DataFrame:
    """The ``limit`` shortest chunks that contain any term of each query, anywhere in the text, without the pairs of ``exclude``; scored by the terms found.

    A query's shortest chunks are among the shortest of its terms, so each distinct term is looked up once in ``index`` for as many
    chunks as may be asked of it, and only those meet the query.  A term that a query repeats counts each time.
    """
    index = index or grams.build(chunks)
    asked = queries.withColumn("terms", Q.search_terms(F.col("query"))).filter(F.size("terms") > 0)
    by_term = asked.select("query_id", F.explode(F.array_distinct("terms")).alias("string"))
    gone = 0 if exclude is None else exclude.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    hits = grams.shortest_holding(index, by_term, limit + gone)
    met = written(by_term.join(hits.hint("merge"), "string").select("query_id", "ord").distinct())
    pairs = index.chunks.join(met.hint(small(met)), "ord")
    if exclude is not None:
        pairs = pairs.join(exclude.select("query_id", "chunk_id").hint("merge"), ["query_id", "chunk_id"], "left_anti")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("ord"))).filter(F.col("rank") <= limit)
    low = F.lower("text")
    rows = ranked.join(asked.select("query_id", "query", "terms").hint("merge"), "query_id").drop("ord", "n_chars")
    rows = rows.withColumn("found", F.size(F.filter("terms", lambda t: low.contains(t))))
    count = lambda t: ((F.length(low) - F.length(F.replace(low, t, F.lit("")))) / F.length(t)).cast("long")
    rows = rows.withColumn("occurrences", F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + count(t))).withColumn("n_terms", F.size("terms")).drop("terms")
    return rows.withColumn("score", terms_score(F.col("found"), F.col("n_terms"), F.col("occurrences"), params)).withColumn("match_type", F.lit("flexible_terms"))


def keyword_search(queries: DataFrame, chunks: DataFrame, top_k: int = 20, params: SearchParams = SEARCH, mode: str = "substring", index: grams.GramIndex | None = None) -> DataFrame:
    """The phrase first, anywhere in the text; terms make up what a query lacks to ``top_k``.  One index serves both."""
    columns = ["query_id", "chunk_id", "file_name", "chunk_index", "text", "score", "match_type", "occurrences"]
    index = index or grams.build(chunks)
    exact = written(exact_search(queries, chunks, top_k, mode, params, index).select(*columns))  # at most top_k rows a query
    held = exact.groupBy("query_id").agg(F.count("*").alias("held"))
    lacking = queries.join(held.hint("merge"), "query_id", "left").withColumn("held", F.coalesce("held", F.lit(0))).filter(F.col("held") < top_k)
    lacking = written(lacking)
    loose = terms_search(lacking.select("query_id", "query"), chunks, top_k, exact, params, index)
    loose = loose.join(lacking.select("query_id", "held").hint("merge"), "query_id").filter(F.col("rank") <= top_k - F.col("held"))
    return exact.unionByName(loose.select(*columns))


def expand_documents(matches: DataFrame, chunks: DataFrame, limit: int = SEARCH.full_document_chunks) -> DataFrame:
    """All chunks of each matched file in order, up to ``limit`` for each query, scored as exact."""
    files = matches.select("query_id", "file_name").distinct()
    order = Window.partitionBy("query_id").orderBy("file_name", F.coalesce("chunk_index", F.lit(0)), "chunk_id")
    rows = chunks.join(files.hint("merge"), "file_name").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return rows.withColumn("score", F.lit(SEARCH.exact_cap))


def false_substrings(chunks: DataFrame, inner: str, outer: str) -> DataFrame:
    """Chunks that hold ``outer`` but not ``inner`` as a word, though ``outer`` contains it."""
    return chunks.filter(F.lower("text").contains(outer) & ~T.word_match(F.lit(inner), F.col("text")))
