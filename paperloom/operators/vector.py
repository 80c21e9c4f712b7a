"""Vector search: exact and approximate cosine top-k, checks, and the embedding hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind
from ..storage import written

#: Bytes of a shard of vectors, of a block of queries, and of all blocks up to which these are broadcast.
SHARD_BYTES, BLOCK_BYTES, BROADCAST_BYTES = 4 << 20, 1 << 20, 64 << 20
#: Bytes of shards or blocks in a file, which a task decodes at once: hashed vectors are mostly zeros, so they take many times less on disk than in memory.
FILE_BYTES = 16 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    scaled = lambda u, n: F.when(n > 0, F.transform(u, lambda x: x / n)).otherwise(F.transform(u, lambda x: x.cast("double")))
    return bind(v, lambda u: bind(F.sqrt(dot(u, u)), lambda n: scaled(u, n)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def dimension_census(vectors: DataFrame, expected: int, vector_col: str = "vec") -> DataFrame:
    """Vectors by length with their share; null vectors have a row of their own."""
    counts = vectors.groupBy(F.size(F.col(vector_col)).alias("dim")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(F.when(F.col("dim") >= 0, F.col("dim")).alias("dim"), "n", F.round(100 * F.col("n") / total, 6).alias("percent"), F.coalesce(F.col("dim") == expected, F.lit(False)).alias("expected"))


_BLOCK = "block long, dim int, ids binary, data binary"


def finite(v: Column) -> Column:
    """Whether a vector is there, has components, and none of them is null or not finite."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def packed(rows: DataFrame, id_col: str, limit: int) -> DataFrame:
    """Blocks (block, dim, ids, data) of vectors of one length, scaled to length 1, of at most ``limit`` bytes each; unfit vectors are left out.

    Written, so that a block keeps its number whatever task reads it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().astype(np.float64)
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                step = max(1, limit // max(8, 8 * dim))
                for at in range(0, len(own), step):
                    part = own[at : at + step]
                    data = _unit(flat[starts[part][:, None] + np.arange(dim)])
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (task + made, np.int32(dim), ids[part].astype("<i8").tobytes(), data.tobytes())], ["block", "dim", "ids", "data"])
                    made += 1

    fit = rows.filter(finite(F.col("vec"))).select(F.col(id_col).cast("long"), F.col("vec").cast("array<double>"))
    return written(fit.mapInArrow(run, _BLOCK), rows_a_file=max(1, FILE_BYTES // limit))


def sharded(chunks: DataFrame) -> DataFrame:
    """``chunks`` (id, vec) as the shards that ``exact_top_k`` reads, written once for any number of searches."""
    return packed(chunks, "id", SHARD_BYTES).withColumnsRenamed({"ids": "c_ids", "data": "c_data", "block": "shard"})


def exact_top_k(queries: DataFrame, chunks: DataFrame | None, k: int = 20, threshold: float | None = None, shards: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, rank: the ``k`` vectors of highest cosine for each query; ties to the smaller id.

    Blocks of queries meet shards of vectors, both bounded in bytes, as rows of a join; each pair gives its k best a query.  Blocks of up to
    ``BROADCAST_BYTES`` in all are broadcast to where the shards lie; beyond it a copy of each goes to each shard.  Any number of queries, of any
    lengths, is answered; a query meets the vectors of its own length.  Null vectors and null or non-finite components take no part.
    ``shards``, made by ``sharded``, stand for ``chunks`` where they are given.
    """
    shards = sharded(chunks) if shards is None else shards
    blocks = packed(queries, "query_id", BLOCK_BYTES).withColumnsRenamed({"ids": "q_ids", "data": "q_data"}).drop("block")
    if (blocks.agg(F.sum(F.octet_length("q_data"))).first()[0] or 0) <= BROADCAST_BYTES:
        pairs = shards.join(blocks.hint("broadcast"), "dim")
    else:
        places = shards.groupBy("dim").agg(F.collect_list("shard").alias("shards"))  # 8 bytes a shard
        dealt = blocks.join(places.hint("merge"), "dim").withColumn("shard", F.explode("shards")).drop("shards")
        pairs = dealt.join(shards.hint("merge"), ["dim", "shard"])  # a merge join holds the rows of a key of its right side: one shard

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                q_ids, c_ids = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i8") for c in (1, 3))
                q, c = (np.frombuffer(batch.column(c)[i].as_buffer()).reshape(-1, dim) for c in (2, 4))
                step = max(1, (1 << 21) // max(1, len(c)))
                for at in range(0, len(q), step):
                    row, column, score = best_of(np.round(q[at : at + step] @ c.T, 12), c_ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[at : at + step][row]), pa.array(c_ids[column]), pa.array(score)], ["query_id", "id", "score"])

    found = pairs.select("dim", "q_ids", "q_data", "c_ids", "c_data").mapInArrow(search, "query_id long, id long, score double")
    if threshold is not None:
        found = found.filter(F.col("score") >= threshold)
    return ranked(found, k)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the ``k`` highest scores of each row; ties to the smaller id."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, column = np.nonzero(scores >= least[:, None])  # ties with the last one too
    else:
        row, column = (x.ravel() for x in np.indices(scores.shape))
    value = scores[row, column]
    order = np.lexsort((ids[column], -value, row))
    row, column, value = row[order], column[order], value[order]
    first = np.searchsorted(row, np.arange(scores.shape[0]))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], column[keep], value[keep]


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class CodedIndex(NamedTuple):
    """``shards`` (cell, ids, codes) of product-quantised vectors, written; the cells' centres and each part's code book."""

    shards: DataFrame
    centres: np.ndarray
    books: np.ndarray


def _means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres of k-means; fewer where there are fewer points."""
    centres = points[rng.permutation(len(points))[:k]]
    for _ in range(rounds):
        near = _nearest(points, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((points[a : a + 4096] @ centres.T - half).argmax(axis=1) for a in range(0, len(points), 4096))])


def coded_index(chunks: DataFrame, dim: int, cells: int = 16, part: int = 4, sample: int = 20_000, seed: int = 7) -> CodedIndex:
    """Code every vector of length ``dim``: its cell, and for each ``part`` components the nearest of 256 entries of that part's book, a byte.

    Cells and books are fitted on at most about ``sample`` rows; every fit vector is coded.  Shards hold at most ``SHARD_BYTES`` of codes of one cell.
    """
    rows = chunks.filter(finite(F.col("vec")) & (F.size("vec") == dim)).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    n, rng = rows.count(), np.random.default_rng(seed)
    taken = rows.select("vec").sample(min(1.0, sample / max(1, n)), seed).limit(2 * sample).toArrow().column("vec").combine_chunks()
    points = _unit(taken.flatten().to_numpy().reshape(-1, dim))
    cuts = list(range(0, dim, part))
    if not len(points):
        points = np.zeros((1, dim))
    centres = _unit(_means(points, cells, rng))
    books = np.zeros((len(cuts), 256, part))
    for m, at in enumerate(cuts):
        book = _means(points[:, at : at + part], 256, rng)
        books[m, : len(book), : book.shape[1]] = book
        books[m, len(book) :] = np.inf  # never nearest
    shared = chunks.sparkSession.sparkContext.broadcast((centres, books))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = shared.value
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _unit(batch.column(1).flatten().to_numpy().reshape(-1, dim))
            cell = (x @ centres.T).argmax(axis=1) if len(x) else np.zeros(0, np.int64)
            codes = np.zeros((len(x), len(cuts)), np.uint8)
            for m, at in enumerate(cuts):
                book = books[m][np.isfinite(books[m]).all(axis=1)]
                codes[:, m] = _nearest(x[:, at : at + part], book[:, : x[:, at : at + part].shape[1]])
            for c in np.unique(cell).tolist():
                own = np.flatnonzero(cell == c)
                for at in range(0, len(own), SHARD_BYTES // len(cuts)):
                    part_ = own[at : at + SHARD_BYTES // len(cuts)]
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (np.int32(c), ids[part_].astype("<i8").tobytes(), codes[part_].tobytes())], ["cell", "ids", "codes"])

    return CodedIndex(written(rows.mapInArrow(code, "cell int, ids binary, codes binary"), rows_a_file=max(1, FILE_BYTES // SHARD_BYTES)), centres, books)


def probe_top_k(queries: DataFrame, chunks: DataFrame, k: int = 20, cells: int = 16, probes: int = 14, rerank: int | None = None, index: CodedIndex | None = None) -> DataFrame:
    """Approximate top-k: codes of the ``probes`` nearest cells of each query are summed from its tables of inner products, and the ``rerank`` best (10 k where none is given) are scored exactly.

    Queries of the index's length are answered; they meet the shards of a cell by equality, as rows, so any number may be asked.
    """
    if index is None:
        dim = chunks.filter(finite(F.col("vec"))).groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        index = coded_index(chunks, dim.d if dim else 1, cells)
    deep = rerank or 10 * k
    parts, part = index.books.shape[0], index.books.shape[2]
    dim = index.centres.shape[1]
    shared = chunks.sparkSession.sparkContext.broadcast((index.centres, index.books))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = shared.value
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _unit(batch.column(1).flatten().to_numpy().reshape(-1, dim))
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
            for c in np.unique(near).tolist():
                own = np.flatnonzero((near == c).any(axis=1))
                for at in range(0, len(own), 256):
                    some = own[at : at + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (np.int32(c), ids[some].astype("<i8").tobytes(), x[some].tobytes())], ["cell", "q_ids", "q_data"])

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = np.where(np.isfinite(shared.value[1]), shared.value[1], 0)
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, c_ids = (np.frombuffer(batch.column(c)[i].as_buffer(), "<i8") for c in (0, 2))
                x = np.frombuffer(batch.column(1)[i].as_buffer()).reshape(-1, dim)
                codes = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint8).reshape(-1, parts)
                padded = np.zeros((len(x), parts * part))
                padded[:, :dim] = x
                tables = np.einsum("qmd,mkd->mqk", padded.reshape(len(x), parts, part), books).astype(np.float32)
                for at in range(0, len(codes), 8192):
                    own = codes[at : at + 8192]
                    sums = np.zeros((len(x), len(own)), np.float32)
                    for m in range(parts):
                        sums += tables[m][:, own[:, m]]
                    row, column, score = best_of(sums, c_ids[at : at + 8192], deep)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(c_ids[at : at + 8192][column]), pa.array(score.astype(np.float64))], ["query_id", "id", "score"])

    asked = queries.filter(finite(F.col("vec")) & (F.size("vec") == dim)).select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"))
    blocks = written(asked.mapInArrow(ask, "cell int, q_ids binary, q_data binary"))
    size = blocks.agg(F.sum(F.octet_length("q_data"))).first()[0] or 0
    pairs = index.shards.join(blocks.hint("broadcast" if size <= BROADCAST_BYTES else "merge"), "cell").select("q_ids", "q_data", "ids", "codes")
    likely = written(ranked(pairs.mapInArrow(estimate, "query_id long, id long, score double"), deep).select("query_id", "id"))
    # exact scores of the likely rows alone
    near = likely.join(chunks.select("id", F.col("vec").alias("c_vec")).hint("merge"), "id").join(asked.hint("merge"), "query_id")
    return ranked(near.select("query_id", "id", F.round(cosine(F.col("vec"), F.col("c_vec")), 12).alias("score")), k)


def variant_search(variants: DataFrame, chunks: DataFrame, top_k: int = 20, max_variants: int = 2) -> DataFrame:
    """Search of up to ``max_variants`` (query_id, variant, vec) a query, each with its share of ``top_k`` and two more."""
    used = variants.filter(F.col("variant") < max_variants)
    keyed = used.select((F.col("query_id") * max_variants + F.col("variant")).alias("query_id"), "vec")
    counts = used.groupBy("query_id").agg(F.count("*").alias("n"))
    found = exact_top_k(keyed, chunks, top_k + 2)
    found = found.select(F.floor(F.col("query_id") / max_variants).alias("query_id"), F.pmod("query_id", F.lit(max_variants)).alias("variant"), "id", "score", "rank")
    return found.join(counts.hint("merge"), "query_id").filter(F.col("rank") <= F.floor(F.lit(top_k) / F.col("n")) + 2).drop("n")


def band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").when(score >= 0.4, "low").otherwise("poor")


def answer_confidence(found: DataFrame, top: int = 5) -> DataFrame:
    return found.filter(F.col("rank") <= top).groupBy("query_id").agg(F.round(F.avg("score"), 6).alias("confidence"))


def fit_for_index(vectors: DataFrame, dim: int, vector_col: str = "vec") -> tuple[DataFrame, DataFrame]:
    """(rows fit for an index, others with their reason): no vector, another dimension, or a component that is null or not finite."""
    v = F.col(vector_col)
    reason = F.when(v.isNull(), "null_vector").when(F.size(v) != dim, "wrong_dimension").when(~finite(v), "not_finite")
    marked = vectors.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def result_rows(found: DataFrame, chunks: DataFrame, preview: int = 200) -> DataFrame:
    """Hits as result rows: ids as text, preview, and chunk index 0 where there is none."""
    text = F.coalesce("text", F.lit(""))
    shown = F.when(F.length(text) > preview, F.concat(F.substring(text, 1, preview), F.lit("..."))).otherwise(text)
    own = chunks.select("id", shown.alias("preview"), F.coalesce(F.col("chunk_index").cast("int"), F.lit(0)).alias("chunk_index"))
    return found.join(own.hint("merge"), "id", "left").select("query_id", F.col("id").cast("string").alias("id"), "preview", F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), "score", "rank")


def signed_counts(places: pa.Array, dim: int) -> pa.Array:
    """From lists of places below 2 ``dim`` to lists of ``dim`` counts, those from ``dim`` on taken off, scaled to length 1; a null list gives nulls."""
    values, empty, step = [], [], max(1, (1 << 20) // dim)
    for at in range(0, len(places), step):
        part = places.slice(at, step)
        sizes = pc.list_value_length(part).fill_null(0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(part)), sizes)
        counts = np.bincount(row * 2 * dim + part.flatten().to_numpy(zero_copy_only=False), minlength=2 * dim * len(part)).reshape(-1, 2 * dim)
        values.append(_unit((counts[:, :dim] - counts[:, dim:]).astype(np.float64)).ravel())
        empty.append(np.repeat(part.is_null().to_numpy(zero_copy_only=False), dim))
    flat = pa.array(np.concatenate(values), mask=np.concatenate(empty)) if values else pa.array([], pa.float64())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1) * dim, pa.int32()), flat)


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic embedding without a model: signed counts of hashed words, scaled to length 1.

    Words are hashed by built-ins; counting them for each component there would read all words once a component, so Arrow batches do it in one pass.
    """
    tokens = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")
    places = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(2 * dim)))  # a component and a sign

    @F.arrow_udf("array<double>")
    def counted(batch: pa.Array) -> pa.Array:
        return signed_counts(batch, dim)

    return counted.asNondeterministic()(places)  # or a filter on the vector would have it computed again


def embed(rows: DataFrame, text_col: str, embedder: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None, dim: int = 64) -> DataFrame:
    """``rows`` with a vec column.  ``embedder`` is called once a task and gives a function from texts to vectors; without it the hashed embedding is used."""
    if embedder is None:
        return rows.withColumn("vec", hashed_embedding(F.col(text_col), dim))
    schema = rows.select("*", F.array(F.lit(0.0).cast("float")).alias("vec")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = embedder()
        for batch in batches:
            yield batch.assign(vec=model(batch[text_col].tolist()))

    return rows.mapInPandas(run, schema)
