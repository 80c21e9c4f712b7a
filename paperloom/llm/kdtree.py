"""Operator 2: exact top-k inner-product search with a KD-tree per shard.

Vectors are dealt by hash to shards; each shard is a KD-tree of median splits
with tight bounding boxes.  Queries travel in packed blocks.  A block first
searches one shard; the kth scores found there go along to all other shards and
prune whole subtrees before anything is multiplied.  A task reads a shard's tree once
and the blocks that search it after it, one by one.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Most rows of a shard (64 MB of 64 components), and the rows for which a further shard pays where there are idle tasks.
SHARD_ROWS, LEAST_ROWS = 262_144, 8_192
LEAF_ROWS = 256
#: Most nodes of one query that a round of the traversal opens.
ROUND_NODES = 64
QUERY_ROWS = 1_024
#: Stands for no row in lists of ids, and for their scores.  Scores beyond a long are cut to its range.
NONE = -(2**63)


def packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as found:
        return dict(found)


def build_tree(ids: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """Rows in leaf order, and for each node its rows [start, end), tight box, smallest id and first child (the second is next to it), or -1.

    Splits halve the widest side of the box at its median; a node's children come after it.
    """
    rows = np.argsort(ids, kind="stable")
    start, end, low, high, child = [0], [len(ids)], [], [], []
    node = 0
    while node < len(start):
        a, b = start[node], end[node]
        x = points[rows[a:b]]
        lo, hi = x.min(axis=0), x.max(axis=0)
        low.append(lo)
        high.append(hi)
        if b - a > leaf_rows:
            half = (b - a) // 2
            # a box without extent is cut by id, which its rows are ordered by
            if points.shape[1] and (hi != lo).any():
                parts = np.argpartition(x[:, int((hi - lo).argmax())], half)
                own = rows[a:b]
                rows[a:b] = np.concatenate([np.sort(own[parts[:half]]), np.sort(own[parts[half:]])])
            child.append(len(start))
            start += [a, a + half]
            end += [a + half, b]
        else:
            child.append(-1)
        node += 1
    first = np.array([ids[rows[a:b]].min() for a, b in zip(start, end, strict=True)])
    return {"ids": ids[rows], "points": points[rows], "start": np.array(start), "end": np.array(end), "low": np.array(low), "high": np.array(high), "child": np.array(child), "first": first}


def exact_type(d: int, a: np.ndarray, b: np.ndarray):
    """A type in which inner products of integer rows are exact."""
    top = max(1, d) * float(max(1, abs(a).max(initial=0))) * float(max(1, abs(b).max(initial=0)))
    return np.float32 if top < 2**24 else np.float64 if top < 2**53 else object


def as_kind(a: np.ndarray, kind) -> np.ndarray:
    if kind is object:
        return np.array([[int(v) for v in row] for row in a], object).reshape(a.shape)
    return a.astype(kind)


def search(tree: dict[str, np.ndarray], q_ids: np.ndarray, queries: np.ndarray, k: int, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Improve each query's best list (ids, scores: (queries, k), ordered, ``NONE`` for none) by the rows of ``tree``; and the number of products formed.

    Best first from the root: each query keeps a frontier of nodes; its nodes of the highest bound are opened, more of
    them each round, inner ones into their children, leaves into their rows; nodes that can't beat the kth score any more
    (or tie it with a smaller id) leave the frontier.  A row doesn't meet a query of its own id.
    """
    kind = exact_type(queries.shape[1], queries, tree["points"])
    q, x, low, high = (as_kind(a, kind) for a in (queries, tree["points"], tree["low"], tree["high"]))
    above, below = np.maximum(q, 0), np.minimum(q, 0)
    ids, scores, formed, step = ids.copy(), scores.copy(), 0, 1

    def bounds(who: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The most that any point of a node's box can score."""
        if kind is object:
            return (above[who] * high[nodes] + below[who] * low[nodes]).sum(axis=1)
        return np.einsum("ij,ij->i", above[who], high[nodes]) + np.einsum("ij,ij->i", below[who], low[nodes])

    who, nodes = np.arange(len(q)), np.zeros(len(q), np.int64)
    bound = bounds(who, nodes)
    while len(who):
        kth, kth_id = scores[who, -1], ids[who, -1]
        open_ = (kth_id == NONE) | (bound > kth) | ((bound == kth) & (tree["first"][nodes] < kth_id))
        who, nodes, bound = who[open_], nodes[open_], bound[open_]
        if not len(who):
            break
        by_bound = np.argsort(-bound, kind="stable")
        order = by_bound[np.argsort(who[by_bound], kind="stable")]
        who, nodes, bound = who[order], nodes[order], bound[order]
        new = np.flatnonzero(np.diff(who, prepend=-1))
        place = np.arange(len(who)) - np.repeat(new, np.diff(np.append(new, len(who))))
        now = place < step
        leaf = now & (tree["child"][nodes] < 0)
        inner = now & ~leaf
        if leaf.any():
            step = min(2 * step, ROUND_NODES)
            visit, asking = nodes[leaf], who[leaf]
            by_leaf = np.argsort(visit, kind="stable")
            visit, asking = visit[by_leaf], asking[by_leaf]
            head = np.flatnonzero(np.diff(visit, prepend=-1))
            for a, b in zip(head, np.append(head[1:], len(visit)), strict=True):
                rows, own = slice(tree["start"][visit[a]], tree["end"][visit[a]]), asking[a:b]
                found = q[own] @ x[rows].T
                formed += found.size
                found = np.clip(found, NONE + 1, -NONE - 1).astype(np.int64) if kind is object else found.astype(np.int64)
                names = np.broadcast_to(tree["ids"][rows], found.shape)
                ids[own], scores[own] = best_of(
                    np.concatenate([ids[own], np.where(names == q_ids[own][:, None], NONE, names)], axis=1),
                    np.concatenate([scores[own], found], axis=1),
                    k,
                )
        twice, children = np.repeat(who[inner], 2), np.repeat(tree["child"][nodes[inner]], 2) + np.tile([0, 1], int(inner.sum()))
        found = bounds(twice, children)
        who, nodes, bound = (np.concatenate([old[~now], more]) for old, more in ((who, twice), (nodes, children), (bound, found)))
    return ids, scores, formed


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row: highest score, then smallest id; entries without a row last."""
    scores = np.where(ids == NONE, NONE, scores)
    if scores.shape[1] > 4 * k:  # whatever ties the kth score stays in play
        place = scores.shape[1] - k
        kth = np.partition(scores, place, axis=1)[:, place : place + 1]
        width = max(k, int((scores >= kth).sum(axis=1).max()))
        pick = np.argsort(scores < kth, axis=1, kind="stable")[:, :width]
        ids, scores = np.take_along_axis(ids, pick, axis=1), np.take_along_axis(scores, pick, axis=1)
    order = np.lexsort((np.where(ids == NONE, -NONE - 1, ids), -np.maximum(scores, NONE + 1)), axis=1)[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and floor(64 x) rows; of rows with one id the smallest vector stays."""
    points = np.floor(64 * np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), -1))
    ids = pdf["vec_id"].to_numpy(np.int64)
    if len(np.unique(ids)) < len(ids):
        order = np.lexsort((*points.T[::-1], ids))
        order = order[np.flatnonzero(np.diff(ids[order], prepend=ids[order[0]] - 1))]
        ids, points = ids[order], points[order]
    # whole numbers either way
    return ids, points.astype(np.int32) if abs(points).max(initial=0) < 2**31 else np.clip(points, -1.7e308, 1.7e308)


def top_k(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows of highest integer inner product for each row where ``is_query`` holds.

    Vectors and ids that are null, and vectors with a null or non-finite component, take
    no part.  Ties go to the smaller id.  Of rows that repeat an id the
    smallest vector counts.  Vectors meet only those of their own length.  An empty table gives no row; other
    columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    good = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("is_query")
    ).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    good = good.withColumn("dim", F.size("v"))
    sizes = good.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q")).collect()  # a row for each vector length
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = {r.dim: max(-(-r.n // shard_rows), min(tasks, -(-r.n // LEAST_ROWS))) for r in sizes}
    n_shards = F.create_map(*(F.lit(x) for dim, n in shards.items() for x in (dim, n)))
    n_blocks = F.create_map(*(F.lit(x) for r in sizes for x in (r.dim, max(1, -(-r.q // QUERY_ROWS)))))
    dealt = F.xxhash64("vec_id")

    def shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, points = _matrix(pdf)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [packed(**build_tree(ids, points))]})

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, points = _matrix(pdf)
        none = np.full((len(ids), k), NONE, np.int64)
        state = packed(q_ids=ids, queries=points, ids=none, scores=none)
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "state": [state]})

    trees = good.withColumn("shard", F.pmod(dealt, n_shards[F.col("dim")]).cast("int")).groupBy("dim", "shard")
    trees = materialize(trees.applyInPandas(shard, "dim int, shard int, tree binary"))
    blocks = good.filter("is_query").withColumn("block", F.pmod(dealt, n_blocks[F.col("dim")]).cast("int")).groupBy("dim", "block")
    blocks = materialize(blocks.applyInPandas(block, "dim int, block int, state binary"))

    def searches(states: DataFrame, fn, schema: str) -> DataFrame:
        """Rows of ``fn(dim, block, state of the block, its new ids and scores)`` for each (dim, shard, block, state): a shard's tree, then its blocks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, tree = None, None
            for batch in batches:
                for i in range(batch.num_rows):
                    dim, shard_, block_, raw = (c[i].as_py() for c in batch.columns)
                    if block_ < 0:
                        key, tree = (dim, shard_), unpacked(raw)
                        continue
                    if key != (dim, shard_):
                        raise RuntimeError("a block came before its shard's tree")
                    s = unpacked(raw)
                    ids, scores, _ = search(tree, s["q_ids"], s["queries"], k, s["ids"], s["scores"])
                    yield fn(dim, block_, s, ids, scores)

        rows = trees.select("dim", "shard", F.lit(-1).alias("block"), F.col("tree").alias("raw")).unionByName(states.select("dim", "shard", "block", F.col("state").alias("raw")))
        return rows.repartition(tasks, "dim", "shard").sortWithinPartitions("dim", "shard", "block").mapInArrow(run, schema)

    def rows_of(q_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
        who = np.nonzero(which)[0]
        return pa.RecordBatch.from_arrays([pa.array(q_ids[who]), pa.array(ids[which]), pa.array(scores[which])], ["query_id", "vec_id", "score"])

    def improved(dim: int, block_: int, s: dict, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        state = packed(q_ids=s["q_ids"], queries=s["queries"], ids=ids, scores=scores)
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([block_], pa.int32()), pa.array([state])], ["dim", "block", "state"])

    def candidates(dim: int, block_: int, s: dict, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        # only what this shard adds: the home list is given once, below
        new = ~(ids[:, :, None] == s["ids"][:, None, :]).any(axis=2) & (ids != NONE)
        return rows_of(s["q_ids"], ids, scores, new)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("state"):
                s = unpacked(raw.as_py())
                yield rows_of(s["q_ids"], s["ids"], s["scores"], s["ids"] != NONE)

    home = F.pmod(F.col("block"), n_shards[F.col("dim")]).cast("int")
    began = materialize(searches(blocks.withColumn("shard", home), improved, "dim int, block int, state binary"))
    # a block is dealt to every other shard of its length: the stated query set against all rows, block by block
    others = began.withColumn("shard", F.explode(F.sequence(F.lit(0), n_shards[F.col("dim")].cast("int") - 1))).filter(F.col("shard") != home)
    schema = "query_id long, vec_id long, score long"
    found = searches(others, candidates, schema).union(began.select("state").mapInArrow(listed, schema))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_kdtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
