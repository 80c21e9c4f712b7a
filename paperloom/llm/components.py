"""Connected components of a link table, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps: each moves a node's neighbours
    to its smallest one, so chains halve and the links end as stars.  Every step is
    written to the shared folder, and what joins is written before, so AQE can
    split a node that holds many links.  Raises if it hasn't settled after ``max_rounds``.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        # large star: from each node, its larger neighbours go to its lowest neighbour
        large = both.filter("b > a").join(lowest.hint("merge"), "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = materialize(large)
        # small star: a node's smaller neighbours and itself go to the lowest of them
        lowest = materialize(large.groupBy("a").agg(F.min("b").alias("low")))
        moved = large.join(lowest.hint("merge"), "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = materialize(moved.union(lowest.select("a", F.col("low").alias("b"))).distinct())
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == seen:
            roots = edges.select(F.col("b").alias("a"), "b").distinct()
            return edges.union(roots).select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
