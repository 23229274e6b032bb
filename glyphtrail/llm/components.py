"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh


def components(edges: DataFrame, rows: int | None = None, max_rounds: int = 60) -> DataFrame:
    """node, label (the smallest node that it reaches) of each node in ``edges``
    (a, b), by alternating large-star and small-star steps: each round points every
    node at the smallest neighbour it knows, until nothing changes. Edges are written
    after each round; a hub's minimum is taken by partial aggregation, written, and its rows
    meet it by a join whose hot partitions can be split. ``rows``: the number of edges,
    if it is known."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct()
    e = fresh(cut(e, rows))
    mark = _mark(e)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), 2 * mark[0])
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(low.filter(F.col("m") < F.col("a")).select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        down = cut(large, 2 * mark[0])
        low = cut(down.groupBy("a").agg(F.min("b").alias("m")), 2 * mark[0])
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = fresh(cut(small.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 2 * mark[0]))
        was, mark = mark, _mark(e)
        if was == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = e.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return labels.unionByName(roots.join(labels.select("node"), "node", "left_anti"))


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
