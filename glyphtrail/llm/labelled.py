"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Slices of a class, by the order of a hash, from which parts of a model are fitted.
SLICES = 10


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves remainder ``fold``; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, max_rows: int, seed: int) -> DataFrame:
    """draw, y, slice, text of at most ``max_rows`` labelled rows outside the held-out fold, the first
    by a hash of their id (``draw``, with the id behind it); ``slice`` deals each class evenly over ``SLICES``. Texts of
    any length are in it, whole. They stay on the executors, in the cluster's shared folder; an id with
    several texts gives its least one, a null text none."""
    ids = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .withColumn("draw", F.struct(F.xxhash64(F.lit(seed), "doc_id").alias("h"), F.col("doc_id").alias("id")))
        .orderBy("draw").limit(max_rows)
    )
    rows = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = cut(rows.groupBy("draw", "y").agg(F.min("text").alias("text")))
    # At most ``max_rows`` rows, without their texts.
    place = F.row_number().over(Window.partitionBy("y").orderBy("draw")) - 1
    dealt = rows.select("draw", "y").withColumn("slice", F.floor(place * SLICES / F.count(F.lit(1)).over(Window.partitionBy("y"))).cast("int"))
    return rows.select("draw", "text").join(F.broadcast(dealt), "draw").select("draw", "y", "slice", "text")


def slices(y) -> list[int]:
    """The same dealing for labels in order."""
    seen, out = {0: 0, 1: 0}, []
    total = {v: sum(1 for x in y if x == v) for v in (0, 1)}
    for v in y:
        out.append(seen[int(v)] * SLICES // total[int(v)])
        seen[int(v)] += 1
    return out
