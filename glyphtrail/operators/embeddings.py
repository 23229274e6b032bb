"""Similarity of sentence vectors to exemplars. Vectors are of unit length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 6
SMALL_EXEMPLARS = 5_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def exemplar_table(exemplars: DataFrame, chunk: int = SMALL_EXEMPLARS) -> DataFrame:
    """Rows of at most some ``chunk`` exemplars, packed by category, to be met by every sentence. The number of
    exemplars is a property of the detector; many of them make several rows, not one large one."""
    n = exemplars.count()
    part = F.pmod(F.xxhash64("vec"), F.lit(max(1, -(-n // chunk))))
    packed = exemplars.groupBy(part.alias("part"), "category").agg(F.collect_list("vec").alias("vecs"))
    return packed.groupBy("part").agg(F.collect_list(F.struct("category", "vecs")).alias("exemplars")).select("exemplars")


def similarities(sentences: DataFrame, exemplars: DataFrame) -> DataFrame:
    """A row per sentence and category: sim, the highest similarity to its exemplars. The maximum is taken inside
    the sentence's row: only a number a category leaves it."""
    best = lambda c: F.array_max(F.transform(c["vecs"], lambda x: F.round(dot(F.col("vec"), x), DIGITS)))
    scored = sentences.crossJoin(F.broadcast(exemplar_table(exemplars))).withColumn(
        "e", F.explode(F.transform("exemplars", lambda c: F.struct(c["category"].alias("category"), best(c).alias("sim"))))
    )
    keys = [c for c in sentences.columns if c != "vec"]
    return scored.groupBy(*keys, "e.category").agg(F.max("e.sim").alias("sim"))


def max_similarity(sentences: DataFrame, exemplars: DataFrame, doc: str = "doc") -> DataFrame:
    return similarities(sentences, exemplars).groupBy(doc, "category").agg(F.max("sim").alias("max_sim"), F.count(F.lit(1)).alias("n_sentences"))


def hits_at(sims: DataFrame, threshold: float) -> DataFrame:
    return sims.groupBy("category").agg(F.count_if(F.col("sim") >= threshold).alias("n_hits"), F.count(F.lit(1)).alias("n_sentences"))
