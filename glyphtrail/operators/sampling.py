"""Deterministic samples: order by the hash of a key instead of a random number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def random_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def per_stratum(df: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    w = Window.partitionBy(*strata).orderBy(random_key(F.col(key), seed), key)
    return df.withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= n)


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(random_key(F.col(key), seed), key).limit(n)


def first_per_group(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("_rn") <= n).drop("_rn")


def batches(df: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """``batch``: chunk of ``size`` rows within a group."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("batch", F.floor((rn - 1) / size).cast("int"))


def size_matched(clusters: DataFrame, cluster: str, flagged: str, target: int) -> DataFrame:
    """Clusters with the fewest flagged members first, larger ones before smaller, until
    they hold ``target`` unflagged members. One row per cluster, so the window sees clusters."""
    per = clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.sum(F.col(flagged).cast("int")).alias("flagged"))
    w = Window.orderBy("flagged", F.desc("size"), cluster).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("size") - F.col("flagged")).over(w), F.lit(0))
    return (
        per.withColumn("before", before).filter(F.col("before") < target)
        .withColumn("taken", F.least(F.col("size") - F.col("flagged"), F.lit(target) - F.col("before")))
    )


def kmeans_labels(vectors: DataFrame, vec: str, k: int = 20, seed: int = 0) -> DataFrame:
    """``vectors`` with ``cluster``, by distributed k-means; fewer rows than ``k`` give fewer clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = vectors.withColumn("_features", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster", maxIter=30).fit(ready)
    return model.transform(ready).drop("_features")
