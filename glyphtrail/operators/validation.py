"""Detectors against annotators: joins, label sets, agreement and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import statistics as S


def outcome(gold: Column, predicted: Column) -> dict[str, Column]:
    both = {"tp": gold & predicted, "fp": ~gold & predicted, "fn": gold & ~predicted, "tn": ~gold & ~predicted}
    return {k: F.coalesce(F.sum(v.cast("int")), F.lit(0)).alias(k) for k, v in both.items()}


def metrics(judged: DataFrame, by: list[str], zero_f1: bool = False) -> DataFrame:
    """by, tp, fp, fn, precision, recall, f1 from boolean columns gold and predicted."""
    counts = judged.groupBy(*by).agg(*outcome(F.col("gold"), F.col("predicted")).values())
    p, r, f = S.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"), zero_f1)
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f)


def macro(per_category: DataFrame) -> DataFrame:
    return per_category.agg(*[F.round(F.avg(c), 9).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def grouping_sets(judged: DataFrame, first: str, second: str) -> DataFrame:
    """Metrics overall, by one column and by the other, in one aggregation."""
    return judged.sparkSession.sql(
        f"""SELECT CASE grouping_id({first}, {second}) WHEN 3 THEN 'overall' WHEN 1 THEN '{first}' ELSE '{second}' END AS level,
        coalesce({first}, {second}) AS value, count_if(gold AND predicted) AS tp, count_if(NOT gold AND predicted) AS fp,
        count_if(gold AND NOT predicted) AS fn, count(*) AS n
        FROM {{judged}} GROUP BY GROUPING SETS ((), ({first}), ({second}))""",
        judged=judged,
    )


def kappa(rated: DataFrame, by: list[str]) -> DataFrame:
    """by, n, agree, kappa from boolean columns a and b."""
    a, b = F.col("a"), F.col("b")
    n = lambda c, name: F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(name)
    counts = rated.groupBy(*by).agg(n(a & b, "both"), n(a & ~b, "only_a"), n(~a & b, "only_b"), n(~a & ~b, "neither"), F.count(F.lit(1)).alias("n"))
    return counts.withColumn("agree", (F.col("both") + F.col("neither")).cast("long")).withColumn(
        "kappa", S.kappa(*[F.col(c) for c in ("both", "only_a", "only_b", "neither")])
    )


def coverage(expected: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """key, problem: ids that are missing, unexpected or repeated among ``given``."""
    missing = expected.select(key).join(given.select(key), key, "left_anti").withColumn("problem", F.lit("missing"))
    extra = given.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("problem", F.lit("unexpected"))
    twice = given.groupBy(key).count().filter("count > 1").select(key, F.lit("repeated").alias("problem"))
    return missing.unionByName(extra).unionByName(twice)


def adjudicated(items: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """The adjudicated label where there is one, else the first annotator's."""
    return items.join(decisions.select(key, F.col("label").alias("_d")), key, "left").withColumn("label", F.coalesce("_d", "label_1")).drop("_d")


def run_totals(runs: DataFrame, by: list[str], cost: str, duration: str) -> DataFrame:
    """Cost to six digits and duration of all runs; what a run does not report counts as nothing."""
    total = lambda c, kind: F.coalesce(F.sum(F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind))), F.lit(0).cast(kind))
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), F.round(total(cost, "double"), 6).alias("total_cost"), total(duration, "long").alias("total_duration"))


def pool(*groups: tuple[str, DataFrame]) -> DataFrame:
    """Tables of one schema under each other, with ``pool``, the name each was given."""
    named = [df.withColumn("pool", F.lit(name)) for name, df in groups]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df)
    return out


def gate(items: DataFrame, sheets: DataFrame, certificates: DataFrame, key: str, annotators: int = 2) -> DataFrame:
    """One row, status and reason: ``ready`` if ``annotators`` different certified people each labelled
    every item exactly once, else ``pending`` with the first thing that is missing. ``sheets``: annotator, key,
    annotator_type, label; ``certificates``: annotator, annotator_id, annotator_type, independent."""
    n_items = items.agg(F.count_distinct(key).alias("n_items"))
    labelled = sheets.join(items.select(key).distinct().withColumn("known", F.lit(True)), key, "left")
    per = labelled.groupBy("annotator").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("known"), F.col(key))).alias("n_known"),
        F.count_if(~F.col("annotator_type").eqNullSafe(F.lit("human"))).alias("n_other"),
        F.count_if(F.trim(F.coalesce("label", F.lit(""))) == "").alias("n_blank"),
    )
    sound = (F.col("annotator_type") == "human") & F.col("independent") & (F.col("annotator_id") != "")
    certified = certificates.groupBy("annotator").agg(F.max(F.when(sound, F.col("annotator_id"))).alias("who"))
    facts = per.join(certified, "annotator", "full").crossJoin(F.broadcast(n_items)).agg(
        F.count("n").alias("sheets"), F.count("who").alias("certified"), F.count_distinct("who").alias("people"),
        F.count_if((F.col("n") != F.col("n_items")) | (F.col("n_known") != F.col("n_items"))).alias("uneven"),
        F.coalesce(F.sum("n_other"), F.lit(0)).alias("other"), F.coalesce(F.sum("n_blank"), F.lit(0)).alias("blank"),
    )
    reason = (
        F.when(F.col("sheets") < annotators, "an annotation is missing")
        .when(F.col("certified") < annotators, "a certificate is missing or not valid")
        .when(F.col("people") < annotators, "the annotators are not different people")
        .when(F.col("uneven") > 0, "an annotation does not cover the items exactly")
        .when(F.col("other") > 0, "a row is not by a human")
        .when(F.col("blank") > 0, "a label is empty")
    )
    return facts.select(F.when(reason.isNull(), "ready").otherwise("pending").alias("status"), reason.alias("reason"))
