"""Emission rates over the grid of models, stages, conditions, prompts and seeds.

Rates are two-level: mean over seeds for a prompt, mean over prompts for a condition. Sums of
flags and counts are kept as integers as long as possible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

CELL = ["model", "stage", "stage_ord", "condition"]


def emits(categories: Column, similarities: Column, category: Column, threshold: Column) -> Column:
    """By lexicon, or by embedding; a missing similarity counts as 0."""
    return F.array_contains(categories, category) | (F.coalesce(F.try_element_at(similarities, category), F.lit(0.0)) >= threshold)


def lexicon_flags(generations: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """``generations`` with a row per category: category, flag (0 or 1)."""
    low = F.col("_low")
    rows = F.array(*[F.struct(F.lit(c).alias("category"), T.any_of(low, ps).cast("int").alias("flag")) for c, ps in lexicon.items()])
    kept = [c for c in generations.columns if c != "text"]
    lowered = generations.select(*kept, F.lower("text").alias("_low"))
    return lowered.select(*kept, F.explode(rows).alias("_f")).select(*kept, "_f.*")


def prompt_rates(flags: DataFrame) -> DataFrame:
    return flags.groupBy(*CELL, "category", "prompt_idx").agg(F.sum("flag").alias("hits"), F.count(F.lit(1)).alias("seeds"))


def condition_rates(prompts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rate: mean over prompts of hits / seeds, to nine digits."""
    by = by or [*CELL, "category"]
    return prompts.groupBy(*by).agg(
        F.round(F.avg(F.col("hits").cast("double") / F.col("seeds")), 9).alias("rate"), F.count(F.lit(1)).alias("n_prompts"), F.sum("hits").alias("hits")
    )


def stage_gaps(rates: DataFrame, advice: str = "advice", control: str = "factual") -> DataFrame:
    """model, stage, category, gap: rate of advice minus rate of control."""
    side = lambda c: F.max(F.when(F.col("condition") == c, F.col("rate")))
    return (
        rates.groupBy("model", "stage", "stage_ord", "category").agg(side(advice).alias("advice_rate"), side(control).alias("control_rate"))
        .withColumn("gap", F.round(F.col("advice_rate") - F.col("control_rate"), 9))
    )


def stage_deltas(gaps: DataFrame) -> DataFrame:
    w = Window.partitionBy("model", "category").orderBy("stage_ord")
    return gaps.withColumn("delta", F.round(F.col("gap") - F.lag("gap").over(w), 9))


def difference_in_differences(gaps: DataFrame) -> DataFrame:
    """model, category, from_stage, to_stage, did: change of the gap between adjacent stages."""
    w = Window.partitionBy("model", "category").orderBy("stage_ord")
    return (
        gaps.withColumn("to_stage", F.lead("stage").over(w)).withColumn("did", F.round(F.lead("gap").over(w) - F.col("gap"), 9))
        .filter("to_stage is not null").select("model", "category", F.col("stage").alias("from_stage"), "to_stage", "did")
    )


def stage_pairs(stages: DataFrame) -> DataFrame:
    """Adjacent stages of each model, and its first with its last."""
    w = Window.partitionBy("model").orderBy("stage_ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = stages.select("model", F.col("stage").alias("from_stage"), F.lead("stage").over(w).alias("to_stage")).filter("to_stage is not null")
    ends = stages.select("model", F.first("stage").over(whole).alias("from_stage"), F.last("stage").over(whole).alias("to_stage")).distinct()
    return near.unionByName(ends).distinct()


def completeness(flags: DataFrame, prompts: int, min_seeds: int) -> DataFrame:
    """Cells of the grid that lack a prompt, or seeds of one."""
    have = flags.groupBy(*CELL, "prompt_idx").agg(F.count_distinct("seed").alias("seeds"))
    cells = flags.select(*CELL).distinct()
    grid = cells.withColumn("prompt_idx", F.explode(F.sequence(F.lit(0), F.lit(prompts - 1))))
    return (
        grid.join(have, [*CELL, "prompt_idx"], "left").withColumn("seeds", F.coalesce("seeds", F.lit(0)))
        .filter(F.col("seeds") < min_seeds)
    )


def generation_grid(models: DataFrame, stages: DataFrame, conditions: DataFrame) -> DataFrame:
    """Every model, stage, condition, prompt and seed: the seeds of a stage and condition
    are ``seeds``, one for the last condition."""
    return (
        models.crossJoin(F.broadcast(stages)).crossJoin(F.broadcast(conditions))
        .withColumn("prompt_idx", F.explode(F.sequence(F.lit(0), F.col("n_prompts") - 1)))
        .withColumn("seed", F.explode(F.sequence(F.lit(0), F.least("stage_seeds", "condition_seeds") - 1)))
    )
