"""Preferred against rejected responses: one pass, one row of counts, effects from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import alternation


def flags(pairs: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """Per family: is a phrase in either response (c_, r_), and how often (co_, ro_)."""
    cols = []
    for name, phrases in families.items():
        pattern = alternation(phrases)
        for side, text in (("c", "chosen_text"), ("r", "rejected_text")):
            cols.append(F.regexp_count(F.lower(text), F.lit(pattern)).alias(f"{side}o_{name}"))
    return pairs.select("conv_id", "chosen_text", "rejected_text", *cols)


def contingency(pairs: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """behavior, n_pairs, chosen_any, rejected_any, chosen_only, rejected_only, both,
    chosen_occ, rejected_occ, chosen_words, rejected_words."""
    f = flags(pairs, families)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    aggs = [F.count(F.lit(1)).alias("n_pairs"), total(F.regexp_count("chosen_text", F.lit(r"\S+"))).alias("cw"), total(F.regexp_count("rejected_text", F.lit(r"\S+"))).alias("rw")]
    for name in families:
        c, r = F.col(f"co_{name}") > 0, F.col(f"ro_{name}") > 0
        one = lambda x: total(x.cast("int"))
        aggs += [
            F.struct(
                F.lit(name).alias("behavior"), one(c).alias("chosen_any"), one(r).alias("rejected_any"), one(c & ~r).alias("chosen_only"),
                one(~c & r).alias("rejected_only"), one(c & r).alias("both"), total(f"co_{name}").alias("chosen_occ"), total(f"ro_{name}").alias("rejected_occ"),
            ).alias(f"s_{name}")
        ]
    out = f.agg(*aggs)
    return out.select("n_pairs", F.col("cw").alias("chosen_words"), F.col("rw").alias("rejected_words"), F.explode(F.array(*[F.col(f"s_{n}") for n in families])).alias("s")).select(
        "s.*", "n_pairs", "chosen_words", "rejected_words"
    )


def effects(counts: DataFrame) -> DataFrame:
    rate = lambda occ, words: F.try_divide(1e6 * F.col(occ), F.col(words))
    return (
        counts.withColumn("paired_risk_difference", F.try_divide((F.col("chosen_any") - F.col("rejected_any")).cast("double"), F.col("n_pairs")))
        .withColumn("matched_odds_ratio_ha", (F.col("chosen_only") + 0.5) / (F.col("rejected_only") + 0.5))
        .withColumn("chosen_per_million_words", rate("chosen_occ", "chosen_words"))
        .withColumn("rejected_per_million_words", rate("rejected_occ", "rejected_words"))
        .withColumn("token_normalized_ratio", F.try_divide(F.col("chosen_per_million_words"), F.col("rejected_per_million_words")))
    )


def preference_counts(nested: DataFrame, phrases: list[str], chosen: Column, rejected: Column) -> DataFrame:
    """phrase, chosen, rejected, per-million of each and their ratio, over whole columns of JSON."""
    total = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    has = lambda c, p: F.contains(F.lower(c), F.lit(p))
    rows = nested.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.struct(F.lit(p).alias("phrase"), total(has(chosen, p)).alias("chosen"), total(has(rejected, p)).alias("rejected")).alias(f"p{i}") for i, p in enumerate(phrases)],
    ).select("n", F.explode(F.array(*[F.col(f"p{i}") for i in range(len(phrases))])).alias("p"))
    return rows.select(
        "p.*",
        F.try_divide(1e6 * F.col("p.chosen"), F.col("n")).alias("chosen_per_million"),
        F.try_divide(1e6 * F.col("p.rejected"), F.col("n")).alias("rejected_per_million"),
        F.try_divide(F.col("p.chosen").cast("double"), F.col("p.rejected")).alias("ratio"),
    )
