"""Base tables and the views that are derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Turns of one response are joined by these two characters, a backslash and an n.
TURN_SEPARATOR = "\\n"
STAGES = ["base", "sft", "dpo", "rlvr", "instruct"]
CONDITIONS = {"en": "advice", "de": "factual", "es": "emotional", "fr": "neutral_advice"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations_nested(turns: DataFrame) -> DataFrame:
    """conv_id, messages: the turns of a conversation as (content, role), in order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(
        F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages")
    )


def preference_pairs(turns: DataFrame, separator: str = TURN_SEPARATOR) -> DataFrame:
    """conv_id, chosen_text, rejected_text: odd and even assistant turns of a conversation
    that has both, joined in order."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = turns.filter("role = 'assistant'").withColumn("rn", F.row_number().over(w))
    side = lambda odd: F.array_sort(F.collect_list(F.when(F.col("rn") % 2 == odd, F.struct("rn", "text"))))
    return (
        own.groupBy("conv_id").agg(side(1).alias("c"), side(0).alias("r"))
        .filter((F.size("c") > 0) & (F.size("r") > 0))
        .select(
            "conv_id",
            F.array_join(F.transform("c", lambda m: m["text"]), separator).alias("chosen_text"),
            F.array_join(F.transform("r", lambda m: m["text"]), separator).alias("rejected_text"),
        )
    )


def generations(docs: DataFrame) -> DataFrame:
    """doc_id, text, model, stage, stage_ord, condition, prompt_idx, seed: documents dealt
    over the study's grid."""
    stage = F.pmod(F.floor(F.col("doc_id") / 2), F.lit(5)).cast("int")
    cell = ["model", "stage", "condition", "prompt_idx"]
    condition = F.lit(None).cast("string")
    for lang, name in CONDITIONS.items():
        condition = F.when(F.col("lang") == lang, name).otherwise(condition)
    return docs.select(
        "doc_id",
        "text",
        F.when(F.col("doc_id") % 2 == 0, "1B").otherwise("7B").alias("model"),
        F.element_at(F.array(*[F.lit(s) for s in STAGES]), stage + 1).alias("stage"),
        stage.alias("stage_ord"),
        condition.alias("condition"),
        F.pmod(F.floor(F.col("doc_id") / 10), F.lit(5)).cast("int").alias("prompt_idx"),
    ).withColumn("seed", F.row_number().over(Window.partitionBy(*cell).orderBy("doc_id")) - 1)


def generation_key() -> Column:
    return F.concat(
        F.col("model"), F.lit("__"), F.col("stage"), F.lit("__"), F.col("condition"), F.lit("_"),
        F.lpad(F.col("prompt_idx").cast("string"), 2, "0"), F.lit("__s"), F.col("seed").cast("string"),
    )


# The same views as DuckDB CTEs.
SQL = {
    "sft": "sft AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id)",
    "pairs": r"""at_ AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'assistant'),
pairs AS (SELECT conv_id, string_agg(text, '\n' ORDER BY rn) FILTER (rn % 2 = 1) AS chosen_text,
  string_agg(text, '\n' ORDER BY rn) FILTER (rn % 2 = 0) AS rejected_text FROM at_ GROUP BY conv_id HAVING count_if(rn % 2 = 0) > 0)""",
    "generations": """gen0 AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN '1B' ELSE '7B' END AS model,
  (doc_id // 2 % 5)::INTEGER AS stage_ord, ['base', 'sft', 'dpo', 'rlvr', 'instruct'][doc_id // 2 % 5 + 1] AS stage,
  CASE lang WHEN 'en' THEN 'advice' WHEN 'de' THEN 'factual' WHEN 'es' THEN 'emotional' WHEN 'fr' THEN 'neutral_advice' END AS condition,
  (doc_id // 10 % 5)::INTEGER AS prompt_idx FROM documents),
generations AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY model, stage, condition, prompt_idx ORDER BY doc_id) - 1)::INTEGER AS seed FROM gen0)""",
}


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
