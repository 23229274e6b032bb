"""Emission over the grid, embeddings, and completeness."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..operators import embeddings as V
from ..operators import emission as E
from ..operators import sampling
from ..sources import tables as S
from ..sources.files import missing
from .registry import any_of, query, values

CATEGORIES = list(L.DEMO)


def generations(spark, d):
    return S.generations(S.table(spark, d, "documents"))


def flags(spark, d):
    return E.lexicon_flags(generations(spark, d), L.DEMO)


_FLAG = " UNION ALL ".join(f"SELECT doc_id, model, stage, stage_ord, condition, prompt_idx, seed, '{c}' AS category, {any_of('lower(text)', ps)}::INTEGER AS flag FROM generations" for c, ps in L.DEMO.items())
FLAGS = S.ctes("generations") + f""", flags AS MATERIALIZED ({_FLAG}),
pr AS MATERIALIZED (SELECT model, stage, stage_ord, condition, category, prompt_idx, sum(flag) AS hits, count(*) AS seeds FROM flags GROUP BY ALL),
cr AS MATERIALIZED (SELECT model, stage, stage_ord, condition, category, round(avg(hits::DOUBLE / seeds), 9) AS rate, count(*) AS n_prompts, sum(hits)::BIGINT AS hits FROM pr GROUP BY ALL),
gp AS MATERIALIZED (SELECT model, stage, stage_ord, category, max(rate) FILTER (condition = 'advice') AS advice_rate, max(rate) FILTER (condition = 'factual') AS control_rate,
  round(max(rate) FILTER (condition = 'advice') - max(rate) FILTER (condition = 'factual'), 9) AS gap FROM cr GROUP BY ALL)"""


def rates(spark, d):
    return E.condition_rates(E.prompt_rates(flags(spark, d)))


@query("stagewise_emission", FLAGS + " SELECT model, stage, stage_ord, condition, category, rate, n_prompts, hits FROM cr")
def stagewise_emission(spark, d):
    return rates(spark, d)


@query("emission_by_condition", FLAGS + ", p AS (SELECT condition, category, prompt_idx, sum(hits) AS hits, sum(seeds) AS seeds FROM pr GROUP BY ALL) SELECT condition, category, round(avg(hits::DOUBLE / seeds), 9) AS rate, count(*) AS n_prompts, sum(hits)::BIGINT AS hits FROM p GROUP BY ALL")
def emission_by_condition(spark, d):
    p = E.prompt_rates(flags(spark, d)).groupBy("condition", "category", "prompt_idx").agg(F.sum("hits").alias("hits"), F.sum("seeds").alias("seeds"))
    return E.condition_rates(p, ["condition", "category"])


def gaps(spark, d):
    return E.stage_gaps(rates(spark, d))


@query("stage_gaps", FLAGS + " SELECT * FROM gp")
def stage_gaps(spark, d):
    return gaps(spark, d)


@query("stage_deltas", FLAGS + " SELECT model, stage, category, gap, round(gap - lag(gap) OVER (PARTITION BY model, category ORDER BY stage_ord), 9) AS delta FROM gp")
def stage_deltas(spark, d):
    return E.stage_deltas(gaps(spark, d)).select("model", "stage", "category", "gap", "delta")


DID = FLAGS + """, dd AS (SELECT model, category, stage AS from_stage, lead(stage) OVER w AS to_stage, round(lead(gap) OVER w - gap, 9) AS did FROM gp WINDOW w AS (PARTITION BY model, category ORDER BY stage_ord)),
did AS MATERIALIZED (SELECT * FROM dd WHERE to_stage IS NOT NULL)"""


@query("did", DID + " SELECT * FROM did")
def did(spark, d):
    return E.difference_in_differences(gaps(spark, d))


@query(
    "transition_pivot",
    DID + """ SELECT model, category, max(did) FILTER (from_stage = 'base') AS base_sft, max(did) FILTER (from_stage = 'sft') AS sft_dpo,
  max(did) FILTER (from_stage = 'dpo') AS dpo_rlvr, max(did) FILTER (from_stage = 'rlvr') AS rlvr_instruct FROM did GROUP BY model, category""",
)
def transition_pivot(spark, d):
    moved = did(spark, d).withColumn("transition", F.concat_ws("_", "from_stage", "to_stage"))
    return moved.groupBy("model", "category").pivot("transition", ["base_sft", "sft_dpo", "dpo_rlvr", "rlvr_instruct"]).agg(F.max("did"))


@query(
    "stage_pairs",
    S.ctes("generations") + """, s AS (SELECT DISTINCT model, stage, stage_ord FROM generations), n AS (SELECT model, stage AS from_stage, lead(stage) OVER (PARTITION BY model ORDER BY stage_ord) AS to_stage FROM s)
SELECT * FROM n WHERE to_stage IS NOT NULL UNION SELECT model, arg_min(stage, stage_ord), arg_max(stage, stage_ord) FROM s GROUP BY model""",
)
def stage_pairs(spark, d):
    return E.stage_pairs(generations(spark, d).select("model", "stage", "stage_ord").distinct())


@query(
    "threshold_contrasts",
    FLAGS + """, p AS (SELECT model, stage, category, max(rate) FILTER (condition = 'advice') AS a, max(rate) FILTER (condition = 'factual') AS f, max(rate) FILTER (condition = 'emotional') AS e, max(rate) FILTER (condition = 'neutral_advice') AS n FROM cr GROUP BY ALL)
SELECT model, stage, category, a AS advice, greatest(f, e, n) AS best_control, round(a - greatest(f, e, n), 9) AS contrast FROM p""",
)
def threshold_contrasts(spark, d):
    wide = rates(spark, d).groupBy("model", "stage", "category").pivot("condition", list(S.CONDITIONS.values())).agg(F.max("rate"))
    best = F.greatest("factual", "emotional", "neutral_advice")
    return wide.select("model", "stage", "category", F.col("advice"), best.alias("best_control"), F.round(F.col("advice") - best, 9).alias("contrast"))


@query(
    "causal_drop",
    FLAGS + """, p AS (SELECT model, category, round(max(rate) FILTER (stage = 'base' AND condition = 'advice') - max(rate) FILTER (stage = 'instruct' AND condition = 'advice'), 9) AS drop_ FROM cr GROUP BY ALL)
SELECT model, max(drop_) FILTER (category = 'validation') AS target_drop, max(drop_) FILTER (category <> 'validation') AS max_control_drop,
  max(drop_) FILTER (category = 'validation') > max(drop_) FILTER (category <> 'validation') AS signal FROM p GROUP BY model""",
)
def causal_drop(spark, d):
    at = lambda s: F.max(F.when((F.col("stage") == s) & (F.col("condition") == "advice"), F.col("rate")))
    drop = rates(spark, d).groupBy("model", "category").agg(F.round(at("base") - at("instruct"), 9).alias("drop"))
    target = F.col("category") == "validation"
    out = drop.groupBy("model").agg(F.max(F.when(target, F.col("drop"))).alias("target_drop"), F.max(F.when(~target, F.col("drop"))).alias("max_control_drop"))
    return out.withColumn("signal", F.col("target_drop") > F.col("max_control_drop"))


@query("rate_to_count", FLAGS + " SELECT model, stage, condition, category, round_even(rate * n_prompts, 0)::BIGINT AS k, n_prompts FROM cr")
def rate_to_count(spark, d):
    return rates(spark, d).select("model", "stage", "condition", "category", F.bround(F.col("rate") * F.col("n_prompts")).cast("long").alias("k"), "n_prompts")


MIN_SEEDS = 2


@query(
    "completeness_gate",
    S.ctes("generations") + f""", c AS (SELECT DISTINCT model, stage, stage_ord, condition FROM generations), h AS (SELECT model, stage, condition, prompt_idx, count(DISTINCT seed) AS seeds FROM generations GROUP BY ALL)
SELECT c.model, c.stage, c.stage_ord, c.condition, p.prompt_idx::INTEGER AS prompt_idx, coalesce(seeds, 0) AS seeds FROM c CROSS JOIN range(5) p(prompt_idx)
LEFT JOIN h ON h.model = c.model AND h.stage = c.stage AND h.condition = c.condition AND h.prompt_idx = p.prompt_idx WHERE coalesce(seeds, 0) < {MIN_SEEDS}""",
)
def completeness_gate(spark, d):
    return E.completeness(generations(spark, d), 5, MIN_SEEDS)


GRID_MODELS = [("1B",), ("7B",)]
GRID_STAGES = [("base", 4), ("sft", 4), ("dpo", 4), ("instruct", 5)]
GRID_CONDITIONS = [("advice", 60, 5), ("factual", 30, 5), ("emotional", 20, 4), ("neutral_advice", 20, 4), ("domain_factual", 10, 1)]
GRID = "m AS (SELECT unnest(['1B', '7B']) AS model), " + values(GRID_STAGES, "s", "stage, stage_seeds") + ", " + values(GRID_CONDITIONS, "c", "condition, n_prompts, condition_seeds")


def grid(spark):
    return E.generation_grid(
        spark.createDataFrame(GRID_MODELS, "model string"),
        spark.createDataFrame(GRID_STAGES, "stage string, stage_seeds int"),
        spark.createDataFrame(GRID_CONDITIONS, "condition string, n_prompts int, condition_seeds int"),
    ).select("model", "stage", "condition", "prompt_idx", "seed")


_GRID_ROWS = f"WITH {GRID}, g AS (SELECT model, stage, condition, p.i::INTEGER AS prompt_idx, q.j::INTEGER AS seed FROM m, s, c, LATERAL (SELECT unnest(range(n_prompts)) AS i) p, LATERAL (SELECT unnest(range(least(stage_seeds, condition_seeds))) AS j) q)"


@query("generation_grid", _GRID_ROWS + " SELECT * FROM g")
def generation_grid(spark, d):
    return grid(spark)


_HAVE = "have AS (SELECT DISTINCT model, stage, condition, prompt_idx, seed FROM generations)"
_KEYS = "model, stage, condition, prompt_idx, seed"
_BOTH = S.ctes("generations") + ", " + _GRID_ROWS.removeprefix("WITH ") + ", " + _HAVE


@query("resume_missing", _BOTH + f" SELECT {_KEYS} FROM g ANTI JOIN have USING ({_KEYS})")
def resume_missing(spark, d):
    """Grid cells without a generation."""
    key = S.generation_key().alias("key")
    return missing(grid(spark).withColumn("key", key), generations(spark, d).select(key), "key").drop("key")


@query("cache_status", _BOTH + f" SELECT model, stage, count(*) AS expected, count(have.seed) AS cached, count(*) - count(have.seed) AS missing FROM g LEFT JOIN have USING ({_KEYS}) GROUP BY model, stage")
def cache_status(spark, d):
    have = generations(spark, d).select(*_KEYS.split(", ")).distinct().withColumn("there", F.lit(1))
    out = grid(spark).join(have, _KEYS.split(", "), "left").groupBy("model", "stage").agg(F.count(F.lit(1)).alias("expected"), F.count("there").alias("cached"))
    return out.withColumn("missing", F.col("expected") - F.col("cached"))


@query("discover_structure", S.ctes("generations") + " SELECT model, stage, condition, max(prompt_idx) + 1 AS n_prompts, max(seed) + 1 AS n_seeds, count(*) AS n FROM generations GROUP BY model, stage, condition")
def discover_structure(spark, d):
    return generations(spark, d).groupBy("model", "stage", "condition").agg((F.max("prompt_idx") + 1).alias("n_prompts"), (F.max("seed") + 1).alias("n_seeds"), F.count(F.lit(1)).alias("n"))


@query("strata_counts", S.ctes("generations") + " SELECT model, condition, count(*) AS n FROM generations GROUP BY model, condition")
def strata_counts(spark, d):
    return generations(spark, d).groupBy("model", "condition").agg(F.count(F.lit(1)).alias("n"))


@query("quick_subset", S.ctes("generations") + " SELECT doc_id, model, stage, condition FROM generations QUALIFY row_number() OVER (PARTITION BY model, stage, condition ORDER BY doc_id) <= 3")
def quick_subset(spark, d):
    return sampling.first_per_group(generations(spark, d), ["model", "stage", "condition"], "doc_id", 3).select("doc_id", "model", "stage", "condition")


@query("fixed_batches", S.ctes("generations") + " SELECT doc_id, condition, seed, ((row_number() OVER (PARTITION BY condition, seed ORDER BY doc_id) - 1) // 8)::INTEGER AS batch FROM generations")
def fixed_batches(spark, d):
    return sampling.batches(generations(spark, d), ["condition", "seed"], ["doc_id"], 8).select("doc_id", "condition", "seed", "batch")


_DRAW = "md5('{}:' || doc_id)"


@query("stratified_sample", S.ctes("generations") + f" SELECT doc_id, model, stage, condition, row_number() OVER (PARTITION BY model, stage, condition ORDER BY {_DRAW.format(7)}, doc_id) AS draw FROM generations QUALIFY draw <= 2")
def stratified_sample(spark, d):
    return sampling.per_stratum(generations(spark, d), ["model", "stage", "condition"], "doc_id", 2, 7).select("doc_id", "model", "stage", "condition", F.col("draw").cast("long").alias("draw"))


@query(
    "enriched_sample",
    FLAGS + f""", u AS (SELECT doc_id, 'random' AS role FROM generations QUALIFY row_number() OVER (PARTITION BY model, condition ORDER BY {_DRAW.format(1)}, doc_id) <= 2
UNION ALL SELECT doc_id, 'positive_' || category FROM flags WHERE flag = 1 QUALIFY row_number() OVER (PARTITION BY category ORDER BY {_DRAW.format(2)}, doc_id) <= 4)
SELECT doc_id, string_agg(DISTINCT role, ';' ORDER BY role) AS roles FROM u GROUP BY doc_id""",
)
def enriched_sample(spark, d):
    plain = sampling.per_stratum(generations(spark, d), ["model", "condition"], "doc_id", 2, 1).select("doc_id", F.lit("random").alias("role"))
    positive = sampling.per_stratum(flags(spark, d).filter("flag = 1"), ["category"], "doc_id", 4, 2).select("doc_id", F.concat(F.lit("positive_"), "category").alias("role"))
    return plain.unionByName(positive).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ";").alias("roles"))


@query("sample_n", f"SELECT doc_id FROM documents ORDER BY {_DRAW.format(3)}, doc_id LIMIT 25")
def sample_n(spark, d):
    return sampling.sample_n(S.table(spark, d, "documents"), "doc_id", 25, 3).select("doc_id")


# --- embeddings -------------------------------------------------------------------

SIM = """ex AS MATERIALIZED (SELECT label::VARCHAR AS category, embedding AS vec, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3),
sv AS MATERIALIZED (SELECT vec_id, vec_id % 50 AS doc, embedding AS vec FROM embeddings ANTI JOIN ex USING (vec_id)),
sm AS MATERIALIZED (SELECT sv.vec_id, doc, category, max(round(list_dot_product(sv.vec::DOUBLE[], ex.vec::DOUBLE[]), 6)) AS sim FROM sv, ex GROUP BY ALL)"""
THRESHOLDS = [0.80, 0.82, 0.84]


def exemplars(spark, d):
    e = S.table(spark, d, "embeddings").withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    return e.filter("rn <= 3").select("vec_id", F.col("label").cast("string").alias("category"), F.col("embedding").alias("vec"))


def sentences(spark, d):
    e = S.table(spark, d, "embeddings")
    return e.join(F.broadcast(exemplars(spark, d).select("vec_id")), "vec_id", "left_anti").select("vec_id", (F.col("vec_id") % 50).alias("doc"), F.col("embedding").alias("vec"))


def similarities(spark, d):
    return V.similarities(sentences(spark, d), exemplars(spark, d).select("category", "vec"))


@query("max_similarity", f"WITH {SIM} SELECT doc, category, max(sim) AS max_sim, count(*) AS n_sentences FROM sm GROUP BY doc, category")
def max_similarity(spark, d):
    return V.max_similarity(sentences(spark, d), exemplars(spark, d).select("category", "vec"))


@query("embedding_hits", f"WITH {SIM} SELECT category, count_if(sim >= 0.3) AS n_hits, count(*) AS n_sentences FROM sm GROUP BY category")
def embedding_hits(spark, d):
    return V.hits_at(similarities(spark, d), 0.3)


_TH = "th AS (SELECT unnest([0.2, 0.3, 0.4]::DOUBLE[]) AS threshold)"


@query(
    "threshold_sweep",
    f"WITH {SIM}, {_TH}, p AS (SELECT doc, category, max(sim) AS m FROM sm GROUP BY ALL), f AS (SELECT doc % 5 AS prompt_idx, category, threshold, sum((m >= threshold)::INTEGER) AS hits, count(*) AS seeds FROM p, th GROUP BY ALL) "
    "SELECT category, threshold, round(avg(hits::DOUBLE / seeds), 9) AS rate, sum(hits)::BIGINT AS hits FROM f GROUP BY category, threshold",
)
def threshold_sweep(spark, d):
    """From similarities that are worked out once."""
    sims = max_similarity(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in (0.2, 0.3, 0.4)])))
    prompts = sims.groupBy((F.col("doc") % 5).alias("prompt_idx"), "category", "threshold").agg(F.sum((F.col("max_sim") >= F.col("threshold")).cast("int")).alias("hits"), F.count(F.lit(1)).alias("seeds"))
    return E.condition_rates(prompts, ["category", "threshold"]).drop("n_prompts")


@query(
    "emits",
    f"""WITH {SIM}, p AS (SELECT doc, category, max(sim) AS m FROM sm GROUP BY ALL), x AS (SELECT doc, m, category, category = (doc % 10)::VARCHAR AS lexical FROM p)
SELECT category, count_if(lexical OR m >= 0.3) AS emitted, count_if(m >= 0.3) AS by_embedding, count_if(lexical) AS by_lexicon FROM x GROUP BY category""",
)
def emits(spark, d):
    """Each sentence group has one lexical category here, and its similarities as a map."""
    per = max_similarity(spark, d).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("category", "max_sim"))).alias("sims"))
    per = per.withColumn("lexicon", F.array((F.col("doc") % 10).cast("string"))).withColumn("category", F.explode(F.map_keys("sims")))
    lexical, near = F.array_contains("lexicon", F.col("category")), F.try_element_at("sims", F.col("category")) >= 0.3
    return per.groupBy("category").agg(
        F.count_if(E.emits(F.col("lexicon"), F.col("sims"), F.col("category"), F.lit(0.3))).alias("emitted"), F.count_if(near).alias("by_embedding"), F.count_if(lexical).alias("by_lexicon")
    )


@query(
    "size_matched_distractor",
    """WITH c AS (SELECT label, count(*) AS size, count_if(vec_id % 7 = 0) AS flagged FROM embeddings GROUP BY label),
b AS (SELECT *, coalesce(sum(size - flagged) OVER (ORDER BY flagged, size DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c)
SELECT label, size, flagged, before, least(size - flagged, 120 - before) AS taken FROM b WHERE before < 120""",
)
def size_matched_distractor(spark, d):
    e = S.table(spark, d, "embeddings").select("label", (F.col("vec_id") % 7 == 0).alias("behavioural"))
    return sampling.size_matched(e, "label", "behavioural", 120)


@query("leave_cluster_out", "SELECT vec_id, label FROM embeddings WHERE label NOT IN (SELECT label FROM embeddings GROUP BY label HAVING count_if(vec_id % 7 = 0) >= 8)")
def leave_cluster_out(spark, d):
    e = S.table(spark, d, "embeddings").select("vec_id", "label")
    out = e.groupBy("label").agg(F.count_if(F.col("vec_id") % 7 == 0).alias("n")).filter("n >= 8")
    return e.join(out, "label", "left_anti").select("vec_id", "label")


@query("tag_profile", S.ctes("generations") + f""", x AS (SELECT condition, {any_of('lower(text)', ['the and', 'and the'])} AS opener, length(text) AS n FROM generations)
SELECT condition, count(*) AS n_answers, count_if(opener)::DOUBLE / count(*) AS opener_rate, sum(n)::DOUBLE / count(*) AS mean_chars FROM x GROUP BY condition""")
def tag_profile(spark, d):
    from ..functions.text import any_of as has

    x = generations(spark, d).select("condition", has(F.lower("text"), L.DEMO["empathy_opener"]).alias("opener"), F.length("text").alias("n"))
    n = F.count(F.lit(1))
    return x.groupBy("condition").agg(n.alias("n_answers"), (F.count_if("opener").cast("double") / n).alias("opener_rate"), (F.sum("n").cast("double") / n).alias("mean_chars"))
