"""Detectors against labels, statistics, and label sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions import statistics as ST
from ..functions import text as T
from ..operators import validation as V
from ..sources import tables as S
from . import corpus_queries as CQ
from . import emission_queries as EQ
from .registry import any_of, query

CATEGORIES = list(L.DEMO)
SEED = 20260716
DRAWS = 10_000


def labelled(spark, d):
    """doc_id, text, lang, quality, toxic of the labelled documents."""
    return S.table(spark, d, "documents").select("doc_id", "text", "lang").join(S.table(spark, d, "labels"), "doc_id")


def judged(spark, d):
    """A row per labelled document and category: gold (quality) and predicted (lexicon)."""
    low = F.lower("text")
    rows = F.array(*[F.struct(F.lit(c).alias("category"), T.any_of(low, ps).alias("predicted")) for c, ps in L.DEMO.items()])
    return labelled(spark, d).select("doc_id", "lang", (F.col("quality") == 1).alias("gold"), F.explode(rows).alias("r")).select("doc_id", "lang", "gold", "r.*")


_LAB = "lab AS MATERIALIZED (SELECT doc_id, text, lang, quality, toxic FROM documents JOIN labels USING (doc_id))"
_J = " UNION ALL ".join(f"SELECT doc_id, lang, quality = 1 AS gold, '{c}' AS category, {any_of('lower(text)', ps)} AS predicted FROM lab" for c, ps in L.DEMO.items())
JUDGED = f"WITH {_LAB}, j AS MATERIALIZED ({_J})"
_COUNTS = "count_if(gold AND predicted) AS tp, count_if(NOT gold AND predicted) AS fp, count_if(gold AND NOT predicted) AS fn"
_PRF = """CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END AS recall"""
METRICS = JUDGED + f""", c AS (SELECT category, {_COUNTS}, count_if(NOT gold AND NOT predicted) AS tn FROM j GROUP BY category), pr AS (SELECT *, {_PRF} FROM c),
m AS MATERIALIZED (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"""


@query("detector_metrics", METRICS + " SELECT * FROM m")
def detector_metrics(spark, d):
    return V.metrics(judged(spark, d), ["category"])


@query("macro_metrics", METRICS + " SELECT round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1 FROM m")
def macro_metrics(spark, d):
    return V.macro(detector_metrics(spark, d))


@query(
    "metrics_grouping_sets",
    JUDGED + f""" SELECT CASE grouping_id(category, lang) WHEN 3 THEN 'overall' WHEN 1 THEN 'category' ELSE 'lang' END AS level, coalesce(category, lang) AS value, {_COUNTS}, count(*) AS n
FROM j GROUP BY GROUPING SETS ((), (category), (lang))""",
)
def metrics_grouping_sets(spark, d):
    return V.grouping_sets(judged(spark, d), "category", "lang")


def annotators(spark, d):
    """doc_id, label_1, label_2 as label lists: the second annotator differs on every tenth document."""
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    second = F.when(F.col("doc_id") % 10 == 0, ~q).otherwise(q)
    name = lambda a: F.array_join(F.array_compact(F.array(F.when(a, "quality"), F.when(t, "toxic"))), ";")
    return S.table(spark, d, "labels").select("doc_id", name(q).alias("label_1"), name(second).alias("label_2"))


_NAME = "array_to_string(list_filter([CASE WHEN {} THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL), ';')"
ANN = f"an AS MATERIALIZED (SELECT doc_id, {_NAME.format('quality = 1')} AS label_1, {_NAME.format('(quality = 1) <> (doc_id % 10 = 0)')} AS label_2 FROM labels)"


@query(
    "cohen_kappa",
    f"""WITH {ANN}, c AS (SELECT unnest(['quality', 'toxic']) AS category), r AS (SELECT category, contains(label_1, category) AS a, contains(label_2, category) AS b FROM an, c),
k AS (SELECT category, count(*) AS n, count_if(a AND b) AS "both", count_if(a AND NOT b) AS only_a, count_if(NOT a AND b) AS only_b, count_if(NOT a AND NOT b) AS neither FROM r GROUP BY category),
x AS (SELECT *, ("both" + neither) / n::DOUBLE AS po, (("both" + only_a) / n::DOUBLE) * (("both" + only_b) / n::DOUBLE) + ((only_b + neither) / n::DOUBLE) * ((only_a + neither) / n::DOUBLE) AS pe FROM k)
SELECT category, n, "both", only_a, only_b, neither, "both" + neither AS agree, CASE WHEN pe <> 1 THEN (po - pe) / (1 - pe) END AS kappa FROM x""",
)
def cohen_kappa(spark, d):
    rated = annotators(spark, d).withColumn("category", F.explode(F.array(F.lit("quality"), F.lit("toxic"))))
    rated = rated.select("category", F.array_contains(T.parse_label(F.col("label_1")), F.col("category")).alias("a"), F.array_contains(T.parse_label(F.col("label_2")), F.col("category")).alias("b"))
    return V.kappa(rated, ["category"])


@query("disagreements", f"WITH {ANN} SELECT doc_id, label_1, label_2 FROM an WHERE label_1 <> label_2")
def disagreements(spark, d):
    return annotators(spark, d).filter(T.parse_label(F.col("label_1")) != T.parse_label(F.col("label_2")))


@query("adjudicate", f"WITH {ANN} SELECT doc_id, CASE WHEN label_1 <> label_2 AND doc_id % 20 = 0 THEN 'quality' ELSE label_1 END AS label FROM an")
def adjudicate(spark, d):
    """Half of the disagreements have been decided."""
    decisions = disagreements(spark, d).filter(F.col("doc_id") % 20 == 0).select("doc_id", F.lit("quality").alias("label"))
    return V.adjudicated(annotators(spark, d), decisions, "doc_id").select("doc_id", "label")


@query("validation_join", f"WITH {ANN} SELECT d.doc_id, lang, length(text)::INTEGER AS n_chars, label_1, label_2 FROM documents d JOIN an USING (doc_id)")
def validation_join(spark, d):
    return S.table(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("n_chars")).join(annotators(spark, d), "doc_id")


@query(
    "coverage_check",
    """SELECT doc_id, 'missing' AS problem FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT DISTINCT doc_id, 'unexpected' FROM labels ANTI JOIN documents USING (doc_id)
UNION ALL SELECT doc_id, 'repeated' FROM labels GROUP BY doc_id HAVING count(*) > 1""",
)
def coverage_check(spark, d):
    return V.coverage(S.table(spark, d, "documents"), S.table(spark, d, "labels"), "doc_id")


@query("duplicate_keys", "SELECT label, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) > 1 UNION ALL SELECT vec_id, count(*) FROM embeddings GROUP BY vec_id HAVING count(*) > 1")
def duplicate_keys(spark, d):
    e = S.table(spark, d, "embeddings")
    twice = lambda c: e.groupBy(F.col(c).cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice("label").unionByName(twice("vec_id"))


@query(
    "zip_join",
    """WITH a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'user'),
b AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'assistant')
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.i, b.i)::INTEGER AS i, length(a.text)::INTEGER AS user_chars, length(b.text)::INTEGER AS assistant_chars, a.i IS NOT NULL AND b.i IS NOT NULL AS aligned
FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.i = b.i""",
)
def zip_join(spark, d):
    """The n-th user turn with the n-th assistant turn; ``aligned`` tells where one has no partner."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    side = lambda role: S.table(spark, d, "conversations").filter(F.col("role") == role).select("conv_id", F.row_number().over(w).alias("i"), F.length("text").alias(f"{role}_chars"))
    out = side("user").join(side("assistant"), ["conv_id", "i"], "full")
    return out.withColumn("aligned", F.col("user_chars").isNotNull() & F.col("assistant_chars").isNotNull())


@query("left_default", "SELECT d.doc_id, coalesce(l.quality, -1)::BIGINT AS quality, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_default(spark, d):
    l = S.table(spark, d, "labels").withColumn("labelled", F.lit(True))
    return S.table(spark, d, "documents").select("doc_id").join(l, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("quality").cast("long"), F.lit(-1)).alias("quality"), F.coalesce("labelled", F.lit(False)).alias("labelled")
    )


@query("labeled_only", f"WITH {ANN} SELECT doc_id, label_1 FROM an WHERE trim(label_1) <> ''")
def labeled_only(spark, d):
    return annotators(spark, d).filter(F.trim("label_1") != "").select("doc_id", "label_1")


_SETS = f"""WITH {ANN}, s AS (SELECT doc_id, list_filter(string_split(label_1, ';'), lambda x: x <> '') AS g, list_filter(string_split(label_2, ';'), lambda x: x <> '') AS p FROM an)"""
_SORTED = "array_to_string(list_sort({}), ';')"


@query("label_setops", _SETS + f" SELECT doc_id, {_SORTED.format('list_intersect(g, p)')} AS tp, {_SORTED.format('list_filter(p, lambda x: NOT list_contains(g, x))')} AS fp, {_SORTED.format('list_filter(g, lambda x: NOT list_contains(p, x))')} AS fn FROM s")
def label_setops(spark, d):
    g, p = T.parse_label(F.col("label_1")), T.parse_label(F.col("label_2"))
    out = lambda x: F.array_join(F.array_sort(x), ";")
    return annotators(spark, d).select("doc_id", out(F.array_intersect(g, p)).alias("tp"), out(F.array_except(p, g)).alias("fp"), out(F.array_except(g, p)).alias("fn"))


@query("detector_union", _SETS + f" SELECT doc_id, {_SORTED.format('list_distinct(list_concat(g, p))')} AS detected FROM s")
def detector_union(spark, d):
    both = F.array_union(T.parse_label(F.col("label_1")), T.parse_label(F.col("label_2")))
    return annotators(spark, d).select("doc_id", F.array_join(F.array_sort(both), ";").alias("detected"))


# --- statistics -------------------------------------------------------------------

Z = repr(ST.Z)


def _wilson(k: str, n: str, sign: str) -> str:
    p = f"({k}::DOUBLE / {n})"
    core = f"({p} + {Z} * {Z} / (2 * {n}::DOUBLE)) / (1 + {Z} * {Z} / {n}::DOUBLE) {sign} {Z} * sqrt({p} * (1 - {p}) / {n}::DOUBLE + {Z} * {Z} / (4 * {n}::DOUBLE * {n}::DOUBLE)) / (1 + {Z} * {Z} / {n}::DOUBLE)"
    return f"greatest(0.0::DOUBLE, {core})" if sign == "-" else f"least(1.0::DOUBLE, {core})"


RATES = EQ.FLAGS + ", k AS MATERIALIZED (SELECT model, category, count_if(flag = 1 AND condition = 'advice') AS k1, count_if(condition = 'advice') AS n1, count_if(flag = 1 AND condition = 'factual') AS k2, count_if(condition = 'factual') AS n2 FROM flags GROUP BY ALL)"


def two_by_two(spark, d):
    """model, category, k1 of n1 advice texts and k2 of n2 factual ones with a flag."""
    f = EQ.flags(spark, d)
    n = lambda c, k: F.count_if((F.col("condition") == c) & k)
    hit, any_ = F.col("flag") == 1, F.lit(True)
    return f.groupBy("model", "category").agg(
        n("advice", hit).alias("k1"), n("advice", any_).alias("n1"), n("factual", hit).alias("k2"), n("factual", any_).alias("n2")
    )


@query("wilson_ci", RATES + f" SELECT model, category, k1, n1, round({_wilson('k1', 'n1', '-')}, 9) AS low, round({_wilson('k1', 'n1', '+')}, 9) AS high FROM k WHERE n1 > 0")
def wilson_ci(spark, d):
    low, high = ST.wilson(F.col("k1"), F.col("n1"))
    return two_by_two(spark, d).filter("n1 > 0").select("model", "category", "k1", "n1", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(
    "newcombe_ci",
    RATES + f""", b AS (SELECT model, category, k1::DOUBLE / n1 AS p1, k2::DOUBLE / n2 AS p2, {_wilson('k1', 'n1', '-')} AS l1, {_wilson('k1', 'n1', '+')} AS u1, {_wilson('k2', 'n2', '-')} AS l2, {_wilson('k2', 'n2', '+')} AS u2 FROM k WHERE n1 > 0 AND n2 > 0)
SELECT model, category, round(p1 - p2, 9) AS difference, round(p1 - p2 - sqrt((p1 - l1) ** 2 + (u2 - p2) ** 2), 9) AS low, round(p1 - p2 + sqrt((u1 - p1) ** 2 + (p2 - l2) ** 2), 9) AS high FROM b""",
)
def newcombe_ci(spark, d):
    k = two_by_two(spark, d).filter("n1 > 0 AND n2 > 0")
    low, high = ST.newcombe(*[F.col(c) for c in ("k1", "n1", "k2", "n2")])
    difference = F.col("k1").cast("double") / F.col("n1") - F.col("k2").cast("double") / F.col("n2")
    return k.select("model", "category", F.round(difference, 9).alias("difference"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(
    "odds_ratio_ha",
    RATES + f""", h AS (SELECT model, category, k1 + 0.5::DOUBLE AS a, n1 - k1 + 0.5::DOUBLE AS b, k2 + 0.5::DOUBLE AS c, n2 - k2 + 0.5::DOUBLE AS d FROM k),
l AS (SELECT *, ln(a * d / (b * c)) AS lg, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS se FROM h)
SELECT model, category, round(exp(lg), 6) AS odds_ratio, round(exp(lg - {Z} * se), 6) AS low, round(exp(lg + {Z} * se), 6) AS high FROM l""",
)
def odds_ratio_ha(spark, d):
    o, low, high = ST.odds_ratio(F.col("k1"), F.col("n1") - F.col("k1"), F.col("k2"), F.col("n2") - F.col("k2"))
    return two_by_two(spark, d).select("model", "category", F.round(o, 6).alias("odds_ratio"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def _choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


def _fisher(source: str, keys: str) -> str:
    """CTEs that end in fp (keys, p): the exact p of k1 of n1 against k2 of n2. lgamma of 0 and below is never asked."""
    return f"""fm AS (SELECT *, n1::BIGINT AS fr, (k1 + k2)::BIGINT AS fc, (n1 + n2)::BIGINT AS fn FROM {source}),
fx AS (SELECT *, unnest(range(greatest(0, fr + fc - fn), least(fr, fc) + 1)) AS x FROM fm),
fl AS (SELECT *, {_choose('fc', 'x')} + {_choose('(fn - fc)', '(fr - x)')} - {_choose('fn', 'fr')} AS lp FROM fx),
fs AS (SELECT *, max(CASE WHEN x = k1 THEN lp END) OVER (PARTITION BY {keys}) AS seen FROM fl),
fp AS MATERIALIZED (SELECT {keys}, any_value(k1) AS k1, any_value(n1) AS n1, any_value(k2) AS k2, any_value(n2) AS n2, round(least(1.0::DOUBLE, sum(exp(lp)) FILTER (lp <= seen + 1e-7)), 9) AS p FROM fs GROUP BY {keys})"""


def with_fisher(two, *keys):
    """``two`` (keys, k1, n1, k2, n2) with its exact p to nine digits."""
    p = ST.fisher("k1", F.col("n1") - F.col("k1"), "k2", F.col("n2") - F.col("k2"))
    return two.select(*keys, "k1", "n1", "k2", "n2", F.round(p, 9).alias("p"))


@query("fisher_exact", RATES + ", " + _fisher("k", "model, category") + " SELECT model, category, k1, n1, k2, n2, p FROM fp")
def fisher_exact(spark, d):
    """Two-sided exact p of each model and category; tested against published values too."""
    return with_fisher(two_by_two(spark, d), "model", "category")


_MCNEMAR = f"""mk AS (SELECT behavior, chosen_only, rejected_only, (chosen_only + rejected_only)::BIGINT AS m, least(chosen_only, rejected_only)::BIGINT AS low FROM n),
mt AS (SELECT *, unnest(range(0, low + 1)) AS i FROM mk),
mc AS MATERIALIZED (SELECT behavior, chosen_only, rejected_only, CASE WHEN any_value(m) = 0 THEN 0.0::DOUBLE ELSE ln(2.0::DOUBLE) + ln(sum(exp({_choose('m', 'i')} - m * ln(2.0::DOUBLE)))) END AS lp FROM mt GROUP BY behavior, chosen_only, rejected_only)"""


@query("mcnemar", CQ.COUNTS + f", {_MCNEMAR} SELECT behavior, chosen_only, rejected_only, round(least(1.0::DOUBLE, exp(lp)), 9) AS p, round(lp / ln(10.0::DOUBLE), 6) AS log10_p FROM mc")
def mcnemar(spark, d):
    """Exact paired test of each family; tested against published values too."""
    c = CQ.pair_contingency(spark, d).select("behavior", "chosen_only", "rejected_only", ST.mcnemar("chosen_only", "rejected_only").alias("t"))
    return c.select("behavior", "chosen_only", "rejected_only", F.round("t.p", 9).alias("p"), F.round("t.log10_p", 6).alias("log10_p"))


def prompt_rates(spark, d):
    from ..operators import emission as E

    return E.prompt_rates(EQ.flags(spark, d)).withColumn("rate", F.col("hits").cast("double") / F.col("seeds"))


@query("perm_test")
def perm_test(spark, d):
    """Prompt rates of advice against factual, shuffled; one task per model, stage and category."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["condition", "prompt_idx"])
        a, b = (pdf.loc[pdf.condition == c, "rate"].tolist() for c in ("advice", "factual"))
        observed, hits = ST.mean_difference_p(a, b, DRAWS, SEED) if a and b else (float("nan"), DRAWS)
        row = pdf.iloc[0]
        return pd.DataFrame([(row.model, row.stage, row.category, observed, hits, (hits + 1) / (DRAWS + 1))], columns=["model", "stage", "category", "difference", "hits", "p"])

    rates = prompt_rates(spark, d).filter(F.col("condition").isin("advice", "factual"))
    return rates.groupBy("model", "stage", "category").applyInPandas(run, "model string, stage string, category string, difference double, hits long, p double")


@query("did_permutation")
def did_permutation(spark, d):
    """Gains from one stage to the next of advice prompts against factual ones, prompts shuffled whole."""
    stages = S.STAGES

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        wide = pdf.pivot_table(index=["condition", "prompt_idx"], columns="stage", values="rate")
        for k, (x, y) in enumerate(zip(stages, stages[1:], strict=False)):
            if x not in wide or y not in wide:
                continue
            both = wide[[x, y]].dropna().sort_index()
            a, b = (both.loc[c].to_numpy() if c in both.index.get_level_values(0) else np.zeros((0, 2)) for c in ("advice", "factual"))
            if len(a) and len(b):
                observed, hits = ST.did_p(a, b, DRAWS, SEED + k)
                out.append((pdf.model.iloc[0], pdf.category.iloc[0], x, y, observed, hits, (hits + 1) / (DRAWS + 1)))
        return pd.DataFrame(out, columns=["model", "category", "from_stage", "to_stage", "did", "hits", "p"])

    rates = prompt_rates(spark, d).filter(F.col("condition").isin("advice", "factual"))
    return rates.groupBy("model", "category").applyInPandas(run, "model string, category string, from_stage string, to_stage string, did double, hits long, p double")


@query("cluster_bootstrap")
def cluster_bootstrap(spark, d):
    """95 % intervals of precision, recall and F1 per category, and of their means over the categories, under
    random weights of clusters (documents by language) that the categories share; only counts by
    cluster and category, at most a hundred clusters, reach the task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        every = pd.MultiIndex.from_product([sorted(pdf.category.unique()), sorted(pdf.cluster.unique())], names=["category", "cluster"])
        pdf = pdf.set_index(["category", "cluster"])[["tp", "fp", "fn"]].reindex(every, fill_value=0)
        # The same seed and number of clusters: every category sees the same weights.
        draws = {c: ST.dirichlet_bootstrap(*(pdf.loc[c, k].to_numpy(float) for k in ("tp", "fp", "fn")), DRAWS, SEED) for c in every.levels[0]}
        draws["macro"] = np.mean(list(draws.values()), axis=0)  # a draw counts where every category has a value
        rows = []
        for category, drawn in draws.items():
            for i, name in enumerate(("precision", "recall", "f1")):
                v = drawn[:, i][~np.isnan(drawn[:, i])]
                low, high = np.quantile(v, [0.025, 0.975]) if len(v) else (np.nan, np.nan)
                rows.append((category, name, float(low), float(high), len(v)))
        return pd.DataFrame(rows, columns=["category", "metric", "low", "high", "valid"])

    j = judged(spark, d).withColumn("cluster", F.concat_ws("_", "lang", (F.col("doc_id") % 25).cast("string")))
    counts = j.groupBy("category", "cluster").agg(*[c for k, c in V.outcome(F.col("gold"), F.col("predicted")).items() if k != "tn"])
    return counts.withColumn("every", F.lit("all")).groupBy("every").applyInPandas(run, "category string, metric string, low double, high double, valid long")


#: Exact tests of advice against factual texts at each stage, as the tests that the corrections are for.
TESTS = RATES + """, ks AS (SELECT model, stage, category, count_if(flag = 1 AND condition = 'advice') AS k1, count_if(condition = 'advice') AS n1, count_if(flag = 1 AND condition = 'factual') AS k2, count_if(condition = 'factual') AS n2 FROM flags GROUP BY ALL), """ + _fisher("ks", "model, stage, category")


def tests(spark, d):
    n = lambda c, k: F.count_if((F.col("condition") == c) & k)
    hit, any_ = F.col("flag") == 1, F.lit(True)
    two = EQ.flags(spark, d).groupBy("model", "stage", "category").agg(
        n("advice", hit).alias("k1"), n("advice", any_).alias("n1"), n("factual", hit).alias("k2"), n("factual", any_).alias("n2")
    )
    return with_fisher(two, "model", "stage", "category")


BH = """, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, name) AS rank, count(*) OVER (PARTITION BY family) AS m FROM f),
q AS (SELECT *, least(1.0::DOUBLE, min(p * m / rank) OVER (PARTITION BY family ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)"""


@query("bh_qvalues", TESTS + ", f AS (SELECT model AS family, category || '/' || stage AS name, p FROM fp)" + BH + " SELECT family, name, p, rank::INTEGER AS rank, round(q, 9) AS q FROM q")
def bh_qvalues(spark, d):
    t = tests(spark, d).select(F.col("model").alias("family"), F.concat_ws("/", "category", "stage").alias("name"), "p")
    return ST.bh_qvalues(t, "p", ["family"], "name").withColumn("q", F.round("q", 9))


_PAIRED = CQ.COUNTS.removeprefix("WITH ").replace(" f AS MATERIALIZED", " pf AS MATERIALIZED").replace("FROM f", "FROM pf")
_FAMILIES = TESTS + ", " + _PAIRED + f""", {_MCNEMAR}, f AS (SELECT 'stage' AS family, model || '/' || category || '/' || stage AS name, p FROM fp
UNION ALL SELECT 'pairs', behavior, round(least(1.0::DOUBLE, exp(lp)), 9) FROM mc)""" + BH


def families(spark, d):
    """The stage tests and the paired tests, each a family of its own."""
    stage = tests(spark, d).select(F.lit("stage").alias("family"), F.concat_ws("/", "model", "category", "stage").alias("name"), "p")
    paired = mcnemar(spark, d).select(F.lit("pairs").alias("family"), F.col("behavior").alias("name"), "p")
    return ST.bh_qvalues(stage.unionByName(paired), "p", ["family"], "name")


@query("bh_families", _FAMILIES + " SELECT family, name, p, round(q, 9) AS q FROM q")
def bh_families(spark, d):
    return families(spark, d).select("family", "name", "p", F.round("q", 9).alias("q"))


@query("sig_summary", _FAMILIES + " SELECT family, count(*) AS n_tests, min(p) AS min_p, max(p) AS max_p, count_if(q < 0.05) AS n_significant FROM q GROUP BY family")
def sig_summary(spark, d):
    return families(spark, d).groupBy("family").agg(
        F.count(F.lit(1)).alias("n_tests"), F.min("p").alias("min_p"), F.max("p").alias("max_p"), F.count_if(F.col("q") < 0.05).alias("n_significant")
    )


@query("run_totals", "SELECT event_type, count(*) AS n_runs, round(coalesce(sum(CASE WHEN user_id % 5 <> 0 THEN round(value, 2) ELSE 0 END), 0), 6) AS total_cost, sum(CASE WHEN user_id % 3 <> 0 THEN user_id ELSE 0 END)::BIGINT AS total_duration FROM events GROUP BY event_type")
def run_totals(spark, d):
    """Events as runs; some report no cost, some no duration. Costs are in cents, so that sums don't depend on order."""
    runs = S.table(spark, d, "events").select(
        "event_type", F.when(F.col("user_id") % 5 != 0, F.round("value", 2)).alias("cost"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("duration")
    )
    return V.run_totals(runs, ["event_type"], "cost", "duration")


@query("pooled_rates", EQ.FLAGS + " SELECT condition AS pool, category, count(*) AS n, sum(flag)::BIGINT AS hits FROM flags WHERE condition IN ('advice', 'factual') GROUP BY ALL")
def pooled_rates(spark, d):
    f = EQ.flags(spark, d)
    both = V.pool(*[(c, f.filter(F.col("condition") == c)) for c in ("advice", "factual")])
    return both.groupBy("pool", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("flag").alias("hits"))


@query(
    "annotation_gate",
    """WITH n AS (SELECT count(DISTINCT doc_id) AS n FROM labels) SELECT CASE WHEN count(*) = any_value(n) AND count(DISTINCT doc_id) = any_value(n) THEN 'ready' ELSE 'pending' END AS status,
  CASE WHEN count(*) <> any_value(n) OR count(DISTINCT doc_id) <> any_value(n) THEN 'an annotation does not cover the items exactly' END AS reason FROM labels, n""",
)
def annotation_gate(spark, d):
    """Two certified people label all items: their scores may be worked out."""
    items = S.table(spark, d, "labels").select("doc_id")
    sheet = lambda k, c: S.table(spark, d, "labels").select(F.lit(k).alias("annotator"), "doc_id", F.lit("human").alias("annotator_type"), F.col(c).cast("string").alias("label"))
    who = spark.createDataFrame([(1, "a", "human", True), (2, "b", "human", True)], "annotator int, annotator_id string, annotator_type string, independent boolean")
    return V.gate(items, sheet(1, "quality").unionByName(sheet(2, "toxic")), who, "doc_id")


@query("plus_one", EQ.FLAGS + " SELECT model, stage, condition, category, (hits + 1)::DOUBLE / (10000 + 1) AS p FROM cr")
def plus_one(spark, d):
    return EQ.rates(spark, d).select("model", "stage", "condition", "category", ST.plus_one(F.col("hits"), F.lit(10000)).alias("p"))


@query("percentile_ci", "SELECT lang, round(quantile_cont(n_chars::DOUBLE, 0.025), 9) AS low, round(quantile_cont(n_chars::DOUBLE, 0.975), 9) AS high FROM documents GROUP BY lang")
def percentile_ci(spark, d):
    p = lambda q: F.round(F.percentile(F.col("n_chars").cast("double"), q), 9)
    return S.table(spark, d, "documents").groupBy("lang").agg(p(0.025).alias("low"), p(0.975).alias("high"))


