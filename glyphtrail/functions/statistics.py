"""Interval and effect-size formulas as Columns, exact tests and resampling as Arrow functions."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

Z = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the score interval of k of n, within 0 and 1; null where n is 0."""
    n_ = F.when(n > 0, n.cast("double"))
    p = k / n_
    centre = (p + z * z / (2 * n_)) / (1 + z * z / n_)
    half = z * F.sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_)) / (1 + z * z / n_)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column) -> tuple[Column, Column]:
    """Bounds of the hybrid score interval of k1/n1 - k2/n2."""
    (l1, u1), (l2, u2) = wilson(k1, n1), wilson(k2, n2)
    p1, p2 = F.try_divide(k1.cast("double"), n1), F.try_divide(k2.cast("double"), n2)
    d = p1 - p2
    return d - F.sqrt((p1 - l1) ** 2 + (u2 - p2) ** 2), d + F.sqrt((u1 - p1) ** 2 + (p2 - l2) ** 2)


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column]:
    """Odds ratio of (a of a + b) against (c of c + d), half a count added to each, with its 95 % bounds."""
    a, b, c, d = (x.cast("double") + 0.5 for x in (a, b, c, d))
    log = F.log(a * d / (b * c))
    se = F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return F.exp(log), F.exp(log - Z * se), F.exp(log + Z * se)


def plus_one(hits: Column, draws: Column) -> Column:
    return (hits + 1).cast("double") / (draws + 1)


def kappa(both: Column, only_a: Column, only_b: Column, neither: Column) -> Column:
    """Cohen's kappa of two yes/no raters; null if chance agreement is 1."""
    n = (both + only_a + only_b + neither).cast("double")
    observed = (both + neither) / n
    chance = ((both + only_a) / n) * ((both + only_b) / n) + ((only_b + neither) / n) * ((only_a + neither) / n)
    return F.when(chance != 1, F.try_divide(observed - chance, 1 - chance))


def precision_recall_f1(tp: Column, fp: Column, fn: Column, zero_f1: bool = False) -> tuple[Column, Column, Column]:
    """Undefined ratios are null; F1 of precision and recall both 0 is null, or 0 with ``zero_f1``."""
    p, r = F.try_divide(tp.cast("double"), tp + fp), F.try_divide(tp.cast("double"), tp + fn)
    f = F.try_divide(2 * p * r, p + r)
    return p, r, F.when((p == 0) & (r == 0), F.lit(0.0)).otherwise(f) if zero_f1 else f


def bh_qvalues(tests: DataFrame, p: str, family: Sequence[str], tie: str) -> DataFrame:
    """``tests`` with ``rank`` and ``q``: Benjamini-Hochberg values within each family."""
    up = Window.partitionBy(*family).orderBy(p, tie)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    ranked = tests.withColumn("rank", F.row_number().over(up)).withColumn("_r", F.col(p) * m / F.col("rank"))
    q = F.min("_r").over(Window.partitionBy(*family).orderBy("rank").rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumn("q", F.least(F.lit(1.0), q)).drop("_r")


# --- exact tests (Arrow batches) ------------------------------------------------


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """P of all tables with these margins that are no likelier than (a, b; c, d)."""
    row, col, n = a + b, a + c, a + b + c + d
    log_p = [_log_choose(col, x) + _log_choose(n - col, row - x) - _log_choose(n, row) for x in range(max(0, row + col - n), min(row, col) + 1)]
    seen = log_p[a - max(0, row + col - n)]
    return min(1.0, math.fsum(math.exp(v) for v in log_p if v <= seen + 1e-7))


def mcnemar_exact(b: int, c: int) -> tuple[float, float]:
    """Two-sided exact binomial p of b against c, and its log10 (not capped at 0)."""
    n, k = b + c, min(b, c)
    if not n:
        return 1.0, 0.0
    terms = [_log_choose(n, i) - n * math.log(2) for i in range(k + 1)]
    top = max(terms)
    log_p = math.log(2) + top + math.log(math.fsum(math.exp(t - top) for t in terms))
    return min(1.0, math.exp(log_p)), log_p / math.log(10)


@F.pandas_udf(DoubleType())
def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype="float64")


@F.pandas_udf(StructType([StructField("p", DoubleType()), StructField("log10_p", DoubleType())]))
def mcnemar(b: pd.Series, c: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([mcnemar_exact(int(x), int(y)) for x, y in zip(b, c, strict=True)], columns=["p", "log10_p"])


# --- resampling -----------------------------------------------------------------


def mean_difference_p(a: Sequence[float], b: Sequence[float], draws: int, seed: int) -> tuple[float, int]:
    """Observed difference of means and how many shuffles reach it in size."""
    pool, n = np.array([*a, *b], float), len(a)
    observed = pool[:n].mean() - pool[n:].mean()
    rng, order, hits = random.Random(seed), list(range(len(pool))), 0
    for _ in range(draws):
        rng.shuffle(order)
        x = pool[order]
        hits += abs(x[:n].mean() - x[n:].mean()) >= abs(observed) - 1e-12
    return float(observed), hits


def did_p(a: np.ndarray, b: np.ndarray, draws: int, seed: int) -> tuple[float, int]:
    """The same for the difference of gains; rows are clusters (before, after) and move whole."""
    gain = np.concatenate([a, b])
    gain = gain[:, 1] - gain[:, 0]
    return mean_difference_p(gain[: len(a)], gain[len(a) :], draws, seed)


def dirichlet_bootstrap(tp: np.ndarray, fp: np.ndarray, fn: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """precision, recall, f1 (nan where undefined) of each draw of cluster weights."""
    w = np.random.default_rng(seed).dirichlet(np.ones(len(tp)), draws)
    t, p, n = w @ tp, w @ fp, w @ fn
    with np.errstate(invalid="ignore", divide="ignore"):
        precision, recall = t / (t + p), t / (t + n)
        f1 = np.where(t > 0, 2 * precision * recall / (precision + recall), 0.0)
    f1[np.isnan(precision) | np.isnan(recall)] = np.nan
    return np.stack([precision, recall, f1], axis=1)
