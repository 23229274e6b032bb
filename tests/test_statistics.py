import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphtrail.functions import statistics as S
from glyphtrail.operators import corpus, pairs, validation


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def lits(*values):
    return [F.lit(v) for v in values]


@pytest.mark.parametrize("k,n,low,high", [(35, 60, 0.457, 0.699), (0, 30, 0.0, 0.114), (60, 60, 0.94, 1.0)])
def test_wilson(spark, k, n, low, high):
    got = one(spark, *S.wilson(*lits(k, n)))
    assert [round(v, 3) for v in got] == [low, high]



def test_two_proportions(spark):
    low, high = one(spark, *S.newcombe(*lits(35, 60, 1, 30)))
    assert (round(low, 3), round(high, 3)) == (0.366, 0.669)
    got = one(spark, *S.odds_ratio(*lits(35, 25, 1, 29)))
    assert [round(v, 1) for v in got] == [27.4, 4.9, 152.5]


def test_exact_tests(spark):
    assert S.fisher_two_sided(35, 25, 1, 29) == pytest.approx(1.4307374804577426e-07, rel=1e-9)
    p, log10 = S.mcnemar_exact(1768, 1634)
    assert p == pytest.approx(0.02257832901081835, rel=1e-9) and log10 == pytest.approx(-1.6463082027237264, rel=1e-9)
    assert S.mcnemar_exact(183, 162)[0] == pytest.approx(0.28156768154478895, rel=1e-9)
    assert S.mcnemar_exact(2478, 2098)[0] == pytest.approx(2.0730316802228153e-08, rel=1e-9)
    assert S.mcnemar_exact(0, 0) == (1.0, 0.0)
    assert one(spark, S.fisher(*lits(35, 25, 1, 29)))[0] == pytest.approx(1.4307374804577426e-07, rel=1e-9)
    assert one(spark, S.mcnemar(*lits(1768, 1634)))[0].p == pytest.approx(0.02257832901081835, rel=1e-9)


def plain_bh(ps):
    order = sorted(range(len(ps)), key=ps.__getitem__)
    out, low = [0.0] * len(ps), 1.0
    for rank in range(len(ps), 0, -1):
        low = min(low, ps[order[rank - 1]] * len(ps) / rank)
        out[order[rank - 1]] = low
    return out


def test_bh(spark):
    draw = random.Random(2)
    ps = [round(draw.random() ** 3, 4) for _ in range(40)]
    rows = spark.createDataFrame([("f", f"{i:02d}", p) for i, p in enumerate(ps)], "family string, name string, p double")
    got = {r.name: r.q for r in S.bh_qvalues(rows, "p", ["family"], "name").collect()}
    assert [got[f"{i:02d}"] for i in range(40)] == pytest.approx(plain_bh(ps))


def test_bh_published_family(spark):
    """The value published for rank 10 of 28 tests."""
    p = 0.0015998400159984002
    ps = [p / 20] * 9 + [p] + [0.9] * 18
    rows = spark.createDataFrame([("f", f"{i:02d}", v) for i, v in enumerate(ps)], "family string, name string, p double")
    assert S.bh_qvalues(rows, "p", ["family"], "name").filter("name = '09'").first().q == pytest.approx(0.004479552044795521)


def test_metrics_and_kappa(spark):
    p, r, f = one(spark, *S.precision_recall_f1(*lits(2, 7, 2)))
    assert (round(p, 3), r, round(f, 3)) == (0.222, 0.5, 0.308)
    assert one(spark, *S.precision_recall_f1(*lits(0, 1, 1)))[2] is None
    assert one(spark, *S.precision_recall_f1(*lits(0, 1, 1), zero_f1=True))[2] == 0.0
    assert one(spark, S.kappa(*lits(20, 5, 10, 15)))[0] == pytest.approx(0.4)
    assert one(spark, S.kappa(*lits(0, 0, 0, 9)))[0] is None


def test_plus_one_and_permutations():
    observed, hits = S.mean_difference_p([1, 1, 1, 1], [0, 0, 0, 0], 2000, 1)
    assert observed == 1 and 10 < hits < 120  # 2 of 70 orders
    assert S.mean_difference_p([1, 1, 1, 1], [0, 0, 0, 0], 2000, 1) == (observed, hits)
    assert S.mean_difference_p([1, 0], [1, 0], 200, 1)[1] == 200
    a, b = np.array([[0.0, 1.0]] * 5), np.array([[0.0, 0.0]] * 5)
    assert S.did_p(a, b, 500, 3)[0] == 1.0


def test_bootstrap_covers_the_point():
    tp, fp, fn = (np.array(v, float) for v in ([2, 3, 4, 0], [1, 0, 2, 1], [0, 1, 1, 2]))
    draws = S.dirichlet_bootstrap(tp, fp, fn, 4000, 7)
    assert draws.shape == (4000, 3)
    point = tp.sum() / (tp.sum() + fp.sum())
    assert np.nanquantile(draws[:, 0], 0.025) < point < np.nanquantile(draws[:, 0], 0.975)
    assert np.isnan(S.dirichlet_bootstrap(*[np.zeros(3)] * 3, 5, 1)).all()


def test_leave_one_out_published(spark):
    rows = spark.createDataFrame([("a b c", 3, 9, 10), ("d e f", 3, 1, 10), ("g h i", 3, 2, 10)], "phrase string, n_words int, v int, z int")
    got = corpus.leave_one_out(rows, "v").first()
    assert (got.mean, got.mean_without, got.dominant) == (4.0, 1.5, "a b c")


def test_role_scoping_counts_conversations(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "Of THE of the"), (1, 1, "assistant", "no"), (2, 0, "assistant", "of the"), (2, 1, "assistant", "of the"), (3, 0, "user", None)],
        "conv_id long, turn long, role string, text string",
    )
    got = {r.phrase: r for r in corpus.role_scoping(turns, [("x", "of the"), ("x", "zzz")]).collect()}
    assert (got["of the"].blob, got["of the"].assistant, got["of the"].inflation) == (2, 1, 2.0)
    assert (got["zzz"].blob, got["zzz"].assistant, got["zzz"].inflation) == (0, 0, None)
    empty = corpus.role_scoping(turns.limit(0), [("x", "of the")]).first()
    assert (empty.blob, empty.assistant) == (0, 0)


def test_pairs(spark):
    rows = spark.createDataFrame([(1, "a x a", "b"), (2, "b", "a"), (3, "a", "a"), (4, "", "")], "conv_id long, chosen_text string, rejected_text string")
    c = pairs.contingency(rows, {"f": ["a"]}).first()
    assert (c.chosen_any, c.rejected_any, c.chosen_only, c.rejected_only, c.both, c.chosen_occ, c.rejected_occ, c.n_pairs) == (2, 2, 1, 1, 1, 3, 2, 4)
    e = pairs.effects(pairs.contingency(rows, {"f": ["a"]})).first()
    assert e.matched_odds_ratio_ha == 1.0 and math.isclose(e.chosen_per_million_words, 1e6 * 3 / 5)


def test_coverage_problems(spark):
    a = spark.createDataFrame([(1,), (2,)], "k long")
    b = spark.createDataFrame([(2,), (2,), (3,)], "k long")
    got = {(r.k, r.problem) for r in validation.coverage(a, b, "k").collect()}
    assert got == {(1, "missing"), (3, "unexpected"), (2, "repeated")}


def test_as_many_draws_as_the_reference():
    from glyphtrail.plans import validation_queries

    assert validation_queries.DRAWS == 10_000
