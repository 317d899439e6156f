"""EV1-EV10 on the FIXTURES toy table and properties on driver data."""

import math

import pytest
from pyspark.sql import functions as F

from riskframe.operators import metrics as M

Y = [0, 0, 1, 1, 0, 1]
P = [.1, .2, .2, .6, .7, .9]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(list(zip(Y, P)), "y int, p double")


def test_auc_ap_toy(toy):
    r = M.auc_ap(toy).first()
    assert math.isclose(r.auc, 0.7222222222222222, rel_tol=1e-12)
    assert math.isclose(r.ap, 0.7555555555555555, rel_tol=1e-12)


def test_pr_curve_toy(toy):
    rows = {r.threshold: (r.precision, r.recall) for r in M.pr_curve(toy).collect()}
    assert rows[None] == (1.0, 0.0)
    exp = {.1: (.5, 1), .2: (.6, 1), .6: (2 / 3, 2 / 3), .7: (.5, 1 / 3), .9: (1, 1 / 3)}
    for t, (pr, rc) in exp.items():
        assert math.isclose(rows[t][0], pr) and math.isclose(rows[t][1], rc)


@pytest.mark.parametrize("target,shift,expected", [(.6, False, .6), (.6, True, .2), (.9, False, .2), (.9, True, .1)])
def test_threshold_for_recall(toy, target, shift, expected):
    r = M.threshold_for_recall(toy, target, shift_compat=shift).first()
    assert math.isclose(r.threshold, expected)


def test_cost_curve_toy(toy):
    best = M.best_cost_threshold(toy).first()
    assert best.threshold == 0.10110552763819096
    assert best.total_cost == 2.0
    assert math.isclose(best.avg_cost, 1 / 3)


def test_cost_curve_matches_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    p = np.round(rng.random(400), 3)
    p[:20] = np.linspace(0.01, 0.5, 200)[::10]  # scores exactly on grid points
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    got = {r.idx: r.total_cost for r in M.cost_curve(df).collect()}
    for i, t in enumerate(np.linspace(0.01, 0.5, 200)):
        pred = p >= t
        exp = 1.0 * np.sum(pred & (y == 0)) + 10.0 * np.sum(~pred & (y == 1))
        assert got[i] == exp


def test_auc_properties(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    p = np.round(rng.random(300), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    a1 = M.auc_ap(df).first().auc
    a2 = M.auc_ap(df.withColumn("p", -F.col("p"))).first().auc
    assert math.isclose(a1 + a2, 1.0, rel_tol=1e-12)
    # brute force pair count
    pos, neg = p[y == 1], p[y == 0]
    exp = (np.sum(pos[:, None] > neg[None, :]) + 0.5 * np.sum(pos[:, None] == neg[None, :])) / (len(pos) * len(neg))
    assert math.isclose(a1, exp, rel_tol=1e-12)


def test_binary_metrics_toy(toy):
    m = M.metrics_dict(toy, 0.5)
    # pred = p >= .5 -> 0,0,0,1,1,1 ; tp=2 fp=1 fn=1 tn=2
    assert math.isclose(m["precision"], 2 / 3) and math.isclose(m["recall"], 2 / 3)
    assert math.isclose(m["accuracy"], 4 / 6) and math.isclose(m["bal_acc"], 2 / 3)
    assert math.isclose(m["pred_pos_rate"], .5)
