"""Ordered scans under skew and outliers; NULL labels, groups and scores; operators without caps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import encode, logstats, metrics, ordered, sampling
from riskframe.operators.preprocess import class_weights
from riskframe.operators.profile import null_ratio_top


def test_outlier_does_not_fill_a_bucket(spark):
    rows = [(float(i) / 7, 1) for i in range(20_000)] + [(1e9, 1)]
    out = ordered.ordered_cumsum(spark.createDataFrame(rows, "x double, n int"), "x", ["n"], keep_bucket=True)
    sizes = [r["count"] for r in out.groupBy("_b").count().collect()]
    assert max(sizes) <= 3 * np.mean(sizes) and len(sizes) > 500
    got = [r.cum_n for r in out.orderBy("x").collect()]
    assert got == list(range(1, 20_002))


def test_groups_may_be_null_and_values_missing(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", None, "b"]), rng.choice([None, float(rng.randint(0, 50)), 1e12])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r.g, r.q_index): r.quantile for r in ordered.exact_quantiles(df, ["g"], "x", [0.0, 0.3, 0.5, 1.0]).collect()}
    for g in ("a", None, "b"):
        want = np.quantile([x for k, x in rows if k == g and x is not None], [0.0, 0.3, 0.5, 1.0])
        assert [got[g, i] for i in range(4)] == list(want)
    p95 = {r.model_version: r.p95 for r in logstats.latency_summary(df.withColumnsRenamed({"g": "model_version", "x": "latency_ms"})).collect()}
    for g in ("a", None, "b"):
        values = sorted(x for k, x in rows if k == g and x is not None)
        assert p95[g] == values[int(0.95 * (len(values) - 1))]


def test_null_scores_take_no_part(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1), (1, None), (None, 0.5)]
    df = spark.createDataFrame(rows, "y int, p double")
    clean = spark.createDataFrame(rows[:4], "y int, p double")
    for f in (metrics.auc_ap, metrics.score_curve, metrics.pr_curve, metrics.binary_metrics, lambda d: metrics.confusion(d, 0.5)):
        assert sorted(map(tuple, f(df).collect()), key=str) == sorted(map(tuple, f(clean).collect()), key=str)


def test_auc_of_more_pairs_than_a_long_holds(spark, monkeypatch):
    curve = spark.createDataFrame([(0.9, 4_000_000_000, 0, 4_000_000_000, 0), (0.1, 0, 4_000_000_000, 4_000_000_000, 4_000_000_000)],
                                  "threshold double, pos long, neg long, tp long, fp long").selectExpr(
        "*", "4000000000 as n_pos", "4000000000 as n_neg", "tp / (tp + fp) as precision", "tp / 4000000000 as recall")
    monkeypatch.setattr(metrics, "score_curve", lambda *a: curve)
    assert metrics.auc_ap(None).first()["auc"] == 1.0


def test_null_labels_are_a_class(spark):
    df = spark.createDataFrame([(i, [0, 1, None][i % 3] if i < 90 else 0) for i in range(150)], "k long, y int")
    assert sampling.stratified_split(df, "y", "k", 0.2).count() == 150
    folds = sampling.stratified_folds(df, "y", "k", 3)
    assert folds.count() == 150 and {r["count"] for r in folds.where("y is null").groupBy("fold").count().collect()} == {10}
    assert sampling.stratified_subset(df, "y", "k", 50).count() == 50
    under = {r.y: r["count"] for r in sampling.under_sample(df, "y", "k").groupBy("y").count().collect()}
    assert under == {0: 30, 1: 30, None: 30}
    weights = {r.y: r.weight for r in class_weights(df, "y").distinct().select("y", "weight").distinct().collect()}
    assert weights == {0: pytest.approx(150 / 270), 1: pytest.approx(150 / 90), None: pytest.approx(150 / 90)}


def test_vocabulary_has_no_limit_of_its_own(spark):
    df = spark.range(6000).select(F.concat(F.lit("v"), "id").alias("c"), F.when(F.col("id") % 2 == 0, "x").alias("d"))
    assert len(encode.vocabulary(df, ["c"])["c"]) == 6000
    assert encode.vocabulary_and_nulls(df, ["d"], max_categories=1) == ({"d": ["x"]}, {"d": True})
    with pytest.raises(ValueError):
        encode.vocabulary(df, ["c"], max_categories=100)


def test_null_ratio_is_descending(spark):
    df = spark.createDataFrame([(1, None, None), (1, 2, None)], "a int, b int, c int")
    assert [(r.column, r.null_ratio) for r in null_ratio_top(df, 2).collect()] == [("c", 1.0), ("b", 0.5)]
