"""Prediction-log statistics (AGG6, AGG7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import q
from riskframe.operators.ordered import null_safe_join, order_statistic

P95 = 0.95


def latency_summary(log: DataFrame, group_cols=("model_version",), latency_col: str = "latency_ms") -> DataFrame:
    """AGG6: mean and p95 per group, p95 = the sorted element at
    ``int(0.95 * (n - 1))`` (not an interpolated or ``percentile_disc`` value)."""
    g = list(group_cols)
    mean = log.groupBy(*[q(c) for c in g]).agg(F.avg(F.col(q(latency_col)).cast("double")).alias("mean"),
                                               F.count(F.col(q(latency_col))).alias("n"))
    p95 = order_statistic(log, g, latency_col, lambda n: F.floor(F.lit(P95) * (n - 1))).select(
        *[q(c) for c in g], F.col("value").cast("double").alias("p95"))
    return null_safe_join(mean, p95, g, "left")


def positive_rate(log: DataFrame, group_cols=("model_version",), decision_col: str = "decision") -> DataFrame:
    """AGG7: share of positive decisions per group."""
    return log.groupBy(*[q(c) for c in group_cols]).agg(
        F.avg(F.col(q(decision_col)).cast("double")).alias("pred_pos_rate"), F.count(F.lit(1)).alias("n"))
