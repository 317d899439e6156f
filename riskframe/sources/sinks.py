"""Sinks (SNK1, SNK4, SNK5, SNK7).  SNK2/SNK3/SNK6 live with the prediction log."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators.sampling import sample_n


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """SNK1: feature tables (Parquet by default, CSV with a header on request)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_drift_report(doc: DataFrame, path: str, per_feature: DataFrame | None = None) -> None:
    """SNK4: the one-row report document as JSON (one small file) and,
    optionally, the per-feature rows as Parquet next to it."""
    doc.coalesce(1).write.mode("overwrite").json(f"{path}/report")
    if per_feature is not None:
        per_feature.write.mode("overwrite").parquet(f"{path}/features")


def write_reference_sample(df: DataFrame, key: str, path: str, n: int = 1000, seed: int = 42) -> None:
    """SNK5: min(n, rows) rows by hash order, as CSV with a header."""
    sample_n(df, key, n, seed).write.mode("overwrite").option("header", True).csv(path)


def write_requested_config(spark: SparkSession, report: DataFrame, path: str, extra: dict | None = None) -> None:
    """SNK7: requested-keys report (one row) as JSON."""
    out = report
    for k, v in (extra or {}).items():
        out = out.withColumn(k, F.lit(json.dumps(v) if isinstance(v, (dict, list)) else v))
    out.coalesce(1).write.mode("overwrite").json(path)
