"""Drift bindings on the driver tables (DR8, DR10) and the log-vs-reference job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators import drift as D
from riskframe.plans.tables import Tables


def events_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    """reference = events before 2024-01-16, production = from that day on."""
    e = t.events.select(
        "ts", "event_type", "value", "user_id",
        F.get_json_object("props", "$.k").alias("k"),
        F.when(F.col("value") < 10, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value_ge10"),
    )
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return e.filter(F.col("ts") < cut).drop("ts"), e.filter(F.col("ts") >= cut).drop("ts")


def orders_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    """reference = orders before 2000-01-01, production = from then on."""
    o = t.orders.select("o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey")
    cut = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    return (o.filter(F.col("o_orderdate") < cut).drop("o_orderdate"),
            o.filter(F.col("o_orderdate") >= cut).drop("o_orderdate"))


def drift_report_events(t: Tables, bins: int = 10, top_k: int = 30) -> DataFrame:
    ref, prod = events_sides(t)
    return D.compute_drift(ref, prod, bins, top_k)


def drift_report_orders(t: Tables, bins: int = 10, top_k: int = 30) -> DataFrame:
    ref, prod = orders_sides(t)
    return D.compute_drift(ref, prod, bins, top_k)


def log_vs_reference(t: Tables, ref_n: int = 1000, prod_limit: int = 2000, bins: int = 10, top_k: int = 30) -> DataFrame:
    """DR10 on the driver tables: reference = hash sample (SMP1) of events
    before the cut, production = payloads of the latest log rows (SRC4, the
    events table read as a log: id = event_id, payload = props)."""
    from riskframe.operators.sampling import sample_n
    from riskframe.sources.predlog import load_prod_features
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    ref = sample_n(t.events.filter(F.col("ts") < cut), "event_id", ref_n).select(
        F.get_json_object("props", "$.k").alias("k"), "value", "event_type")
    prod = load_prod_features(t.events, prod_limit, order_cols=("event_id",), json_col="props")
    return D.compute_drift(ref, prod, bins, top_k)
