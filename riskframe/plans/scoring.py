"""Batch and single-row scoring with the prediction log (SC4-SC6, SNK2/3).

Binding on the driver tables: each order is one compact scoring request
(groups O_ORDERPRIORITY / O_ORDERSTATUS, a yes/no flag, numbers as text, some
with a decimal comma, some keys unknown).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.align import FeatureSpec, RequestedRule, align_rows, split_batch
from riskframe.operators.score import LinearModel, decision
from riskframe.plans.tables import Tables
from riskframe.sources.predlog import json_safe_payload

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]
ORDER_FEATURES = (["O_TOTALPRICE", "O_CUSTKEY", "FLAG_URGENT"]
                  + [f"O_ORDERPRIORITY_{p}" for p in PRIORITIES] + [f"O_ORDERSTATUS_{s}" for s in STATUSES])
ORDER_GROUPS = ("O_ORDERPRIORITY", "O_ORDERSTATUS")


def order_spec() -> FeatureSpec:
    return FeatureSpec.of(ORDER_FEATURES, ORDER_GROUPS)


def order_model() -> LinearModel:
    """A fixed linear scorer (model parameters, not data)."""
    coefs = [2e-6, -1e-5, 0.4, 0.3, 0.2, 0.0, -0.1, -0.2, 0.1, 0.0, -0.1]
    return LinearModel(ORDER_FEATURES, coefs, intercept=-0.7,
                       impute={"O_TOTALPRICE": 150000.0, "O_CUSTKEY": 0.0, "FLAG_URGENT": 0.0,
                               **{f: 0.0 for f in ORDER_FEATURES[3:]}},
                       threshold=0.5, model_version="orders-linear-v1")


def compact_order_rows(t: Tables) -> DataFrame:
    """(row_index, features map<string,string>) built from every order."""
    o = t.orders
    price = F.col("o_totalprice").cast("string")
    price_txt = (F.when(F.col("o_totalprice") > 400000, F.lit(None).cast("string"))
                 .when(F.col("o_orderstatus") == "P", F.regexp_replace(price, r"\.", ","))
                 .otherwise(price))
    prio_txt = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("  "), F.upper("o_orderpriority"), F.lit(" ")))\
        .otherwise(F.col("o_orderpriority"))
    flag = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("oui")).otherwise(F.lit("non"))
    base = F.create_map(
        F.lit("O_TOTALPRICE"), price_txt,
        F.lit("O_CUSTKEY"), F.col("o_custkey").cast("string"),
        F.lit("FLAG_URGENT"), flag,
        F.lit("O_ORDERPRIORITY"), prio_txt,
        F.lit("O_ORDERSTATUS"), F.col("o_orderstatus"),
    )
    extra = F.create_map(F.lit("EXTRA_KEY"), F.lit("1"))
    feats = F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "F"), F.map_concat(base, extra))\
        .otherwise(base)
    return o.select(F.col("o_orderkey").alias("row_index"), feats.alias("features"))


def faulty_order_rows(t: Tables) -> DataFrame:
    """Every order as a request, some of them wrong in each way that the checks know: an unreadable request (status P, urgent),
    unknown keys, an unknown category, an unreadable number, an unreadable flag, too few filled keys."""
    status, priority, price = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
    of = lambda s, p: (status == s) & (priority == p)
    features = F.create_map(
        F.lit("O_TOTALPRICE"), F.when(of("O", "3-MEDIUM"), F.lit("n/a?")).when(price <= 400000, price.cast("string")),
        F.lit("O_CUSTKEY"), F.col("o_custkey").cast("string"),
        F.lit("FLAG_URGENT"), F.when(of("F", "2-HIGH"), F.lit("maybe")).when(priority == "1-URGENT", F.lit("oui")).otherwise(F.lit("non")),
        F.lit("O_ORDERPRIORITY"), F.when(of("O", "4-NOT SPECIFIED"), F.lit("6-NEVER")).otherwise(priority),
        F.lit("O_ORDERSTATUS"), status)
    extra = F.map_concat(features, F.create_map(F.lit("EXTRA_KEY"), F.lit("1"), F.lit("A_KEY"), F.lit("2")))
    return t.orders.select(F.col("o_orderkey").alias("row_index"),
                           F.when(of("F", "5-LOW"), extra).when(~of("P", "1-URGENT"), features).alias("features"))


def order_rule() -> RequestedRule:
    return RequestedRule(["O_TOTALPRICE", "O_ORDERPRIORITY", "O_ORDERSTATUS"], 1.0)


def aligned_orders(t: Tables, strict: bool = True) -> DataFrame:
    return align_rows(compact_order_rows(t), order_spec(), strict=strict, rule=order_rule())


def score_aligned(aligned: DataFrame, model: LinearModel) -> DataFrame:
    p = model.probability()
    return aligned.select("*", p.alias("proba_default")).withColumn(
        "decision", decision(F.col("proba_default"), model.threshold))


def prediction_log_rows(scored: DataFrame, model: LinearModel, deterministic: bool = False) -> DataFrame:
    """SC4 log rows (F1 schema).  ``uuid()`` and the clock are not
    deterministic; ``deterministic=True`` replaces them for checks."""
    rid = F.col("row_index").cast("string") if deterministic else F.expr("uuid()")
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp") if deterministic else F.current_timestamp()
    return scored.select(
        F.col("row_index").cast("long").alias("log_seq"), ts.alias("ts_utc"), rid.alias("request_id"),
        F.lit(model.model_version).alias("model_version"), "proba_default",
        F.lit(float(model.threshold)).alias("threshold"), "decision",
        F.lit(0.0).alias("latency_ms"), json_safe_payload(model.features).alias("input_json"))


def predict_batch(rows: DataFrame, spec: FeatureSpec, model: LinearModel, rule: RequestedRule | None = None,
                  strict: bool = True, deterministic: bool = False) -> tuple[DataFrame, DataFrame]:
    """SC4/SC5/SC6: align -> validate -> score -> log rows; returns
    (log rows of accepted inputs, rejected inputs with reasons)."""
    aligned = align_rows(rows, spec, strict=strict, rule=rule)
    ok, bad = split_batch(aligned)
    return prediction_log_rows(score_aligned(ok, model), model, deterministic), \
        bad.select("row_index", "reject_reason", "reject_detail")
