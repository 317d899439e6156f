"""Scoring (SC1-SC6).

Two model forms:
* ``LinearModel``: coefficients held as plain numbers; the score is one
  JVM expression over arrays (imputation, scaling and the dot product), of
  the same depth for any number of features, with no vector assembly;
* any fitted ``pyspark.ml`` model with a probability column (trees, GBT):
  ``model.transform`` and ``vector_to_array(probability)[1]``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import q


def sigmoid(s: Column) -> Column:
    """SC2: 1 / (1 + exp(-s))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-s))


@dataclass
class LinearModel:
    features: list[str]
    coefs: list[float]
    intercept: float = 0.0
    impute: dict[str, float] = field(default_factory=dict)   # ML1 medians
    center: dict[str, float] = field(default_factory=dict)   # ML2 means (with_mean)
    scale: dict[str, float] = field(default_factory=dict)    # ML2 population std (0 -> 1)
    threshold: float = 0.5
    model_version: str = "linear-v1"

    def margin(self) -> Column:
        """intercept + sum of coefficient x scaled value, in model order; one higher-order function over literal arrays."""
        terms = [{"w": float(w), "impute": self.impute.get(f), "center": float(self.center.get(f, 0.0)), "scale": float(self.scale.get(f, 1.0))}
                 for f, w in zip(self.features, self.coefs)]
        table = F.from_json(F.lit(json.dumps(terms)), "array<struct<w:double,impute:double,center:double,scale:double>>")
        values = F.expr("array(" + ", ".join(f"cast({q(f)} as double)" for f in self.features) + ")")
        parts = F.zip_with(values, table, lambda x, t: (F.coalesce(x, t["impute"]) - t["center"]) / t["scale"] * t["w"])
        return F.aggregate(parts, F.lit(float(self.intercept)), lambda total, x: total + x)

    def probability(self) -> Column:
        return sigmoid(self.margin())


def decision(p: Column, threshold: float) -> Column:
    """SC3: p >= threshold."""
    return (p >= F.lit(float(threshold))).cast("int")


def ml_probability(model, df: DataFrame, prob_col: str = "probability") -> DataFrame:
    """SC1: positive-class probability of a fitted ``pyspark.ml`` model."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    if prob_col not in out.columns:
        raise AttributeError(f"{type(model).__name__} gives no probability column")
    return out.withColumn("proba_default", vector_to_array(F.col(prob_col))[1])
