"""Feature selection by cumulative importance (WIN1, WIN2, ML13, ML14).

The importance table has one row per model feature (hundreds to thousands of
rows), so the cumulative sum is a single-partition window over that small
table, by design.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators.align import FeatureSpec


def cumulative_importance(imp: DataFrame) -> DataFrame:
    """WIN1: importance normalised by its total (equal weights when the total
    is <= 0), cumulated in descending importance order (ties by feature)."""
    w_all = Window.partitionBy()
    d = imp.withColumn("_total", F.sum("importance").over(w_all)).withColumn("_n", F.count(F.lit(1)).over(w_all))
    d = d.withColumn("importance_norm", F.when(F.col("_total") > 0, F.col("importance") / F.col("_total"))
                     .otherwise(F.lit(1.0) / F.col("_n")))
    w = Window.orderBy(F.desc("importance"), "feature").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.select("feature", "importance", "importance_norm", F.sum("importance_norm").over(w).alias("cum"),
                    F.row_number().over(Window.orderBy(F.desc("importance"), "feature")).alias("rank"))


def select_by_cumulative(imp: DataFrame, target: float = 0.80) -> DataFrame:
    """WIN2: features up to and including the first one whose cumulative share
    reaches ``target`` (all features when none does)."""
    c = cumulative_importance(imp)
    stop = c.filter(F.col("cum") >= F.lit(float(target))).agg(F.min("rank")).scalar()
    return c.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.col("rank") <= F.col("_stop"))).drop("_stop")


def min_rate_from_ratio(ratio: F.Column) -> F.Column:
    """ML14: > 0.5 -> 0 (rule off); < 0.1 -> 0.3; < 0.2 -> 0.4; else 0.5."""
    return (F.when(ratio > 0.5, F.lit(0.0)).when(ratio < 0.1, F.lit(0.3))
            .when(ratio < 0.2, F.lit(0.4)).otherwise(F.lit(0.5)))


def requested_keys(imp: DataFrame, spec: FeatureSpec, target: float = 0.80) -> DataFrame:
    """ML13: selected features kept if in the model, dummies mapped to their
    group, distinct and sorted; plus the ML14 rate (SNK7 report shape)."""
    sel = select_by_cumulative(imp, target).filter(F.col("feature").isin(*spec.features))
    dg = spec.group_of()
    group_of = F.create_map(*[x for c, g in sorted(dg.items()) for x in (F.lit(c), F.lit(g))]) if dg else None
    key = F.coalesce(F.try_element_at(group_of, F.col("feature")), F.col("feature")) if dg else F.col("feature")
    keys = sel.select(key.alias("key")).distinct()
    n_allowed = len(spec.allowed_keys())
    report = keys.agg(F.array_sort(F.collect_list("key")).alias("requested_groups"))
    ratio = F.size("requested_groups") / F.lit(float(max(n_allowed, 1)))
    return report.select("requested_groups", F.size("requested_groups").alias("n_requested"),
                         F.lit(n_allowed).alias("n_allowed"), ratio.alias("ratio"),
                         min_rate_from_ratio(ratio).alias("min_filled_rate_requested"))
