"""Ordered scans without a single-task window (WIN3 and exact quantiles).

A cumulative sum over a global order (``sum() over (order by x)``) moves every
row to one task.  Here the order is cut into buckets first:

1. the input (one row per distinct order value and group) is checkpointed, so
   every later step sees the same rows;
2. per group, approximate quantiles of the order key are the bucket bounds, so
   buckets hold about equally many values whatever the distribution; the
   bounds are checkpointed too (groups x buckets numbers at most);
3. per (group, bucket) totals and their running sum (a small table) give each
   bucket's offset;
4. a window partitioned by (group, bucket) adds the running sum inside.

Results are exact: the bounds only spread the work.  Callers pre-aggregate by
value, so ties never split and a hot value is a single row.  Groups may be
NULL (a group of its own); rows with a NULL order value take no part.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.expr import q
from riskframe.session import cut_lineage

#: Buckets per group; the bounds are searched in two steps of its square root.
N_BUCKETS = 1024
_STEP = 32


def null_safe_join(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Join on equal ``cols`` where NULL equals NULL; the columns appear once."""
    renamed = right.select(*[F.col(q(c)).alias(f"__j{i}") for i, c in enumerate(cols)],
                           *[F.col(q(c)) for c in right.columns if c not in cols])
    condition = F.lit(True)
    for i, c in enumerate(cols):
        condition = condition & F.col(q(c)).eqNullSafe(F.col(f"__j{i}"))
    return left.join(renamed, condition, how).drop(*[f"__j{i}" for i in range(len(cols))])


def _bucketed(df: DataFrame, order_col: str, sum_cols: list[str], groups: list[str], descending: bool) -> tuple[DataFrame, DataFrame]:
    """The rows with key ``_k`` and bucket ``_b``, and per (group, bucket) the totals ``_t_i`` and offsets ``_o_i``."""
    key = F.col(q(order_col)).cast("double")
    names = [q(c) for c in groups]
    work = cut_lineage(df.withColumn("_k", -key if descending else key).where(F.col("_k").isNotNull()))
    probs = [i / N_BUCKETS for i in range(1, N_BUCKETS)]
    bounds = work.groupBy(*names).agg(F.array_distinct(F.percentile_approx("_k", probs, 10 * N_BUCKETS)).alias("_ord_bounds"))
    if groups:
        work = null_safe_join(work, cut_lineage(bounds), groups)
    else:
        found = bounds.first()["_ord_bounds"] or []
        work = work.withColumn("_ord_bounds", F.from_json(F.lit(json.dumps(found)), "array<double>"))
    coarse = F.expr(f"size(filter(sequence(0, {_STEP} - 1), i -> get(_ord_bounds, i * {_STEP}) < _k))")
    work = work.withColumn("_ord_c", F.greatest(coarse - 1, F.lit(0)) * _STEP)
    work = work.withColumn("_b", F.expr(f"_ord_c + size(filter(slice(_ord_bounds, _ord_c + 1, {_STEP}), x -> x < _k))")).drop("_ord_bounds", "_ord_c")
    totals = work.groupBy(*names, "_b").agg(*[F.sum(F.col(q(c))).alias(f"_t_{i}") for i, c in enumerate(sum_cols)])
    before = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*names, "_b", *[f"_t_{i}" for i in range(len(sum_cols))],
                           *[F.coalesce(F.sum(f"_t_{i}").over(before), F.lit(0)).alias(f"_o_{i}") for i in range(len(sum_cols))])
    return work, totals


def ordered_cumsum(df: DataFrame, order_col: str, sum_cols: list[str], group_cols: list[str] | tuple = (),
                   descending: bool = False, prefix: str = "cum_", keep_bucket: bool = False) -> DataFrame:
    """Add inclusive running sums ``{prefix}{c}`` of ``sum_cols`` in the order of
    ``order_col`` within each group.  ``df`` must hold one row per
    (group, order value)."""
    groups = list(group_cols)
    work, totals = _bucketed(df, order_col, sum_cols, groups, descending)
    work = null_safe_join(work, totals, [*groups, "_b"])
    inside = Window.partitionBy(*[q(c) for c in groups], "_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return work.select(*[F.col(q(c)) for c in df.columns], *(["_b"] if keep_bucket else []),
                       *[(F.col(f"_o_{i}") + F.sum(F.col(q(c))).over(inside)).alias(f"{prefix}{c}") for i, c in enumerate(sum_cols)])


def value_counts(long_df: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """(group, value, _n) for non-null values; map-side combined."""
    return (long_df.filter(F.col(q(value_col)).isNotNull())
            .groupBy(*[q(c) for c in group_cols], q(value_col)).agg(F.count(F.lit(1)).alias("_n")))


def values_at_ranks(counts: DataFrame, groups: list[str], value_col: str, ranks: DataFrame) -> DataFrame:
    """``ranks`` (group columns, ``_rank`` and others) with ``_value``: the value at that 0-based ascending rank of its group.

    Offsets tell the bucket of each rank; only buckets that hold a wanted rank are ordered."""
    work, totals = _bucketed(counts, value_col, ["_n"], groups, False)
    placed = null_safe_join(ranks, totals, groups).filter(
        (F.col("_rank") >= F.col("_o_0")) & (F.col("_rank") < F.col("_o_0") + F.col("_t_0"))).drop("_t_0")
    wanted = placed.select(*[q(c) for c in groups], "_b", F.col("_o_0").alias("_from")).distinct()
    inside = Window.partitionBy(*[q(c) for c in groups], "_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = null_safe_join(work, wanted, [*groups, "_b"]).select(
        *[q(c) for c in groups], "_b", F.col(q(value_col)).alias("_value"), F.col("_n").alias("_cell"),
        (F.col("_from") + F.sum("_n").over(inside)).alias("_upto"))
    return null_safe_join(placed, cells, [*groups, "_b"]).filter(
        (F.col("_rank") >= F.col("_upto") - F.col("_cell")) & (F.col("_rank") < F.col("_upto"))).drop("_b", "_o_0", "_cell", "_upto")


def exact_quantiles(long_df: DataFrame, group_cols: list[str], value_col: str, probs: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group.

    Returns (group..., q_index, prob, quantile, n).  NULLs are ignored; a
    group without values gives no rows.  No state grows with a group's size:
    a hot or high-cardinality group is spread over many tasks.
    """
    groups = list(group_cols) or ["_g"]
    base = long_df if group_cols else long_df.withColumn("_g", F.lit(0))
    counts = cut_lineage(value_counts(base, groups, value_col))
    names = [q(c) for c in groups]
    sizes = counts.groupBy(*names).agg(F.sum("_n").alias("n"))
    rows = F.array(*[F.struct(F.lit(i).alias("q_index"), F.lit(float(p)).alias("prob")) for i, p in enumerate(probs)])
    # NumPy linear method: virtual index h = (n-1)*p, lerp between ranks floor(h), floor(h)+1
    targets = sizes.select(*names, "n", F.inline(rows)).withColumn("_h", (F.col("n") - 1) * F.col("prob"))
    targets = targets.withColumn("_j", F.floor("_h").cast("long")).withColumn("_t", F.col("_h") - F.col("_j"))
    ranks = targets.select(*names, "n", "q_index", "prob", "_t", F.inline(F.array(
        F.struct(F.lit(0).alias("_side"), F.col("_j").alias("_rank")),
        F.struct(F.lit(1).alias("_side"), F.least(F.col("_j") + 1, F.col("n") - 1).alias("_rank")))))
    hits = values_at_ranks(counts, groups, value_col, ranks)
    side = lambda s: F.max(F.when(F.col("_side") == s, F.col("_value").cast("double")))
    res = hits.groupBy(*names, "q_index", "prob", "n", "_t").agg(side(0).alias("_a"), side(1).alias("_bv"))
    a, b, t = F.col("_a"), F.col("_bv"), F.col("_t")
    # NumPy's lerp: a + d*t below t=0.5, b - d*(1-t) from 0.5 on
    value = F.when(t >= 0.5, b - (b - a) * (F.lit(1.0) - t)).otherwise(a + (b - a) * t)
    out = res.select(*names, "q_index", "prob", value.alias("quantile"), "n")
    return out.drop("_g") if not group_cols else out


def order_statistic(df: DataFrame, group_cols: list[str], value_col: str, rank_of_n) -> DataFrame:
    """The value at 0-based ascending rank ``rank_of_n(n)`` per group (exact).

    ``rank_of_n`` maps the group's count column to the wanted rank, e.g.
    ``lambda n: F.floor(0.95 * (n - 1))`` for the reference's p95."""
    groups = list(group_cols)
    counts = cut_lineage(value_counts(df, groups, value_col))
    sizes = counts.groupBy(*[q(c) for c in groups]).agg(F.sum("_n").alias("n"))
    ranks = sizes.withColumn("_rank", rank_of_n(F.col("n")).cast("long"))
    return values_at_ranks(counts, groups, value_col, ranks).select(
        *[q(c) for c in groups], "n", "_rank", F.col("_value").alias("value"))
