"""Binary classification metrics on a (y, p) table (EV1-EV10, WIN3).

Everything is exact.  The score order is handled by ``ordered_cumsum`` on the
distinct scores (one row per score after a map-side combined aggregate), so
no step moves all rows into one task.  Results come back as small DataFrames;
the helpers ``*_dict`` collect those one-row results for driver-side loops
(cross-validation), never the data itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.expr import q
from riskframe.operators.ordered import ordered_cumsum
from riskframe.session import cut_lineage


def predict_label(p: F.Column, threshold: float) -> F.Column:
    """EV1 / SC3: ``p >= t`` as 0/1."""
    return (p >= F.lit(float(threshold))).cast("int")


def _yp(df: DataFrame, y: str, p: str) -> DataFrame:
    """The rows with a label and a score: a row without either takes no part in any metric."""
    return df.select(F.col(q(y)).cast("int").alias("y"), F.col(q(p)).cast("double").alias("p")).where("y is not null and p is not null")


def score_curve(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """WIN3 / EV4: one row per distinct score with cumulative counts in
    score-descending order: threshold, pos, neg, tp, fp (counts of rows with
    score >= threshold), n_pos, n_neg, precision, recall."""
    # one per-score table serves the bounds, the totals and the curve
    per_score = cut_lineage(_yp(df, y, p).groupBy("p").agg(F.sum("y").alias("pos"), F.sum(F.lit(1) - F.col("y")).alias("neg")))
    cum = ordered_cumsum(per_score, "p", ["pos", "neg"], descending=True, prefix="cum_")
    # class totals as one scalar subquery (run once, no join)
    totals = per_score.agg(F.struct(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))).scalar()
    cum = cum.withColumn("_t", totals).withColumn("n_pos", F.col("_t.n_pos")).withColumn("n_neg", F.col("_t.n_neg"))
    return cum.select(
        F.col("p").alias("threshold"), "pos", "neg",
        F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"), "n_pos", "n_neg",
        F.try_divide(F.col("cum_pos").cast("double"), (F.col("cum_pos") + F.col("cum_neg")).cast("double")).alias("precision"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("n_pos").cast("double")).alias("recall"),
    )


def pr_curve(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """EV4: precision/recall per distinct threshold plus the final
    (precision 1, recall 0) point with a NULL threshold."""
    c = score_curve(df, y, p)
    pts = c.select("threshold", "precision", "recall")
    spark = df.sparkSession
    last = spark.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return pts.unionByName(last)


def auc_ap(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """EV2 + EV3 in one pass over the curve: ROC AUC (ties count half) and
    average precision (step sum)."""
    c = score_curve(df, y, p)
    return c.agg(
        F.try_divide(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)),
                     F.first("n_pos").cast("double") * F.first("n_neg").cast("double")).alias("auc"),
        F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.first("n_pos").cast("double")).alias("ap"),
    )


def confusion(df: DataFrame, threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    """EV5: tn, fp, fn, tp counts at ``p >= threshold``."""
    d = _yp(df, y, p).withColumn("pred", predict_label(F.col("p"), threshold))
    return d.agg(
        F.count_if((F.col("y") == 0) & (F.col("pred") == 0)).alias("tn"),
        F.count_if((F.col("y") == 0) & (F.col("pred") == 1)).alias("fp"),
        F.count_if((F.col("y") == 1) & (F.col("pred") == 0)).alias("fn"),
        F.count_if((F.col("y") == 1) & (F.col("pred") == 1)).alias("tp"),
    )


def _rates(cm: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    zero = F.lit(0.0)
    prec = F.coalesce(F.try_divide(tp, tp + fp), zero)
    rec = F.coalesce(F.try_divide(tp, tp + fn), zero)
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero)
    n = tn + fp + fn + tp
    spec = F.try_divide(tn, tn + fp)
    # balanced accuracy: mean recall over the classes present
    bal = F.when(spec.isNull(), rec).when((tp + fn) == 0, spec).otherwise((rec + spec) / 2)
    return cm.select("*", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                     F.try_divide(tp + tn, n).alias("accuracy"), bal.alias("bal_acc"),
                     F.try_divide(tp + fp, n).alias("pred_pos_rate"))


def binary_metrics(df: DataFrame, threshold: float = 0.5, y: str = "y", p: str = "p") -> DataFrame:
    """EV6: one row with auc, ap, precision, recall, f1, accuracy, bal_acc,
    pred_pos_rate (0 on zero division) and the confusion counts."""
    rates = _rates(confusion(df, threshold, y, p))
    a = auc_ap(df, y, p)
    s = a.select(F.struct("auc", "ap")).scalar()
    return rates.withColumn("_s", s).withColumn("auc", F.col("_s.auc")).withColumn("ap", F.col("_s.ap")).drop("_s")


def metrics_dict(df: DataFrame, threshold: float = 0.5, prefix: str = "", y: str = "y", p: str = "p") -> dict:
    row = binary_metrics(df, threshold, y, p).first().asDict()
    keys = ("auc", "ap", "precision", "recall", "f1", "accuracy", "bal_acc", "pred_pos_rate")
    return {f"{prefix}{k}" if prefix else k: (float(row[k]) if row[k] is not None else None) for k in keys}


def threshold_for_recall(df: DataFrame, target_recall: float = 0.80, shift_compat: bool = False,
                         y: str = "y", p: str = "p") -> DataFrame:
    """EV7: highest threshold whose recall reaches the target; when none does,
    the threshold whose recall is closest (smallest threshold on ties).

    ``shift_compat=True`` pairs each threshold with the recall of the next
    higher one, as the reference's index arithmetic does.
    Returns one row: threshold, and precision/recall/f1/tn/fp/fn/tp at it.
    """
    c = score_curve(df, y, p)
    rec = (F.col("tp") - F.col("pos")) / F.col("n_pos") if shift_compat else F.col("tp") / F.col("n_pos")
    c = c.select("threshold", rec.cast("double").alias("r"))
    t = float(target_recall)
    best = c.agg(
        F.max(F.when(F.col("r") >= F.lit(t), F.col("threshold"))).alias("hit"),
        F.min_by(F.col("threshold"), F.struct(F.abs(F.col("r") - F.lit(t)), F.col("threshold"))).alias("closest"),
    ).select(F.coalesce("hit", "closest").alias("threshold"))
    thr = best.first()["threshold"]
    cm = _rates(confusion(df, thr, y, p))
    return cm.select(F.lit(thr).cast("double").alias("threshold"), "precision", "recall", "f1", "tn", "fp", "fn", "tp")


def cost_at_threshold(df: DataFrame, threshold: float, c_fp: float = 1.0, c_fn: float = 10.0,
                      y: str = "y", p: str = "p") -> DataFrame:
    """EV8: total and mean cost c_fp*FP + c_fn*FN at one threshold."""
    cm = confusion(df, threshold, y, p)
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    total = F.lit(float(c_fp)) * F.col("fp") + F.lit(float(c_fn)) * F.col("fn")
    return cm.select(F.lit(float(threshold)).alias("threshold"), total.alias("total_cost"),
                     (total / n).alias("avg_cost"), "tn", "fp", "fn", "tp")


def threshold_grid(start: float = 0.01, stop: float = 0.5, num: int = 200) -> list[float]:
    return [float(x) for x in np.linspace(start, stop, num)]


def cost_curve(df: DataFrame, grid: list[float] | None = None, c_fp: float = 1.0, c_fn: float = 10.0,
               y: str = "y", p: str = "p") -> DataFrame:
    """EV9: cost at every grid threshold (default 200 points on [0.01, 0.5]).

    Each row is put in its grid slot once (slot = number of grid thresholds
    <= p, by arithmetic plus one correction step), counted per slot, and
    suffix sums over the <= len(grid)+1 slot rows give FP/FN per threshold:
    no grid x data cross join.
    """
    grid = grid or threshold_grid()
    g = len(grid)
    spark = df.sparkSession
    d = _yp(df, y, p)
    arr = F.array(*[F.lit(x) for x in grid])
    step = (grid[-1] - grid[0]) / (g - 1) if g > 1 else 1.0
    guess = F.greatest(F.lit(0), F.least(F.lit(g), (F.floor((F.col("p") - F.lit(grid[0])) / F.lit(step)) + 1).cast("int")))
    d = d.withColumn("_s0", F.when(F.col("p").isNull(), F.lit(0)).otherwise(guess))
    # guess is off by at most one: move up while grid[slot] <= p, down while grid[slot-1] > p
    up = F.when((F.col("_s0") < g) & (F.element_at(arr, F.least(F.col("_s0") + 1, F.lit(g))) <= F.col("p")),
                F.col("_s0") + 1).otherwise(F.col("_s0"))
    d = d.withColumn("_s1", up)
    down = F.when((F.col("_s1") > 0) & (F.element_at(arr, F.greatest(F.col("_s1"), F.lit(1))) > F.col("p")),
                  F.col("_s1") - 1).otherwise(F.col("_s1"))
    d = d.withColumn("slot", down)
    per_slot = d.groupBy("slot").agg(F.sum("y").alias("pos"), F.sum(F.lit(1) - F.col("y")).alias("neg"))
    grid_df = spark.createDataFrame([(i, x) for i, x in enumerate(grid)], "idx int, threshold double")
    # row in slot s is predicted positive at grid index i  <=>  i < s
    slots = spark.range(0, g + 1).select(F.col("id").cast("int").alias("slot"))
    per_slot = slots.join(per_slot, "slot", "left").fillna(0, ["pos", "neg"])
    w_suffix = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # bounded: g+1 rows, one task by design
    suf = per_slot.select("slot", F.sum("pos").over(w_suffix).alias("tp_ge"), F.sum("neg").over(w_suffix).alias("fp_ge"))
    totals = per_slot.agg(F.struct(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))).scalar()
    res = grid_df.join(suf, grid_df.idx + 1 == suf.slot, "inner").withColumn("_t", totals) \
        .withColumn("n_pos", F.col("_t.n_pos")).withColumn("n_neg", F.col("_t.n_neg"))
    fp = F.col("fp_ge")
    fn = F.col("n_pos") - F.col("tp_ge")
    total = F.lit(float(c_fp)) * fp + F.lit(float(c_fn)) * fn
    return res.select("idx", "threshold", total.cast("double").alias("total_cost"),
                      (total / (F.col("n_pos") + F.col("n_neg"))).alias("avg_cost"),
                      (F.col("n_neg") - fp).alias("tn"), fp.alias("fp"), fn.alias("fn"), F.col("tp_ge").alias("tp"))


def best_cost_threshold(df: DataFrame, **kw) -> DataFrame:
    """EV9 choice: the first grid threshold with the minimal mean cost."""
    return cost_curve(df, **kw).orderBy("avg_cost", "idx").limit(1)


def fold_means(fold_metrics: DataFrame, metric_cols: list[str]) -> DataFrame:
    """EV10: mean of each metric over folds."""
    return fold_metrics.agg(*[F.avg(q(c)).alias(f"{c}_mean_cv") for c in metric_cols])
