"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the driver's whole tables (or data Spark derives from them)
and returns a DataFrame with every computed column aliased; doubles are
snapped to float precision so results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskframe.plans import features as feat
from riskframe.plans.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _snap_rollup(df):
    """Sums, means and variances to float precision; values of the data as they are."""
    return feat.snap_doubles(df, [c for c in df.columns if c == "c_acctbal" or feat.passed_through(c)])


@register("agg1_orders_rollup")
def q_orders_rollup(spark, sf_dir):
    df, _ = feat.orders_rollup(Tables(spark, sf_dir))
    return _snap_rollup(df)


@register("agg2_order_lines_rollup")
def q_order_lines_rollup(spark, sf_dir):
    df, _, _ = feat.order_lines_rollup(Tables(spark, sf_dir))
    return _snap_rollup(df)


@register("agg4_feature_table")
def q_feature_table(spark, sf_dir):
    df, _ = feat.feature_table(Tables(spark, sf_dir))
    return _snap_rollup(df)


@register("agg3_four_children")
def q_four_children(spark, sf_dir):
    """Every customer, name included, with the rollups of four children."""
    t = Tables(spark, sf_dir)
    df, _ = feat.attach_children(t.customer.select("c_custkey", "c_nationkey", "c_name"), feat.children_of_customers(t))
    return _snap_rollup(df)


# --- metrics on (y = returnflag 'R', p = extendedprice / 110000) ----------------
from riskframe.operators import metrics as M  # noqa: E402
from riskframe.plans.tables import scored_lineitem  # noqa: E402


@register("ev1_predict_label")
def q_predict_label(spark, sf_dir):
    d = scored_lineitem(Tables(spark, sf_dir))
    return feat.snap_doubles(d.select("y", "p", M.predict_label(d.p, 0.5).alias("pred")))


@register("ev4_pr_curve")
def q_pr_curve(spark, sf_dir):
    return feat.snap_doubles(M.pr_curve(scored_lineitem(Tables(spark, sf_dir))))


@register("win3_score_curve")
def q_score_curve(spark, sf_dir):
    return feat.snap_doubles(M.score_curve(scored_lineitem(Tables(spark, sf_dir))))


@register("ev2_ev3_auc_ap")
def q_auc_ap(spark, sf_dir):
    return feat.snap_doubles(M.auc_ap(scored_lineitem(Tables(spark, sf_dir))))


@register("ev5_confusion")
def q_confusion(spark, sf_dir):
    return M.confusion(scored_lineitem(Tables(spark, sf_dir)), 0.5)


@register("ev6_binary_metrics")
def q_binary_metrics(spark, sf_dir):
    return feat.snap_doubles(M.binary_metrics(scored_lineitem(Tables(spark, sf_dir)), 0.5))


@register("ev7_threshold_for_recall")
def q_thr_recall(spark, sf_dir):
    return feat.snap_doubles(M.threshold_for_recall(scored_lineitem(Tables(spark, sf_dir)), 0.8))


@register("ev7_threshold_for_recall_shifted")
def q_thr_recall_shift(spark, sf_dir):
    return feat.snap_doubles(M.threshold_for_recall(scored_lineitem(Tables(spark, sf_dir)), 0.8, shift_compat=True))


@register("ev8_cost_at_threshold")
def q_cost_at(spark, sf_dir):
    return feat.snap_doubles(M.cost_at_threshold(scored_lineitem(Tables(spark, sf_dir)), 0.3))


@register("ev9_cost_curve")
def q_cost_curve(spark, sf_dir):
    return feat.snap_doubles(M.cost_curve(scored_lineitem(Tables(spark, sf_dir))))


@register("ev9_best_cost_threshold")
def q_best_cost(spark, sf_dir):
    return feat.snap_doubles(M.best_cost_threshold(scored_lineitem(Tables(spark, sf_dir))))


# --- drift -----------------------------------------------------------------------
from riskframe.operators import drift as D  # noqa: E402
from riskframe.plans import monitoring as mon  # noqa: E402


@register("dr8_drift_report_events")
def q_drift_events(spark, sf_dir):
    return feat.snap_doubles(mon.drift_report_events(Tables(spark, sf_dir)))


@register("dr8_drift_report_orders")
def q_drift_orders(spark, sf_dir):
    return feat.snap_doubles(mon.drift_report_orders(Tables(spark, sf_dir)))


@register("top2_top_psi")
def q_top_psi(spark, sf_dir):
    return feat.snap_doubles(D.top_psi(mon.drift_report_events(Tables(spark, sf_dir)), 3))


@register("top3_top_missing_delta")
def q_top_missing(spark, sf_dir):
    return feat.snap_doubles(D.top_missing_delta(mon.drift_report_events(Tables(spark, sf_dir)), 3))


@register("top7_report_view")
def q_report_view(spark, sf_dir):
    return feat.snap_doubles(D.report_view(mon.drift_report_orders(Tables(spark, sf_dir)), 0.0, False))


# --- profiling on lineitem with nulls made by nullif --------------------------------
from riskframe.operators import profile as PR  # noqa: E402
from riskframe.plans.tables import profile_base  # noqa: E402

PB_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax"]


def _pb(spark, sf_dir):
    return profile_base(Tables(spark, sf_dir))


def _pb_y(spark, sf_dir):
    from pyspark.sql import functions as F
    li = Tables(spark, sf_dir).lineitem
    return li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber",
                     (F.col("l_returnflag") == "R").cast("int").alias("y"))


register("prf1_table_info")(lambda spark, sf: PR.table_info(_pb(spark, sf)))
register("prf2_shape")(lambda spark, sf: PR.shape(_pb(spark, sf)))
register("prf3_dtype_counts")(lambda spark, sf: PR.dtype_counts(_pb(spark, sf)))
register("prf4_null_counts")(lambda spark, sf: feat.snap_doubles(PR.null_counts(_pb(spark, sf))))
register("prf5_value_counts")(lambda spark, sf: PR.value_counts(_pb(spark, sf), ["l_returnflag", "l_linestatus"]))
register("prf6_class_distribution")(lambda spark, sf: feat.snap_doubles(PR.class_distribution(_pb(spark, sf), "l_returnflag")))
register("prf7_describe")(lambda spark, sf: feat.snap_doubles(PR.describe(_pb(spark, sf), PB_NUMERIC)))
register("prf8_missing_values_table")(lambda spark, sf: feat.snap_doubles(PR.missing_values_table(_pb(spark, sf))))
register("prf9_distinct_counts")(lambda spark, sf: PR.distinct_counts(_pb(spark, sf)))
register("prf10_null_ratio_top")(lambda spark, sf: feat.snap_doubles(PR.null_ratio_top(_pb(spark, sf), 5)))
register("prf11_all_null_columns")(lambda spark, sf: PR.all_null_columns(_pb(spark, sf)))
register("prf12_constant_columns")(lambda spark, sf: PR.constant_columns(_pb(spark, sf)))
register("prf13_key_uniqueness")(lambda spark, sf: PR.key_uniqueness(_pb(spark, sf), "l_orderkey"))
register("prf14_key_label_nulls")(lambda spark, sf: feat.snap_doubles(PR.null_counts(_pb(spark, sf), ["l_orderkey", "l_returnflag"])))
register("prf15_histogram")(lambda spark, sf: feat.snap_doubles(PR.histogram(_pb(spark, sf), "l_extendedprice", 25)))
register("prf16_kde_by_class")(lambda spark, sf: feat.snap_doubles(PR.kde_by_class(_pb_y(spark, sf), "l_quantity", "y")))
register("prf17_fixed_bins_mean")(lambda spark, sf: feat.snap_doubles(PR.fixed_bins_mean(
    _pb(spark, sf), "l_quantity", [float(x) for x in __import__("numpy").linspace(0, 50, 11)], ["l_extendedprice", "l_discount"])))
register("prf18_corr_with_label")(lambda spark, sf: feat.snap_doubles(PR.corr_with_label(_pb_y(spark, sf), "y")))
register("prf19_pair_corr")(lambda spark, sf: feat.snap_doubles(PR.pair_corr(_pb(spark, sf), "l_quantity", "l_extendedprice")))
register("prf20_corr_matrix")(lambda spark, sf: feat.snap_doubles(PR.corr_matrix(_pb(spark, sf), PB_NUMERIC)))
register("top5_corr_top")(lambda spark, sf: feat.snap_doubles(PR.top_bottom(PR.corr_with_label(_pb_y(spark, sf), "y"), "corr", 3)[0]))
register("top5_corr_bottom")(lambda spark, sf: feat.snap_doubles(PR.top_bottom(PR.corr_with_label(_pb_y(spark, sf), "y"), "corr", 3)[1]))


def _segment(spark, sf):
    from pyspark.sql import functions as F
    d = _pb_y(spark, sf)
    return feat.snap_doubles(PR.segment_compare(d, F.col("l_linenumber").eqNullSafe(1), "y"))


register("prf21_segment_compare")(_segment)


# --- alignment and scoring -------------------------------------------------------------
from riskframe.plans import scoring as SCR  # noqa: E402


@register("adp8_align_compact_rows")
def q_align(spark, sf_dir):
    a = SCR.aligned_orders(Tables(spark, sf_dir))
    return feat.snap_doubles(a.drop("used_groups", "reject_detail"), SCR.ORDER_FEATURES)


@register("adp9_alignment_stats")
def q_align_stats(spark, sf_dir):
    from pyspark.sql import functions as F
    a = SCR.aligned_orders(Tables(spark, sf_dir))
    return feat.snap_doubles(a.select("row_index", "n_features", "n_missing", "missing_rate",
                                      F.array_join("used_groups", ",").alias("used_groups"), "filled_count"))


@register("adp13_rejected_rows")
def q_rejected(spark, sf_dir):
    a = SCR.aligned_orders(Tables(spark, sf_dir))
    return a.filter("reject_reason is not null").select("row_index", "reject_reason")


@register("adp6_adp7_adp11_reject_details")
def q_reject_details(spark, sf_dir):
    from riskframe.operators.align import align_rows
    a = align_rows(SCR.faulty_order_rows(Tables(spark, sf_dir)), SCR.order_spec(), strict=True, rule=SCR.order_rule())
    return a.select("row_index", "reject_reason", "reject_detail", "filled_count", "n_missing")


@register("sc4_snk6_logged_payload")
def q_logged_payload(spark, sf_dir):
    log, _ = SCR.predict_batch(SCR.compact_order_rows(Tables(spark, sf_dir)), SCR.order_spec(), SCR.order_model(), SCR.order_rule(),
                               strict=True, deterministic=True)
    return log.select("log_seq", "ts_utc", "input_json")


@register("sc2_sc3_linear_score")
def q_linear_score(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = SCR.order_model()
    ok = SCR.aligned_orders(t).filter("reject_reason is null")
    return feat.snap_doubles(SCR.score_aligned(ok, m).select("row_index", "proba_default", "decision"))


@register("sc4_batch_score")
def q_batch_score(spark, sf_dir):
    t = Tables(spark, sf_dir)
    log, _ = SCR.predict_batch(SCR.compact_order_rows(t), SCR.order_spec(), SCR.order_model(), SCR.order_rule(),
                               strict=True, deterministic=True)
    return feat.snap_doubles(log.drop("input_json", "ts_utc"))


# --- prediction log source, sampling, preprocessing ----------------------------------------
from riskframe.operators import preprocess as PP  # noqa: E402
from riskframe.operators import sampling as SMP  # noqa: E402
from riskframe.sources import predlog as PL  # noqa: E402


def _events_y(spark, sf):
    from pyspark.sql import functions as F
    return Tables(spark, sf).events.select("event_id", (F.col("event_type") == "error").cast("int").alias("y"))


@register("src4_latest_log_payloads")
def q_latest_payloads(spark, sf):
    ev = Tables(spark, sf).events
    top = PL.latest(ev, 2000, order_cols=("event_id",))
    return PL.payload_long(PL.parse_payload(top, "props", keep=("event_id",)), "event_id")


register("dr10_log_vs_reference")(lambda spark, sf: feat.snap_doubles(mon.log_vs_reference(Tables(spark, sf))))
register("smp1_sample_n")(lambda spark, sf: SMP.sample_n(_events_y(spark, sf), "event_id", 1000))
register("smp2_stratified_split")(lambda spark, sf: SMP.stratified_split(_events_y(spark, sf), "y", "event_id", 0.2)
                                  .select("event_id", "y", "is_test"))
register("smp3_stratified_subset")(lambda spark, sf: SMP.stratified_subset(_events_y(spark, sf), "y", "event_id", 3000))
register("smp4_stratified_folds")(lambda spark, sf: SMP.stratified_folds(_events_y(spark, sf), "y", "event_id", 3))
register("smp5_under_sample")(lambda spark, sf: SMP.under_sample(_events_y(spark, sf), "y", "event_id", 1.0))
register("ml5_class_weights")(lambda spark, sf: feat.snap_doubles(PP.class_weights(_events_y(spark, sf), "y")))
register("ml3_prior_baseline")(lambda spark, sf: feat.snap_doubles(PP.prior_baseline(_events_y(spark, sf), "y")))


@register("ml1_median_impute")
def q_median_impute(spark, sf):
    pb = _pb(spark, sf).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    imp = PP.MedianImputer.fit(pb, ["l_discount", "l_tax"])
    return feat.snap_doubles(imp.transform(pb))


@register("ml2_standardize")
def q_standardize(spark, sf):
    pb = _pb(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    st = PP.Standardizer.fit(pb, ["l_quantity", "l_extendedprice"], with_mean=True)
    return feat.snap_doubles(st.transform(pb))


# --- importance-based selection on the aligned orders --------------------------------------
from riskframe.operators import importance as IMP  # noqa: E402
from riskframe.operators import profile as _PR  # noqa: E402


def _order_importances(spark, sf):
    """importance = |corr(feature, y)| over accepted aligned orders, y = price > 250000, in full
    (equal indicators come out of one aggregate with equal values, so they tie and are ordered by
    name); an undefined correlation counts as 0 (SRC5 rule)."""
    from pyspark.sql import functions as F
    from riskframe.sources.tables import read_importances
    a = SCR.aligned_orders(Tables(spark, sf)).filter("reject_reason is null")
    a = a.withColumn("y", (F.col("O_TOTALPRICE") > 250000).cast("int"))
    c = _PR.corr_with_label(a, "y", SCR.ORDER_FEATURES)
    return read_importances(c.select("feature", F.abs("corr").cast("string").alias("importance")))


register("src5_importances")(lambda spark, sf: feat.snap_doubles(_order_importances(spark, sf)))
register("win1_cumulative_importance")(lambda spark, sf: feat.snap_doubles(
    IMP.cumulative_importance(_order_importances(spark, sf))))
register("win2_select_by_cumulative")(lambda spark, sf: IMP.select_by_cumulative(
    _order_importances(spark, sf), 0.8).select("feature"))
register("ml13_ml14_requested_keys")(lambda spark, sf: feat.snap_doubles(IMP.requested_keys(
    _order_importances(spark, sf), SCR.order_spec(), 0.8)).selectExpr(
    "array_join(requested_groups, ',') AS requested_groups", "n_requested", "n_allowed", "ratio",
    "min_filled_rate_requested"))


# --- training (rows-only checks: model fits are not SQL) ----------------------------------------
from riskframe.plans import train as TR  # noqa: E402


@register("ml9_cv_logistic_folds")
def q_cv_logistic(spark, sf):
    data, feats = TR.embedding_matrix(Tables(spark, sf))
    res = TR.run_model_cv(TR.logistic_regression(0.1), data, feats, "vec_id", 3)
    return res["folds"]


@register("ml6_ml11_forest_importances")
def q_rf_importances(spark, sf):
    data, feats = TR.embedding_matrix(Tables(spark, sf))
    prep = TR.prepare(data, feats)
    model = TR.random_forest(20, 5).fit(prep.apply(data))
    return TR.importances(spark, model, feats)


@register("ml7_ml8_gbt_train_valid")
def q_gbt(spark, sf):
    from riskframe.operators.sampling import stratified_split
    data, feats = TR.embedding_matrix(Tables(spark, sf))
    s = stratified_split(data, "y", "vec_id", 0.2)
    res = TR.run_model(TR.gradient_boosting(n_estimators=10, max_depth=3, learning_rate=0.1), s.filter("not is_test"),
                       s.filter("is_test"), feats)
    return spark.createDataFrame([tuple(float(res[k]) for k in sorted(res) if k.endswith(("auc", "ap")))],
                                 ", ".join(f"{k} double" for k in sorted(res) if k.endswith(("auc", "ap"))))


@register("ml7_boosted_tree")
def q_boosted_tree(spark, sf):
    """One tree of three leaves with penalties, on all embeddings in bins of 0.05: its splits and leaf values."""
    from pyspark.sql import functions as F
    from riskframe.operators import boosting as B
    data, feats = TR.embedding_matrix(Tables(spark, sf))
    rows = data.select(F.col("vec_id").alias("key"), "y", F.lit(1.0).alias("w"), F.array(*feats).alias("x"))
    growth = B.Growth(n_estimators=1, learning_rate=1.0, num_leaves=3, min_child_samples=20, reg_alpha=0.5, reg_lambda=2.0)
    tree = B.fit_trees(rows, growth, [[round(-0.25 + 0.05 * i, 2) for i in range(11)]] * len(feats))["trees"][0]
    out, todo = [], [("0", "R")]
    while todo:
        node, path = todo.pop()
        n = int(tree["counts"][node])
        if node in tree["splits"]:
            s = tree["splits"][node]
            out.append((path, n, feats[s["feature"]], s["bin"], s["gain"], None))
            todo += [(str(s["left"]), path + "L"), (str(s["right"]), path + "R")]
        else:
            out.append((path, n, None, None, None, tree["values"][node]))
    return feat.snap_doubles(spark.createDataFrame(out, "node string, n long, feature string, bin int, gain double, value double"))


# --- projections, filters, encodings (PRJ1-PRJ14) ---------------------------------------------
from riskframe.functions.expr import safe_div  # noqa: E402
from riskframe.operators import encode as ENC  # noqa: E402


def _cust_nt(spark, sf):
    return Tables(spark, sf).customer.drop("c_name")


@register("prj1_prj2_drop_project")
def q_drop_project(spark, sf):
    return _cust_nt(spark, sf).select(*ENC.numeric_columns(_cust_nt(spark, sf)), "c_mktsegment")


@register("prj3_filter_not_equal")
def q_not_equal(spark, sf):
    from pyspark.sql import functions as F
    o = Tables(spark, sf).orders
    return o.filter(~F.col("o_orderstatus").eqNullSafe("F")).select("o_orderkey", "o_orderstatus")


@register("prj4_prj5_abs_units")
def q_abs_units(spark, sf):
    from pyspark.sql import functions as F
    c = Tables(spark, sf).customer
    return feat.snap_doubles(c.select("c_custkey", F.abs("c_acctbal").alias("acctbal_abs"),
                                      (F.col("c_acctbal") / 365.0).alias("acctbal_per_day"),
                                      (F.col("c_acctbal") / -365.0).alias("acctbal_per_day_neg")))


@register("prj6_prj7_sentinel")
def q_sentinel(spark, sf):
    from pyspark.sql import functions as F
    c = Tables(spark, sf).customer
    return c.select("c_custkey", F.col("c_nationkey").eqNullSafe(24).alias("NATION_ANOM"),
                    F.expr("nullif(c_nationkey, 24)").alias("c_nationkey"))


@register("prj8_ratio_features")
def q_ratios(spark, sf):
    from pyspark.sql import functions as F
    li = Tables(spark, sf).lineitem
    return feat.snap_doubles(li.select(
        "l_orderkey", "l_linenumber",
        safe_div(F.col("l_extendedprice"), F.col("l_quantity")).alias("UNIT_PRICE"),
        safe_div(F.col("l_discount"), F.col("l_tax")).alias("DISCOUNT_TAX_PERC"),
        safe_div(F.col("l_tax"), F.col("l_discount")).alias("TAX_DISCOUNT_PERC"),
        safe_div(F.col("l_quantity"), F.col("l_linenumber")).alias("QTY_PER_LINE"),
        safe_div(F.col("l_extendedprice"), F.col("l_orderkey")).alias("PRICE_PER_KEY")))


@register("prj9_label_encode")
def q_label_encode(spark, sf):
    from pyspark.sql import functions as F
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_linestatus", "l_returnflag")
    cut = F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")
    tr, te = li.filter(F.col("l_shipdate") < cut).drop("l_shipdate"), li.filter(F.col("l_shipdate") >= cut).drop("l_shipdate")
    tr2, te2, _ = ENC.label_encode(tr, te)
    return tr2.withColumn("side", F.lit("train")).unionByName(te2.withColumn("side", F.lit("test")))


@register("prj10_one_hot")
def q_one_hot(spark, sf):
    df, _ = ENC.one_hot(_cust_nt(spark, sf), dummy_na=False)
    return feat.snap_doubles(df)


@register("prj11_one_hot_with_nan")
def q_one_hot_nan(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    df, _ = ENC.one_hot(o, dummy_na=True)
    return df


def _train_test_dummies(spark, sf):
    from pyspark.sql import functions as F
    c = _cust_nt(spark, sf)
    tr, _ = ENC.one_hot(c, dummy_na=False)
    te, _ = ENC.one_hot(c.filter(F.col("c_mktsegment") != "MACHINERY"), dummy_na=False)
    return tr, te


@register("prj12_align_train_test")
def q_align_tt(spark, sf):
    """Both sides on their common columns, all rows."""
    from pyspark.sql import functions as F
    tr, te = ENC.align_columns(*_train_test_dummies(spark, sf))
    return tr.withColumn("side", F.lit("train")).unionByName(te.withColumn("side", F.lit("test")))


@register("prj13_column_difference")
def q_coldiff(spark, sf):
    """The columns of one side only, each with the rows that are set there."""
    from pyspark.sql import functions as F
    tr, te = _train_test_dummies(spark, sf)
    apart = ENC.column_difference(spark, tr, te)
    counts = [df.agg(*[F.sum(F.col(f"`{c}`").cast("long")).alias(c) for c in df.columns if c not in other.columns] or [F.lit(0).alias("none")])
              for df, other in ((tr, te), (te, tr))]
    found = counts[0].unpivot([], counts[0].columns, "column", "n_set").withColumn("side", F.lit("left_only")).unionByName(
        counts[1].unpivot([], counts[1].columns, "column", "n_set").withColumn("side", F.lit("right_only")))
    return apart.join(found, ["side", "column"])


@register("prj14_reindex_union")
def q_reindex(spark, sf):
    from pyspark.sql import functions as F
    o = Tables(spark, sf).orders
    cut = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    ref = o.filter(F.col("o_orderdate") < cut).select("o_orderkey", "o_totalprice")
    prod = o.filter(F.col("o_orderdate") >= cut).select("o_orderkey", "o_orderstatus")
    r2, p2, _ = ENC.reindex_union(ref, prod)
    return feat.snap_doubles(r2.withColumn("side", F.lit("ref")).unionByName(p2.withColumn("side", F.lit("prod"))))


# --- log statistics ---------------------------------------------------------------------------
from riskframe.operators import logstats as LS  # noqa: E402


@register("agg6_latency_summary")
def q_latency(spark, sf):
    """binding: latency = events.value, model version = event_type."""
    ev = Tables(spark, sf).events.select(F_col("event_type").alias("model_version"), F_col("value").alias("latency_ms"))
    return feat.snap_doubles(LS.latency_summary(ev))


@register("agg7_positive_rate")
def q_pos_rate(spark, sf):
    t = Tables(spark, sf)
    log, _ = SCR.predict_batch(SCR.compact_order_rows(t), SCR.order_spec(), SCR.order_model(), SCR.order_rule(),
                               deterministic=True)
    return feat.snap_doubles(LS.positive_rate(log))


def F_col(name):
    from pyspark.sql import functions as F
    return F.col(name)


# --- SMOTE (exact neighbours on the minority of the embeddings) ------------------------------------
from riskframe.operators import neighbours as NB  # noqa: E402
from riskframe.operators import smote as SMOTE  # noqa: E402


@register("smp6_smote_neighbours")
def q_smote_nn(spark, sf):
    """All embeddings' nearest neighbours, in cells small enough that there are several."""
    data, feats = TR.embedding_matrix(Tables(spark, sf))
    found = NB.nearest(SMOTE.points_of(data, "vec_id", feats), "id", "x", 5, cell=128).rows
    return found.selectExpr("id AS vec_id", "CAST(position AS INT) AS pos", "neighbour AS neighbour_id")


@register("smp6_smote_rows")
def q_smote_rows(spark, sf):
    data, feats = TR.embedding_matrix(Tables(spark, sf))
    return feat.snap_doubles(SMOTE.smote(data, "y", "vec_id", feats, ratio=0.5, k=5))


from riskframe.plans import catalog_io  # noqa: E402, F401
