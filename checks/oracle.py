"""DuckDB check queries, one per registered Spark query where SQL can say it."""

from __future__ import annotations

from checks import sqlgen as g

ORACLE: dict[str, str] = {
    "agg1_orders_rollup": g.orders_rollup_sql(),
    "agg2_order_lines_rollup": g.order_lines_rollup_sql(),
    "agg4_feature_table": g.feature_table_sql(),
}

ORACLE.update({
    "ev1_predict_label": "WITH " + g.YP + f"SELECT y, {g.f32('p')} AS p, CAST(p >= 0.5 AS INTEGER) AS pred FROM d",
    "ev4_pr_curve": "WITH " + g.YP + (
        f"SELECT {g.f32('p')} AS threshold, {g.f32('tp::DOUBLE / (tp + fp)')} AS precision, "
        f"{g.f32('tp::DOUBLE / n_pos')} AS recall FROM c, t "
        f"UNION ALL SELECT NULL, {g.f32('1.0')}, {g.f32('0.0')}"),
    "win3_score_curve": "WITH " + g.YP + (
        f"SELECT {g.f32('p')} AS threshold, pos, neg, tp, fp, n_pos, n_neg, {g.f32('tp::DOUBLE / (tp + fp)')} AS precision, "
        f"{g.f32('tp::DOUBLE / n_pos')} AS recall FROM c, t"),
    "ev2_ev3_auc_ap": "WITH " + g.YP + g.AUC_AP,
    "ev5_confusion": "WITH " + g.YP + g.cm_sql("0.5"),
    "ev6_binary_metrics": "WITH " + g.YP + (
        f"SELECT r.*, a.auc, a.ap FROM ({g.rates_sql(g.cm_sql('0.5'))}) r, ({g.AUC_AP}) a"),
    "ev7_threshold_for_recall": g.thr_recall_sql(0.8, False),
    "ev7_threshold_for_recall_shifted": g.thr_recall_sql(0.8, True),
    "ev8_cost_at_threshold": "WITH " + g.YP + (
        f"SELECT {g.f32('0.3')} AS threshold, {g.f32('1.0 * fp + 10.0 * fn')} AS total_cost, "
        f"{g.f32('(1.0 * fp + 10.0 * fn) / (tn + fp + fn + tp)')} AS avg_cost, tn, fp, fn, tp FROM ({g.cm_sql('0.3')}) x"),
    "ev9_cost_curve": "WITH " + g.YP + ", " + g.GRID + f"SELECT {g.COST_COLS} FROM cc",
    "ev9_best_cost_threshold": "WITH " + g.YP + ", " + g.GRID + (
        f"SELECT {g.COST_COLS} FROM cc ORDER BY (1.0 * fp + 10.0 * fn) / (tn + fp + fn + tp), idx LIMIT 1"),
})

_EV_DRIFT = g.drift_sql(g.EVENTS_DRIFT_BASE, g.EVENTS_DRIFT_FEATS)
_ORD_DRIFT = g.drift_sql(g.ORDERS_DRIFT_BASE, g.ORDERS_DRIFT_FEATS)
ORACLE.update({
    "dr8_drift_report_events": _EV_DRIFT,
    "dr8_drift_report_orders": _ORD_DRIFT,
    "top2_top_psi": f"SELECT * FROM ({_EV_DRIFT}) r ORDER BY psi DESC NULLS LAST, feature LIMIT 3",
    "top3_top_missing_delta": f"SELECT * FROM ({_EV_DRIFT}) r ORDER BY abs(missing_rate_delta) DESC NULLS LAST, feature LIMIT 3",
    "top7_report_view": f"SELECT * FROM ({_ORD_DRIFT}) r WHERE psi >= 0.0",
})

_TYPE = "CASE typeof({c}) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' END"
_PB = "WITH pb AS (" + g.PB + ") "
_ALL = [c for c, _ in g.PB_COLS]
ORACLE.update({
    "prf1_table_info": _PB + " UNION ALL ".join(
        f"SELECT {g.lit(c)} AS column, count({g.qi(c)}) AS non_null, (SELECT {_TYPE.format(c=g.qi(c))} FROM pb LIMIT 1) AS dtype FROM pb"
        for c in _ALL),
    "prf2_shape": _PB + f"SELECT count(*) AS n_rows, CAST({len(_ALL)} AS BIGINT) AS n_columns FROM pb",
    "prf4_null_counts": g.null_counts_sql(_ALL),
    "prf5_value_counts": _PB + " UNION ALL ".join(
        f"SELECT {g.lit(c)} AS column, {g.qi(c)} AS value, count(*) AS count FROM pb GROUP BY {g.qi(c)}"
        for c in ["l_returnflag", "l_linestatus"]),
    "prf6_class_distribution": _PB + (
        f"SELECT l_returnflag AS value, count(*) AS count, {g.f32('count(*) / sum(count(*)) OVER ()')} AS share "
        "FROM pb WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag"),
    "prf7_describe": g.describe_sql(),
    "prf8_missing_values_table": f"SELECT \"column\", null_count AS missing_values, {g.f32('round(null_pct_raw, 1)')} AS pct_of_total FROM ("
        + _PB + " UNION ALL ".join(
            f"SELECT {g.lit(c)} AS column, count(*) FILTER (WHERE {g.qi(c)} IS NULL) AS null_count, "
            f"count(*) FILTER (WHERE {g.qi(c)} IS NULL) * 100.0 / count(*) AS null_pct_raw FROM pb" for c in _ALL)
        + ") x WHERE null_pct_raw <> 0",
    "prf9_distinct_counts": _PB + " UNION ALL ".join(
        f"SELECT {g.lit(c)} AS column, count(DISTINCT {g.qi(c)}) AS n_distinct FROM pb" for c in ["l_returnflag", "l_linestatus"]),
    "prf10_null_ratio_top": _PB + "SELECT \"column\", null_ratio FROM (" + " UNION ALL ".join(
        f"SELECT {g.lit(c)} AS column, {g.f32(f'count(*) FILTER (WHERE {g.qi(c)} IS NULL) * 100.0 / count(*) / 100.0')} AS null_ratio, "
        f"count(*) FILTER (WHERE {g.qi(c)} IS NULL) * 100.0 / count(*) / 100.0 AS raw FROM pb" for c in _ALL)
        + ") x ORDER BY raw DESC, \"column\" LIMIT 5",
    "prf11_all_null_columns": _PB + "SELECT \"column\" FROM (" + " UNION ALL ".join(
        f"SELECT {g.lit(c)} AS column, count({g.qi(c)}) AS n FROM pb" for c in _ALL) + ") x WHERE n = 0",
    "prf12_constant_columns": _PB + "SELECT \"column\" FROM (" + " UNION ALL ".join(
        f"SELECT {g.lit(c)} AS column, min({g.qi(c)}) IS NOT DISTINCT FROM max({g.qi(c)}) AS k FROM pb" for c in _ALL)
        + ") x WHERE k",
    "prf13_key_uniqueness": _PB + ("SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_distinct, "
                                   "count(*) - count(DISTINCT l_orderkey) - max(CAST(l_orderkey IS NULL AS INTEGER)) AS n_duplicated FROM pb"),
    "prf14_key_label_nulls": g.null_counts_sql(["l_orderkey", "l_returnflag"]),
    "prf15_histogram": g.histogram_sql("l_extendedprice", 25),
    "prf16_kde_by_class": g.KDE_SQL,
    "prf17_fixed_bins_mean": g.fixed_bins_sql(),
    "prf18_corr_with_label": g.corr_label_sql(),
    "prf19_pair_corr": _PB + f"SELECT {g.f32('corr(l_quantity, l_extendedprice)')} AS corr FROM pb",
    "prf20_corr_matrix": _PB + " UNION ALL ".join(
        f"SELECT {g.lit(a)} AS row, {g.lit(b)} AS col, {g.f32(f'corr({g.qi(a)}::DOUBLE, {g.qi(b)}::DOUBLE)')} AS corr FROM pb"
        for i, a in enumerate(g.PB_NUM) for j, b in enumerate(g.PB_NUM) if i > j),
    "top5_corr_top": f"SELECT * FROM ({g.corr_label_sql()}) x ORDER BY corr DESC NULLS LAST, feature LIMIT 3",
    "top5_corr_bottom": f"SELECT * FROM ({g.corr_label_sql()}) x ORDER BY corr ASC NULLS LAST, feature LIMIT 3",
    "prf21_segment_compare": f"WITH d AS ({g.PBY}) SELECT (l_linenumber IS NOT DISTINCT FROM 1) AS segment, "
        f"{g.f32('avg(y::DOUBLE)')} AS label_mean, count(*) AS n_rows FROM d GROUP BY 1",
})

ORACLE.update({
    "adp8_align_compact_rows": g.ALIGN_SQL,
    "adp9_alignment_stats": (f"SELECT o_orderkey AS row_index, CAST(11 AS INTEGER) AS n_features, {g.NMISS} AS n_missing, "
                             f"{g.f32(g.NMISS + ' / 11.0')} AS missing_rate, 'O_ORDERPRIORITY,O_ORDERSTATUS' AS used_groups, "
                             f"CAST(3 - {g.NMISS} AS INTEGER) AS filled_count FROM orders"),
    "adp13_rejected_rows": f"SELECT o_orderkey AS row_index, {g.REJECT} AS reject_reason FROM orders WHERE ({g.REJECT}) IS NOT NULL",
    "adp6_adp7_adp11_reject_details": g.REJECT_DETAIL_SQL,
    "sc4_snk6_logged_payload": g.PAYLOAD_SQL,
    "sc2_sc3_linear_score": f"SELECT row_index, {g.f32('p')} AS proba_default, CAST(p >= 0.5 AS INTEGER) AS decision FROM ({g.SCORED}) s",
    "sc4_batch_score": (f"SELECT row_index AS log_seq, CAST(row_index AS VARCHAR) AS request_id, 'orders-linear-v1' AS model_version, "
                        f"{g.f32('p')} AS proba_default, {g.f32('0.5')} AS threshold, CAST(p >= 0.5 AS INTEGER) AS decision, "
                        f"{g.f32('0.0')} AS latency_ms FROM ({g.SCORED}) s"),
})

_D = f"WITH d AS ({g.EVY}), {g.RANKED}"
_DR10_BASE = ("SELECT 'ref' AS side, json_extract_string(props, '$.k') AS k, value, event_type FROM "
              "(SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00' "
              "ORDER BY md5(CAST(event_id AS VARCHAR) || '|42') LIMIT 1000) s "
              "UNION ALL SELECT 'prod', json_extract_string(props, '$.k'), NULL::DOUBLE, NULL::VARCHAR FROM "
              "(SELECT * FROM events ORDER BY event_id DESC LIMIT 2000) p")
ORACLE.update({
    "src4_latest_log_payloads": ("SELECT event_id, k AS feature, json_extract_string(props, '$.\"' || k || '\"') AS value FROM "
                                 "(SELECT event_id, props, unnest(json_keys(props)) AS k FROM "
                                 "(SELECT event_id, props FROM events ORDER BY event_id DESC LIMIT 2000) t) u"),
    "dr10_log_vs_reference": g.drift_sql(_DR10_BASE, [("k", "str", "k"), ("value", "num", "value"),
                                                      ("event_type", "str", "event_type")]),
    "smp1_sample_n": f"WITH d AS ({g.EVY}) SELECT * FROM d ORDER BY md5(CAST(event_id AS VARCHAR) || '|42') LIMIT 1000",
    "smp2_stratified_split": (_D + ", " + g.quota_sql("ceil(0.2 * sum(n_class) OVER ())")
                              + " SELECT r.event_id, r.y, r.rk <= quota.quota AS is_test FROM r JOIN quota ON r.y = quota.y"),
    "smp3_stratified_subset": (_D + ", " + g.quota_sql("least(3000, sum(n_class) OVER ())")
                               + " SELECT r.event_id, r.y FROM r JOIN quota ON r.y = quota.y WHERE r.rk <= quota.quota"),
    "smp4_stratified_folds": _D + " SELECT event_id, y, CAST((rk - 1) % 3 AS INTEGER) AS fold FROM r",
    "smp5_under_sample": (_D + ", c AS (SELECT y, count(*) AS n_class FROM d GROUP BY y), "
                          "c2 AS (SELECT y, n_class, min(n_class) OVER () AS mn, row_number() OVER (ORDER BY n_class, y) AS o FROM c), "
                          "quota AS (SELECT y, CASE WHEN o = 1 THEN n_class ELSE floor(mn / 1.0) END AS quota FROM c2) "
                          "SELECT r.event_id, r.y FROM r JOIN quota ON r.y = quota.y WHERE r.rk <= quota.quota"),
    "ml5_class_weights": (f"WITH d AS ({g.EVY}), c AS (SELECT y, count(*) AS nc FROM d GROUP BY y), "
                          f"w AS (SELECT y, sum(nc) OVER () / (count(*) OVER () * nc) AS weight FROM c) "
                          f"SELECT d.event_id, d.y, {g.f32('w.weight')} AS weight FROM d JOIN w ON d.y = w.y"),
    "ml3_prior_baseline": f"WITH d AS ({g.EVY}) SELECT event_id, y, {g.f32('(SELECT avg(y::DOUBLE) FROM d)')} AS proba_default FROM d",
    "ml1_median_impute": (f"WITH pb AS ({g.PB}) SELECT l_orderkey, l_linenumber, "
                          f"{g.f32('coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM pb))')} AS l_discount, "
                          f"{g.f32('coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM pb))')} AS l_tax FROM pb"),
    "ml2_standardize": (f"WITH pb AS ({g.PB}), s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, "
                        "avg(l_extendedprice) AS me, stddev_pop(l_extendedprice) AS se FROM pb) "
                        f"SELECT l_orderkey, l_linenumber, {g.f32('(l_quantity - mq) / coalesce(nullif(sq, 0), 1)')} AS l_quantity, "
                        f"{g.f32('(l_extendedprice - me) / coalesce(nullif(se, 0), 1)')} AS l_extendedprice FROM pb, s"),
})

_ORD_FEATS = ["O_TOTALPRICE", "O_CUSTKEY", "FLAG_URGENT"] + [f"O_ORDERPRIORITY_{p}" for p in g.PRIOS] + [
    f"O_ORDERSTATUS_{s}" for s in g.STATS_]
# one aggregate for all features: equal indicators then get equal values
_IMP = ("WITH a AS (" + g.ALIGN_SQL + "), acc AS (SELECT *, CAST(\"O_TOTALPRICE\" > 250000 AS INTEGER) AS y FROM a "
        "WHERE reject_reason IS NULL), one AS MATERIALIZED (SELECT " + ", ".join(
            f"coalesce(abs(corr({g.qi(f)}::DOUBLE, y::DOUBLE)), 0.0) AS c{i}" for i, f in enumerate(_ORD_FEATS)) + " FROM acc), imp AS ("
        + " UNION ALL ".join(f"SELECT {g.lit(f)} AS feature, c{i} AS importance FROM one" for i, f in enumerate(_ORD_FEATS)) + ") ")
_CUM = (_IMP + ", c AS (SELECT feature, importance, sum(importance) OVER () AS tot, count(*) OVER () AS n FROM imp), "
        "c2 AS (SELECT feature, importance, CASE WHEN tot > 0 THEN importance / tot ELSE 1.0 / n END AS importance_norm FROM c), "
        "c3 AS (SELECT *, sum(importance_norm) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) AS cum, "
        "row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM c2) ")
_SEL = (_CUM + ", stop AS (SELECT min(rank) AS s FROM c3 WHERE cum >= 0.8) "
        "SELECT c3.* FROM c3, stop WHERE stop.s IS NULL OR rank <= stop.s")
ORACLE.update({
    "src5_importances": _IMP + f"SELECT feature, {g.f32('importance')} AS importance FROM imp",
    "win1_cumulative_importance": _CUM + (f"SELECT feature, {g.f32('importance')} AS importance, "
                                          f"{g.f32('importance_norm')} AS importance_norm, {g.f32('cum')} AS cum, "
                                          "CAST(rank AS INTEGER) AS rank FROM c3"),
    "win2_select_by_cumulative": f"SELECT feature FROM ({_SEL}) x",
    "ml13_ml14_requested_keys": (
        "WITH s AS (SELECT DISTINCT CASE WHEN feature LIKE 'O_ORDERPRIORITY\\_%' ESCAPE '\\' THEN 'O_ORDERPRIORITY' "
        "WHEN feature LIKE 'O_ORDERSTATUS\\_%' ESCAPE '\\' THEN 'O_ORDERSTATUS' ELSE feature END AS k FROM (" + _SEL + ") x), "
        "r AS (SELECT string_agg(k, ',' ORDER BY k) AS requested_groups, count(*) AS n FROM s) "
        f"SELECT requested_groups, CAST(n AS INTEGER) AS n_requested, CAST(13 AS INTEGER) AS n_allowed, "
        f"{g.f32('n / 13.0')} AS ratio, {g.f32('CASE WHEN n / 13.0 > 0.5 THEN 0.0 WHEN n / 13.0 < 0.1 THEN 0.3 WHEN n / 13.0 < 0.2 THEN 0.4 ELSE 0.5 END')} "
        "AS min_filled_rate_requested FROM r"),
})

_SEG = g.CATS["c_mktsegment"]
ORACLE.update({
    "prj1_prj2_drop_project": "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "prj3_filter_not_equal": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'",
    "prj4_prj5_abs_units": (f"SELECT c_custkey, {g.f32('abs(c_acctbal)')} AS acctbal_abs, {g.f32('c_acctbal / 365.0')} AS acctbal_per_day, "
                            f"{g.f32('c_acctbal / -365.0')} AS acctbal_per_day_neg FROM customer"),
    "prj6_prj7_sentinel": ("SELECT c_custkey, (c_nationkey IS NOT DISTINCT FROM 24) AS NATION_ANOM, "
                           "nullif(c_nationkey, 24) AS c_nationkey FROM customer"),
    "prj8_ratio_features": ("SELECT l_orderkey, l_linenumber, "
                            f"{g.f32('l_extendedprice / nullif(l_quantity, 0)')} AS UNIT_PRICE, "
                            f"{g.f32('l_discount / nullif(l_tax, 0)')} AS DISCOUNT_TAX_PERC, "
                            f"{g.f32('l_tax / nullif(l_discount, 0)')} AS TAX_DISCOUNT_PERC, "
                            f"{g.f32('l_quantity / nullif(l_linenumber, 0)')} AS QTY_PER_LINE, "
                            f"{g.f32('l_extendedprice / nullif(l_orderkey, 0)')} AS PRICE_PER_KEY FROM lineitem"),
    "prj9_label_encode": ("SELECT l_orderkey, l_linenumber, CAST(CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS INTEGER) "
                          "AS l_linestatus, l_returnflag, CASE WHEN l_shipdate < TIMESTAMP '1996-01-01 00:00:00' THEN 'train' "
                          "ELSE 'test' END AS side FROM lineitem"),
    "prj10_one_hot": ("SELECT c_custkey, c_nationkey, " + g.f32("c_acctbal") + " AS c_acctbal, " + ", ".join(
        f"CAST(c_mktsegment IS NOT DISTINCT FROM {g.lit(v)} AS INTEGER) AS {g.qi('c_mktsegment_' + v)}" for v in _SEG)
        + " FROM customer"),
    "prj11_one_hot_with_nan": ("SELECT o_orderkey, " + ", ".join(
        [f"CAST(o_orderstatus IS NOT DISTINCT FROM {g.lit(v)} AS INTEGER) AS {g.qi('o_orderstatus_' + v)}" for v in g.CATS["o_orderstatus"]]
        + ["CAST(o_orderstatus IS NULL AS INTEGER) AS o_orderstatus_nan"]
        + [f"CAST(o_orderpriority IS NOT DISTINCT FROM {g.lit(v)} AS INTEGER) AS {g.qi('o_orderpriority_' + v)}" for v in g.CATS["o_orderpriority"]]
        + ["CAST(o_orderpriority IS NULL AS INTEGER) AS o_orderpriority_nan"]) + " FROM orders"),
    "prj12_align_train_test": " UNION ALL ".join(
        "SELECT c_custkey, c_nationkey, c_acctbal, " + ", ".join(
            f"CAST(c_mktsegment IS NOT DISTINCT FROM {g.lit(v)} AS INTEGER) AS {g.qi('c_mktsegment_' + v)}" for v in _SEG if v != "MACHINERY")
        + f", '{side}' AS side FROM customer{where}" for side, where in (("train", ""), ("test", " WHERE c_mktsegment <> 'MACHINERY'"))),
    "prj13_column_difference": ("SELECT 'left_only' AS side, 'c_mktsegment_MACHINERY' AS \"column\", "
                                "count(*) FILTER (c_mktsegment = 'MACHINERY') AS n_set FROM customer"),
    "prj14_reindex_union": (f"SELECT o_orderkey, {g.f32('o_totalprice')} AS o_totalprice, NULL::VARCHAR AS o_orderstatus, 'ref' AS side "
                            "FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01 00:00:00' UNION ALL "
                            "SELECT o_orderkey, NULL::DOUBLE, o_orderstatus, 'prod' FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01 00:00:00'"),
})

ORACLE.update({
    "agg6_latency_summary": ("WITH e AS (SELECT event_type AS model_version, value AS latency_ms FROM events), "
                             "r AS (SELECT model_version, latency_ms, row_number() OVER (PARTITION BY model_version ORDER BY latency_ms) AS rn, "
                             "count(*) OVER (PARTITION BY model_version) AS n FROM e) "
                             f"SELECT model_version, {g.f32('avg(latency_ms)')} AS mean, count(*) AS n, "
                             f"{g.f32('max(CASE WHEN rn = floor(0.95 * (n - 1)) + 1 THEN latency_ms END)')} AS p95 FROM r GROUP BY model_version"),
    "agg7_positive_rate": (f"SELECT 'orders-linear-v1' AS model_version, {g.f32('avg(CAST(p >= 0.5 AS INTEGER)::DOUBLE)')} AS pred_pos_rate, "
                           f"count(*) AS n FROM ({g.SCORED}) s"),
})

def _smote_sql() -> str:
    """Neighbours, the drawn pairs and the points on their segments, anew from the embeddings."""
    h = "md5(no::VARCHAR || '|smote|42')"
    made = ", ".join(f"{g.f32(f'x[{i + 1}] + gap * (y[{i + 1}] - x[{i + 1}])')} AS f{i}" for i in range(64))
    kept = ", ".join(f"{g.f32(f'e[{i + 1}]')} AS f{i}" for i in range(64))
    return (
        "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(label = 0 AS INTEGER) AS y FROM embeddings), "
        "m AS (SELECT vec_id, e, row_number() OVER (ORDER BY vec_id) - 1 AS rank FROM e WHERE y = 1), "
        "d AS (SELECT a.rank, a.e AS x, b.e AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS pos "
        "FROM m a JOIN m b ON a.vec_id <> b.vec_id), "
        "c AS (SELECT count(*) AS n, CAST(floor((SELECT count(*) FROM e WHERE y = 0) * 0.5) - count(*) AS BIGINT) AS n_new FROM m), "
        f"r AS (SELECT no, ('0x' || substr({h}, 1, 15))::BIGINT % (5 * (SELECT n FROM c)) AS pair, "
        f"('0x' || substr({h}, 16, 8))::BIGINT / 4294967296.0 AS gap FROM range((SELECT n_new FROM c)) t(no)) "
        f"SELECT vec_id, y, {kept}, false AS synthetic, CAST(NULL AS BIGINT) AS synthetic_no FROM e UNION ALL "
        f"SELECT NULL, 1, {made}, true, no FROM r JOIN d ON d.rank = r.pair // 5 AND d.pos = r.pair % 5 + 1")


ORACLE.update({
    "smp6_smote_neighbours": (
        "WITH m AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), "
        "d AS (SELECT a.vec_id, b.vec_id AS neighbour_id, list_distance(a.e, b.e) AS dist FROM m a JOIN m b ON a.vec_id <> b.vec_id), "
        "r AS (SELECT vec_id, neighbour_id, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour_id) AS pos FROM d) "
        "SELECT vec_id, CAST(pos AS INTEGER) AS pos, neighbour_id FROM r WHERE pos <= 5"),
    "smp6_smote_rows": _smote_sql(),
})

from checks.oracle_io import ORACLE_IO  # noqa: E402
from checks.oracle_ml import ORACLE_ML  # noqa: E402

ORACLE.update(ORACLE_IO | ORACLE_ML | {
    "agg3_four_children": g.four_children_sql(),
    "prf3_dtype_counts": f"SELECT dtype, count(*) AS n_columns, CAST(sum(non_null) AS BIGINT) AS n_values FROM ({ORACLE['prf1_table_info']}) i GROUP BY dtype",
    "top4_importances": _IMP + ("SELECT * FROM (SELECT feature, 'top' AS list FROM imp ORDER BY importance DESC, feature LIMIT 3) UNION ALL "
                                "SELECT feature, 'zero' FROM imp WHERE importance = 0"),
    "snk7_requested_report_file": "SELECT *, " + g.f32("0.8") + " AS target, 'orders' AS source FROM (" + ORACLE["ml13_ml14_requested_keys"] + ") r",
})
