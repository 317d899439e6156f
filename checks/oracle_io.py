"""DuckDB checks of the queries that write, stream or render and read back."""

from __future__ import annotations

from checks import sqlgen as g

_C = ("SELECT c_custkey AS line_no, c_custkey, c_name || ', \"the ' || (c_custkey % 3) || '\"' AS c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, "
      f"CASE WHEN c_custkey % 10 <> 4 THEN {g.f32('c_acctbal')} END AS c_acctbal, c_mktsegment FROM customer")
_OK = "c_custkey % 40 NOT IN (7, 11)"
_STATE = f"CASE WHEN o_orderkey % 50 = 3 THEN 'malformed_field_count' WHEN o_totalprice > 400000 THEN 'insufficient_filled_requested' END"


def _scored(reason: str) -> str:
    return (f"SELECT o_orderkey AS row_index, {reason} AS reject_reason, CASE WHEN ({reason}) IS NULL THEN {g.f32(g.PROBA)} END AS proba_default, "
            f"CASE WHEN ({reason}) IS NULL THEN CAST({g.PROBA} >= 0.5 AS INTEGER) END AS decision FROM orders")


_ROLL = g.orders_rollup_sql()
_DRIFT = g.drift_sql(g.ORDERS_DRIFT_BASE, g.ORDERS_DRIFT_FEATS)
_LISTS = " UNION ALL ".join(
    f"SELECT '{name}' AS list, CAST(row_number() OVER (ORDER BY {order}) - 1 AS INTEGER) AS pos, feature, psi, missing_rate_delta, severity FROM rep"
    for name, order in (("top_psi", "psi DESC NULLS LAST, feature"), ("top_missing_delta", "abs(missing_rate_delta) DESC NULLS LAST, feature"), ("all_features", "feature")))
_CUST = "CAST(o_custkey AS BIGINT)"
_RUNS = (f"w AS (SELECT DISTINCT o_custkey AS c, 'run-' || o_custkey AS run_id, (o_custkey % 997)::DOUBLE + o_custkey / 1e7 AS start_time FROM orders), "
         "pick AS (SELECT 'name' AS how, (SELECT c FROM w WHERE c % 5 = 2 ORDER BY start_time DESC LIMIT 1) AS c UNION ALL "
         "SELECT 'version', (SELECT c FROM w WHERE c % 3 = 1 AND c % 11 = 4 ORDER BY start_time DESC LIMIT 1) UNION ALL "
         "SELECT 'latest', (SELECT c FROM w WHERE c % 3 = 2 ORDER BY c % 11 DESC, start_time DESC LIMIT 1) UNION ALL SELECT 'id', 7) ")
_EX = {"O_ORDERPRIORITY": "1-urgent|2-high|3-medium|4-not specified|5-low", "O_ORDERSTATUS": "f|o|p"}
_KEYS = ["O_TOTALPRICE", "O_CUSTKEY", "FLAG_URGENT"] + [f"O_ORDERPRIORITY_{p}" for p in g.PRIOS] + [f"O_ORDERSTATUS_{s}" for s in g.STATS_]
_CATALOGUE = [(k, "group", n, _EX[k], True) for k, n in (("O_ORDERPRIORITY", 5), ("O_ORDERSTATUS", 3))] + [
    (k, "feature", None, None, k in ("O_TOTALPRICE", "O_CUSTKEY", "FLAG_URGENT")) for k in _KEYS]

ORACLE_IO: dict[str, str] = {
    "snk1_feature_table_files": f"SELECT *, 'parquet' AS source FROM ({_ROLL}) UNION ALL SELECT *, 'csv' FROM ({_ROLL})",
    "snk4_drift_report_files": (
        f"WITH rep AS ({_DRIFT}), l AS ({_LISTS}) SELECT list, pos, 'batch' AS generated_by, (SELECT max(ref_n) FROM rep) AS n_ref_rows, "
        "(SELECT max(prod_n) FROM rep) AS n_prod_rows, (SELECT count(*) FROM rep) AS features_total, feature, psi, missing_rate_delta, severity "
        "FROM l WHERE list = 'all_features' OR pos < 2"),
    "snk5_reference_sample_file": ("SELECT event_id, user_id, event_type, value FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || '|42') LIMIT 1000"),
    # the lenient switch turns off the rule of filled keys too: a missing price is the imputed one
    "sc6_lenient_scores": (f"SELECT o_orderkey AS row_index, {g.f32(g.PROBA)} AS proba_default, CAST({g.PROBA} >= 0.5 AS INTEGER) AS decision "
                           "FROM (SELECT * REPLACE (CASE WHEN o_totalprice > 400000 THEN 150000.0 ELSE o_totalprice END AS o_totalprice) FROM orders)"),
    "adp12_rules_of_metadata": " UNION ALL ".join(
        f"SELECT '{m}' AS meta, {reason} AS reject_reason, count(*) AS n FROM orders GROUP BY 2" for m, reason in (
            *((m, g.REJECT) for m in ("plain", "legacy", "clipped")),
            *((m, "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 'unknown_keys' END") for m in ("bad_share", "bad_list", "none")))),
    "adp14_feature_catalogue": " UNION ALL ".join(
        f"SELECT {g.lit(k)} AS key, '{kind}' AS kind, CAST({n if n is not None else 'NULL'} AS INTEGER) AS n_dummies, "
        f"{'CAST(NULL AS VARCHAR)' if ex is None else g.lit(ex)} AS examples, {'(SELECT count(*) FROM orders)' if named else 'CAST(0 AS BIGINT)'} AS n_requests"
        for k, kind, n, ex, named in _CATALOGUE),
    "exp1_exp2_champion_run": (
        f"WITH {_RUNS} SELECT how, 'run-' || c AS run_id, 'metric' AS kind, 'price' AS key, CAST(o_totalprice AS VARCHAR) AS value, CAST(o_orderkey AS INTEGER) AS step "
        "FROM pick JOIN orders ON o_custkey = c UNION ALL SELECT how, 'run-' || c, 'tag', 'model_name', 'model-' || (c % 3), NULL FROM pick "
        "UNION ALL SELECT how, 'run-' || c, 'tag', 'model_version', CAST(c % 11 AS VARCHAR), NULL FROM pick"),
    "src1_csv_rows": f"SELECT *, 'bigint,string,bigint,double,string' AS types FROM ({_C}) WHERE {_OK}",
    "src1_csv_malformed": ("SELECT c_custkey AS line_no, CASE WHEN c_custkey % 40 = 13 THEN 'invalid_value' ELSE 'field_count' END AS reason "
                           "FROM customer WHERE c_custkey % 40 IN (7, 11, 13)"),
    "src2_row_limited_scan": f"SELECT * FROM (SELECT * FROM ({_C}) ORDER BY line_no LIMIT 500) WHERE {_OK}",
    "src3_sc5_csv_scoring": _scored(_STATE),
    "snk2_snk3_log_transaction": (
        "SELECT row_number() OVER (ORDER BY row_index % 4, row_index) - 1 AS log_seq, 'b' || (row_index % 4) AS batch, row_index, "
        f"'orders-linear-v1' AS model_version, {g.f32('p')} AS proba_default, CAST(p >= 0.5 AS INTEGER) AS decision, DATE '2024-01-01' AS ds FROM ({g.SCORED}) s"),
    "str1_stream_scoring": _scored(g.REJECT),
}
