"""Helpers that write the DuckDB check queries.

The check queries are written independently of the Spark plans: column lists
and category values are spelled out here, not read from the library.
"""

from __future__ import annotations

STATS = ("MIN", "MAX", "MEAN", "SUM", "VAR")
SNAP_SCALE = 1.0000000441

# Fixed category values of the driver tables (TPC-H domains + event types).
CATS = {
    "c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "o_orderstatus": ["F", "O", "P"],
    "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "l_returnflag": ["A", "N", "R"],
    "l_linestatus": ["F", "O"],
    "event_type": ["click", "error", "purchase", "signup", "view"],
}


def qi(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def f32(expr: str) -> str:
    """Snap a double to float precision, like ``snap_doubles`` on the Spark side."""
    return f"(CAST(CAST(CAST(({expr}) AS DOUBLE) * {SNAP_SCALE} AS FLOAT) AS DOUBLE) / {SNAP_SCALE})"


def rollup_columns(prefix: str, numeric: list[str], cats: list[str]) -> list[str]:
    out = []
    for c in numeric:
        out += [f"{prefix}{c}_{s}" for s in STATS]
    for c in cats:
        out += [f"{prefix}{c}_{v}_MEAN" for v in CATS[c]] + [f"{prefix}{c}_nan_MEAN"]
    return out


def rollup_sql(source: str, key: str, prefix: str, numeric: list[str], cats: list[str], snap: bool = False) -> str:
    """AGG1 as plain SQL: one row per non-null key."""
    sel = [qi(key)]
    wrap = f32 if snap else (lambda e: e)
    for c in numeric:
        x = f"CAST({qi(c)} AS DOUBLE)"
        sel += [
            f"{wrap(f'min({x})')} AS {qi(prefix + c + '_MIN')}",
            f"{wrap(f'max({x})')} AS {qi(prefix + c + '_MAX')}",
            f"{wrap(f'avg({x})')} AS {qi(prefix + c + '_MEAN')}",
            f"{wrap(f'coalesce(sum({x}), 0.0)')} AS {qi(prefix + c + '_SUM')}",
            f"{wrap(f'var_samp({x})')} AS {qi(prefix + c + '_VAR')}",
        ]
    for c in cats:
        for v in CATS[c]:
            sel.append(f"{wrap(f'avg(CAST(({qi(c)} IS NOT DISTINCT FROM {lit(v)}) AS DOUBLE))')} "
                       f"AS {qi(prefix + c + '_' + v + '_MEAN')}")
        sel.append(f"{wrap(f'avg(CAST(({qi(c)} IS NULL) AS DOUBLE))')} AS {qi(prefix + c + '_nan_MEAN')}")
    return (f"SELECT {', '.join(sel)} FROM ({source}) AS src "
            f"WHERE {qi(key)} IS NOT NULL GROUP BY {qi(key)}")


def of_the_data(name: str) -> bool:
    """Values that no engine computes: smallest and largest ones, and the balance."""
    return name == "c_acctbal" or name.endswith(("_MIN", "_MAX")) and not any(s in name for s in ("_MEAN", "_SUM", "_VAR"))


def snap_select(inner: str, doubles: list[str], others: list[str]) -> str:
    cols = [qi(c) for c in others] + [qi(c) if of_the_data(c) else f"{f32(qi(c))} AS {qi(c)}" for c in doubles]
    return f"SELECT {', '.join(cols)} FROM ({inner}) AS s"


LI_NUM = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_CAT = ["l_returnflag", "l_linestatus"]
ORD_NUM = ["o_orderkey", "o_totalprice"]
ORD_CAT = ["o_orderstatus", "o_orderpriority"]
EVT_NUM = ["event_id", "value"]
EVT_CAT = ["event_type"]


def orders_rollup_sql() -> str:
    inner = rollup_sql("SELECT * FROM orders", "o_custkey", "ORD_", ORD_NUM, ORD_CAT)
    return snap_select(inner, rollup_columns("ORD_", ORD_NUM, ORD_CAT), ["o_custkey"])


def order_lines_sql() -> tuple[str, list[str]]:
    li = rollup_sql("SELECT * FROM lineitem", "l_orderkey", "LI_", LI_NUM, LI_CAT)
    li_cols = rollup_columns("LI_", LI_NUM, LI_CAT)
    child = (f"SELECT o.*, {', '.join('li.' + qi(c) for c in li_cols)} FROM orders o "
             f"LEFT JOIN ({li}) li ON o.o_orderkey = li.l_orderkey")
    num = ORD_NUM + li_cols
    inner = rollup_sql(child, "o_custkey", "ORD_", num, ORD_CAT)
    return inner, rollup_columns("ORD_", num, ORD_CAT)


def order_lines_rollup_sql() -> str:
    inner, cols = order_lines_sql()
    return snap_select(inner, cols, ["o_custkey"])


def feature_table_sql() -> str:
    ord_inner, ord_cols = order_lines_sql()
    evt = rollup_sql("SELECT * FROM events", "user_id", "EVT_", EVT_NUM, EVT_CAT)
    evt_cols = rollup_columns("EVT_", EVT_NUM, EVT_CAT)
    dummies = [f"CAST((c.c_mktsegment IS NOT DISTINCT FROM {lit(v)}) AS INTEGER) AS {qi('c_mktsegment_' + v)}"
               for v in CATS["c_mktsegment"]]
    inner = (
        "SELECT c.c_custkey, c.c_nationkey, c.c_acctbal, "
        "CAST(c.c_acctbal AS DOUBLE) / nullif(CAST(c.c_nationkey AS DOUBLE), 0) AS ACCTBAL_PER_NATION, "
        + ", ".join(dummies) + ", "
        + ", ".join("r." + qi(x) for x in ord_cols) + ", "
        + ", ".join("e." + qi(x) for x in evt_cols)
        + f" FROM customer c LEFT JOIN ({ord_inner}) r ON c.c_custkey = r.o_custkey"
        + f" LEFT JOIN ({evt}) e ON c.c_custkey = e.user_id"
    )
    doubles = ["c_acctbal", "ACCTBAL_PER_NATION"] + ord_cols + evt_cols
    others = ["c_custkey", "c_nationkey"] + ["c_mktsegment_" + v for v in CATS["c_mktsegment"]]
    return snap_select(inner, doubles, others)


def four_children_sql() -> str:
    sup_num, evt_num = ["s_suppkey", "s_acctbal"], EVT_NUM + ["props_k"]
    parts = [
        ("EVT_", "user_id", "c.c_custkey", "SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS props_k FROM events", evt_num, EVT_CAT),
        ("PREV_", "o_custkey", "c.c_custkey", "SELECT * FROM orders", ORD_NUM, ORD_CAT),
        ("INST_", "o_custkey", "c.c_custkey", "SELECT l.*, o_custkey FROM lineitem l JOIN orders ON l_orderkey = o_orderkey", ["l_orderkey", *LI_NUM], LI_CAT),
        ("SUP_", "s_nationkey", "c.c_nationkey", "SELECT * FROM supplier", sup_num, [])]
    select, joins, doubles = ["c.c_custkey", "c.c_nationkey", "c.c_name"], [], []
    for i, (prefix, key, parent, source, num, cat) in enumerate(parts):
        columns = rollup_columns(prefix, num, cat)
        doubles += columns
        select += [f"r{i}.{qi(x)}" for x in columns]
        joins.append(f"LEFT JOIN ({rollup_sql(source, key, prefix, num, cat)}) r{i} ON {parent} = r{i}.{qi(key)}")
    return snap_select(f"SELECT {', '.join(select)} FROM customer c {' '.join(joins)}", doubles, ["c_custkey", "c_nationkey", "c_name"])


# --- metrics ------------------------------------------------------------------
YP = ("d AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, l_extendedprice / 110000.0 AS p FROM lineitem), "
      "t AS (SELECT CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg FROM d), "
      "s AS (SELECT p, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM d GROUP BY p), "
      "c AS (SELECT p, pos, neg, CAST(sum(pos) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp, "
      "CAST(sum(neg) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp FROM s) ")


def rates_sql(cm: str) -> str:
    """precision/recall/f1/accuracy/bal_acc/pred_pos_rate from a (tn, fp, fn, tp) relation."""
    return (f"SELECT tn, fp, fn, tp, "
            f"{f32('coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0)')} AS precision, "
            f"{f32('coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0)')} AS recall, "
            f"{f32('coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0)')} AS f1, "
            f"{f32('(tp + tn)::DOUBLE / (tn + fp + fn + tp)')} AS accuracy, "
            f"{f32('CASE WHEN tn + fp = 0 THEN coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) WHEN tp + fn = 0 THEN tn::DOUBLE / (tn + fp) ELSE (tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2 END')} AS bal_acc, "
            f"{f32('(tp + fp)::DOUBLE / (tn + fp + fn + tp)')} AS pred_pos_rate FROM ({cm}) cm")


def cm_sql(thr: str) -> str:
    return (f"SELECT count(*) FILTER (WHERE y = 0 AND p < {thr}) AS tn, count(*) FILTER (WHERE y = 0 AND p >= {thr}) AS fp, "
            f"count(*) FILTER (WHERE y = 1 AND p < {thr}) AS fn, count(*) FILTER (WHERE y = 1 AND p >= {thr}) AS tp FROM d")


AUC_AP = (f"SELECT {f32('sum(neg * (tp - pos / 2.0)) / (max(n_pos)::DOUBLE * max(n_neg))')} AS auc, "
          f"{f32('sum(pos * (tp::DOUBLE / (tp + fp))) / max(n_pos)')} AS ap FROM c, t")


def thr_recall_sql(target: float, shifted: bool) -> str:
    r = "(tp - pos)::DOUBLE / n_pos" if shifted else "tp::DOUBLE / n_pos"
    pick = (f"SELECT coalesce((SELECT max(p) FROM c, t WHERE {r} >= {target}), "
            f"(SELECT p FROM c, t ORDER BY abs({r} - {target}), p LIMIT 1)) AS thr")
    return ("WITH " + YP + f", pick AS ({pick}) "
            f"SELECT {f32('(SELECT thr FROM pick)')} AS threshold, precision, recall, f1, tn, fp, fn, tp FROM ("
            + rates_sql(cm_sql("(SELECT thr FROM pick)")) + ") r")


GRID = ("g AS (SELECT i AS idx, CASE WHEN i = 199 THEN 0.5 ELSE i * ((0.5 - 0.01) / 199) + 0.01 END AS threshold "
        "FROM range(0, 200) r(i)), "
        "cc AS (SELECT g.idx, g.threshold, "
        "count(*) FILTER (WHERE d.y = 0 AND d.p >= g.threshold) AS fp, count(*) FILTER (WHERE d.y = 1 AND d.p < g.threshold) AS fn, "
        "count(*) FILTER (WHERE d.y = 0 AND d.p < g.threshold) AS tn, count(*) FILTER (WHERE d.y = 1 AND d.p >= g.threshold) AS tp "
        "FROM g, d GROUP BY g.idx, g.threshold) ")
COST_COLS = (f"CAST(idx AS BIGINT) AS idx, {f32('threshold')} AS threshold, {f32('1.0 * fp + 10.0 * fn')} AS total_cost, "
             f"{f32('(1.0 * fp + 10.0 * fn) / (tn + fp + fn + tp)')} AS avg_cost, tn, fp, fn, tp")


# --- drift ----------------------------------------------------------------------
NUM_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def drift_sql(base: str, feats: list[tuple[str, str, str]], bins: int = 10, top_k: int = 30) -> str:
    """DR8 in SQL.  ``base`` must expose a ``side`` column ('ref'/'prod');
    ``feats`` = (feature name, 'num' | 'str', SQL expression)."""
    parts = []
    for name, kind, expr in feats:
        if kind == "num":
            parts.append(
                f"SELECT side, {lit(name)} AS feature, CASE WHEN ({expr}) IS NULL OR isnan(({expr})::DOUBLE) THEN NULL "
                f"ELSE CAST(({expr}) AS VARCHAR) END AS v_str, "
                f"CASE WHEN isnan(({expr})::DOUBLE) OR isinf(({expr})::DOUBLE) THEN NULL ELSE ({expr})::DOUBLE END AS v_num, "
                f"(({expr}) IS NULL OR isnan(({expr})::DOUBLE)) AS raw_null FROM b")
        else:
            parts.append(
                f"SELECT side, {lit(name)} AS feature, ({expr})::VARCHAR AS v_str, "
                f"CASE WHEN regexp_full_match(trim(({expr})::VARCHAR), {lit(NUM_RE)}) THEN TRY_CAST(trim(({expr})::VARCHAR) AS DOUBLE) END AS v_num, "
                f"({expr}) IS NULL AS raw_null FROM b")
    import numpy as np
    probs = ", ".join(f"'{repr(float(x))}'::DOUBLE" for x in np.linspace(0, 1, bins + 1))
    lin = ", ".join([f"ref_min + {float(i)!r} * ((ref_max - ref_min) / {float(bins)!r})" for i in range(bins)] + ["ref_max"])
    term = "CASE WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN (greatest({a}, 1e-6) - greatest({b}, 1e-6)) * ln(greatest({a}, 1e-6) / greatest({b}, 1e-6)) END"
    a_num = "CASE WHEN ref_vals > 0 THEN coalesce(c_ref, 0) / ref_vals / ((CASE WHEN ref_vals > 0 THEN 1.0 ELSE 0.0 END) + (ref_n - ref_vals)::DOUBLE / ref_n) END"
    b_num = "CASE WHEN prod_vals > 0 THEN coalesce(c_prod, 0) / prod_vals / ((CASE WHEN prod_vals > 0 THEN 1.0 ELSE 0.0 END) + (prod_n - prod_vals)::DOUBLE / nullif(prod_n, 0)) END"
    m_ref = "((ref_n - ref_vals)::DOUBLE / ref_n) / ((CASE WHEN ref_vals > 0 THEN 1.0 ELSE 0.0 END) + (ref_n - ref_vals)::DOUBLE / ref_n)"
    m_prod = "((prod_n - prod_vals)::DOUBLE / nullif(prod_n, 0)) / nullif((CASE WHEN prod_vals > 0 THEN 1.0 ELSE 0.0 END) + (prod_n - prod_vals)::DOUBLE / nullif(prod_n, 0), 0)"
    c_ref = "(ref_vals::DOUBLE / nullif(ref_n, 0))"
    c_prod = "(prod_vals::DOUBLE / nullif(prod_n, 0))"
    return f"""WITH b AS ({base}),
long AS ({' UNION ALL '.join(parts)}),
st0 AS (SELECT feature,
  count(*) FILTER (WHERE side = 'ref') AS ref_n, count(*) FILTER (WHERE side = 'prod') AS prod_n,
  count(*) FILTER (WHERE side = 'ref' AND NOT raw_null) AS ref_nonnull, count(*) FILTER (WHERE side = 'prod' AND NOT raw_null) AS prod_nonnull,
  count(v_num) FILTER (WHERE side = 'ref') AS ref_vals, count(v_num) FILTER (WHERE side = 'prod') AS prod_vals,
  min(v_num) FILTER (WHERE side = 'ref') AS ref_min, max(v_num) FILTER (WHERE side = 'ref') AS ref_max
  FROM long GROUP BY feature),
st AS (SELECT *, (ref_nonnull = 0 OR ref_vals >= 0.95 * ref_nonnull) AS is_numeric FROM st0),
qs AS (SELECT feature, list_sort(list_distinct(quantile_cont(v_num, [{probs}]))) AS q
  FROM long WHERE side = 'ref' AND v_num IS NOT NULL GROUP BY feature),
e1 AS (SELECT st.feature, CASE WHEN len(q) < 3 THEN [{lin}] ELSE q END AS e
  FROM qs JOIN st USING (feature) WHERE is_numeric AND ref_min < ref_max),
e2 AS (SELECT feature, e[2:len(e) - 1] AS inner_e, len(e) - 1 AS n_bins FROM e1),
cnt AS (SELECT l.feature, l.side, len(list_filter(e2.inner_e, lambda x: x < l.v_num)) AS bin, count(*) AS c
  FROM long l JOIN e2 USING (feature) WHERE l.v_num IS NOT NULL GROUP BY ALL),
grid AS (SELECT feature, unnest(range(0, n_bins)) AS bin FROM e2),
wide AS (SELECT g.feature, g.bin, sum(c) FILTER (WHERE side = 'ref') AS c_ref, sum(c) FILTER (WHERE side = 'prod') AS c_prod
  FROM grid g LEFT JOIN cnt USING (feature, bin) GROUP BY ALL),
binpart AS (SELECT w.feature, sum({term.format(a=a_num, b=b_num)}) AS psi_bins FROM wide w JOIN st USING (feature) GROUP BY w.feature),
numpsi AS (SELECT st.feature, coalesce(psi_bins, 0.0) + {term.format(a=m_ref, b=m_prod)} AS psi
  FROM st JOIN e2 USING (feature) LEFT JOIN binpart USING (feature)
  UNION ALL
  SELECT feature, CASE WHEN ref_vals = 0 AND prod_vals = 0 THEN 0.0 ELSE
    {term.format(a=c_ref, b=c_prod)} + {term.format(a='1.0 - ' + c_ref, b='1.0 - ' + c_prod)} END
  FROM st WHERE is_numeric AND NOT coalesce(ref_min < ref_max, false)),
ccnt AS (SELECT l.feature, side, v_str, count(*) AS c FROM long l JOIN st USING (feature) WHERE NOT is_numeric GROUP BY ALL),
top AS (SELECT feature, v_str FROM (SELECT feature, v_str, row_number() OVER (PARTITION BY feature ORDER BY c DESC, v_str ASC NULLS LAST) AS r
  FROM ccnt WHERE side = 'ref') WHERE r <= {top_k}),
mapped AS (SELECT c.feature, c.side, c.c, CASE WHEN c.v_str IS NULL THEN 2 WHEN t.feature IS NOT NULL THEN 0 ELSE 1 END AS kind,
  CASE WHEN c.v_str IS NOT NULL AND t.feature IS NOT NULL THEN c.v_str END AS cat
  FROM ccnt c LEFT JOIN top t ON c.feature = t.feature AND c.v_str = t.v_str),
shares AS (SELECT feature, kind, cat, sum(c) FILTER (WHERE side = 'ref') AS c_ref, sum(c) FILTER (WHERE side = 'prod') AS c_prod
  FROM mapped GROUP BY ALL),
catpsi AS (SELECT s.feature, sum({term.format(a='coalesce(c_ref, 0)::DOUBLE / nullif(ref_n, 0)', b='coalesce(c_prod, 0)::DOUBLE / nullif(prod_n, 0)')}) AS psi
  FROM shares s JOIN st USING (feature) GROUP BY s.feature),
psi AS (SELECT * FROM numpsi UNION ALL SELECT * FROM catpsi),
rep AS (SELECT st.feature, CASE WHEN is_numeric THEN 'numeric' ELSE 'categorical' END AS type,
  CASE WHEN prod_n > 0 THEN psi.psi END AS psi,
  (ref_n - ref_nonnull)::DOUBLE / nullif(ref_n, 0) AS ref_missing_rate,
  (prod_n - prod_nonnull)::DOUBLE / nullif(prod_n, 0) AS prod_missing_rate,
  CASE WHEN ref_n > 0 AND prod_n > 0 THEN (prod_n - prod_nonnull)::DOUBLE / prod_n - (ref_n - ref_nonnull)::DOUBLE / ref_n END AS missing_rate_delta,
  CAST(ref_n AS BIGINT) AS ref_n, CAST(prod_n AS BIGINT) AS prod_n
  FROM st LEFT JOIN psi USING (feature))
SELECT feature, type, {f32('psi')} AS psi, {f32('ref_missing_rate')} AS ref_missing_rate, {f32('prod_missing_rate')} AS prod_missing_rate,
  {f32('missing_rate_delta')} AS missing_rate_delta, ref_n, prod_n,
  CASE WHEN psi IS NULL THEN NULL WHEN psi < 0.1 THEN 'low' WHEN psi < 0.2 THEN 'moderate' WHEN psi < 0.3 THEN 'high' ELSE 'severe' END AS severity
FROM rep"""


EVENTS_DRIFT_BASE = "SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'ref' ELSE 'prod' END AS side FROM events"
EVENTS_DRIFT_FEATS = [
    ("event_type", "str", "event_type"),
    ("value", "num", "value"),
    ("user_id", "num", "user_id"),
    ("k", "str", "json_extract_string(props, '$.k')"),
    ("value_ge10", "num", "CASE WHEN value < 10 THEN NULL ELSE value END"),
]
ORDERS_DRIFT_BASE = "SELECT *, CASE WHEN o_orderdate < TIMESTAMP '2000-01-01 00:00:00' THEN 'ref' ELSE 'prod' END AS side FROM orders"
ORDERS_DRIFT_FEATS = [
    ("o_orderstatus", "str", "o_orderstatus"),
    ("o_orderpriority", "str", "o_orderpriority"),
    ("o_totalprice", "num", "o_totalprice"),
    ("o_custkey", "num", "o_custkey"),
]


# --- profiling -------------------------------------------------------------------------
PB = ("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
      "nullif(l_discount, 0.0) AS l_discount, nullif(l_tax, 0.0) AS l_tax, nullif(l_returnflag, 'N') AS l_returnflag, "
      "l_linestatus FROM lineitem")
PB_COLS = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
           ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
           ("l_returnflag", "string"), ("l_linestatus", "string")]
PB_NUM = [c for c, t in PB_COLS if t != "string"]
PBY = ("SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, "
       "CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem")


def per_column(select_for, cols, source="pb"):
    return " UNION ALL ".join(select_for(c) for c in cols)


def null_counts_sql(cols):
    return "WITH pb AS (" + PB + ") " + " UNION ALL ".join(
        f"SELECT {lit(c)} AS column, count(*) FILTER (WHERE {qi(c)} IS NULL) AS null_count, "
        f"{f32(f'count(*) FILTER (WHERE {qi(c)} IS NULL) * 100.0 / count(*)')} AS null_pct FROM pb" for c in cols)


def describe_sql():
    return "WITH pb AS (" + PB + ") " + " UNION ALL ".join(
        f"SELECT {lit(c)} AS column, count({qi(c)}) AS count, {f32(f'avg({qi(c)})')} AS mean, "
        f"{f32(f'stddev_samp({qi(c)})')} AS std, {f32(f'min({qi(c)})')} AS min, "
        f"{f32(f'quantile_cont({qi(c)}, 0.25)')} AS p25, {f32(f'quantile_cont({qi(c)}, 0.5)')} AS p50, "
        f"{f32(f'quantile_cont({qi(c)}, 0.75)')} AS p75, {f32(f'max({qi(c)})')} AS max FROM pb" for c in PB_NUM)


def corr_label_sql():
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    return "WITH d AS (" + PBY + ") " + " UNION ALL ".join(
        f"SELECT {lit(c)} AS feature, {f32(f'corr({qi(c)}::DOUBLE, y::DOUBLE)')} AS corr FROM d" for c in cols)


def histogram_sql(col, bins):
    return (f"WITH pb AS ({PB}), d AS (SELECT {qi(col)}::DOUBLE AS v FROM pb WHERE {qi(col)} IS NOT NULL), "
            f"r AS (SELECT min(v) AS mn, max(v) AS mx FROM d), "
            f"b AS (SELECT least({bins - 1}, len(list_filter(list_transform(range(1, {bins}), lambda j: mn + j * ((mx - mn) / {float(bins)!r})), lambda e: v >= e))) AS bin "
            f"FROM d, r), c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin), "
            f"g AS (SELECT i AS bin, CASE WHEN i = 0 THEN mn ELSE mn + i * ((mx - mn) / {float(bins)!r}) END AS lower, "
            f"CASE WHEN i + 1 = {bins} THEN mx ELSE mn + (i + 1) * ((mx - mn) / {float(bins)!r}) END AS upper FROM range(0, {bins}) t(i), r) "
            f"SELECT CAST(g.bin AS INTEGER) AS bin, {f32('lower')} AS lower, {f32('upper')} AS upper, CAST(coalesce(n, 0) AS BIGINT) AS count "
            f"FROM g LEFT JOIN c ON g.bin = c.bin")


KDE_SQL = (f"WITH d AS ({PBY}), st AS (SELECT y, count(l_quantity) AS n, stddev_samp(l_quantity) AS sd, "
           "min(l_quantity) AS mn, max(l_quantity) AS mx FROM d GROUP BY y), "
           "st2 AS (SELECT *, sd * pow(n::DOUBLE, -0.2) AS h FROM st), "
           "st3 AS (SELECT *, mn - 3.0 * h AS lo, mx + 3.0 * h AS hi FROM st2), "
           "g AS (SELECT y, gi, CASE WHEN gi = 199 THEN hi ELSE lo + gi::DOUBLE * ((hi - lo) / 199.0) END AS x, n, h "
           "FROM st3, range(0, 200) r(gi)), "
           # linear binning on nodes of h / 256
           "b AS (SELECT d.y, lo, h, (l_quantity - lo) / (h / 256.0) AS pos FROM d JOIN st3 ON d.y = st3.y), "
           "nodes AS (SELECT y, lo + floor(pos) * (h / 256.0) AS node, 1 - (pos - floor(pos)) AS w FROM b UNION ALL "
           "SELECT y, lo + (floor(pos) + 1) * (h / 256.0), pos - floor(pos) FROM b), "
           "k AS (SELECT y, node, sum(w) AS w FROM nodes GROUP BY y, node) "
           f"SELECT g.y, CAST(gi AS INTEGER) AS gi, {f32('x')} AS x, "
           f"{f32('sum(w * exp(-0.5 * ((x - node) / h) * ((x - node) / h))) / (max(n) * max(h) * sqrt(2 * pi()))')} AS density "
           "FROM g JOIN k ON g.y = k.y GROUP BY g.y, gi, x")


def fixed_bins_sql():
    import numpy as np
    edges = [float(x) for x in np.linspace(0, 50, 11)]
    idx = " + ".join(f"CAST(l_quantity > {e!r} AS INTEGER)" for e in edges[:-1])
    grid = " UNION ALL ".join(f"SELECT {i} AS bin, {edges[i]!r} AS lower, {edges[i + 1]!r} AS upper" for i in range(10))
    return (f"WITH pb AS ({PB}), d AS (SELECT CASE WHEN l_quantity > {edges[0]!r} AND l_quantity <= {edges[-1]!r} "
            f"THEN {idx} - 1 END AS bin, l_extendedprice, l_discount FROM pb), "
            "m AS (SELECT bin, count(*) AS n_rows, avg(l_extendedprice) AS me, avg(l_discount) AS md FROM d WHERE bin IS NOT NULL GROUP BY bin), "
            f"g AS ({grid}) "
            f"SELECT CAST(g.bin AS INTEGER) AS bin, {f32('lower')} AS lower, {f32('upper')} AS upper, "
            f"CAST(coalesce(n_rows, 0) AS BIGINT) AS n_rows, {f32('me')} AS l_extendedprice_mean, {f32('md')} AS l_discount_mean "
            "FROM g LEFT JOIN m ON g.bin = m.bin")


# --- alignment / scoring on orders ------------------------------------------------------------
PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATS_ = ["F", "O", "P"]
_FLAG = "CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END"
ALIGN_COLS = (
    "o_orderkey AS row_index, CASE WHEN o_totalprice > 400000 THEN NULL ELSE o_totalprice END AS \"O_TOTALPRICE\", "
    f"o_custkey::DOUBLE AS \"O_CUSTKEY\", CAST({_FLAG} AS DOUBLE) AS \"FLAG_URGENT\", "
    + ", ".join(f"CAST(o_orderpriority = {lit(p)} AS DOUBLE) AS {qi('O_ORDERPRIORITY_' + p)}" for p in PRIOS) + ", "
    + ", ".join(f"CAST(o_orderstatus = {lit(s)} AS DOUBLE) AS {qi('O_ORDERSTATUS_' + s)}" for s in STATS_))
REJECT = ("CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 'unknown_keys' "
          "WHEN o_totalprice > 400000 THEN 'insufficient_filled_requested' END")
NMISS = "CAST(CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END AS INTEGER)"
ALIGN_SQL = (f"SELECT {ALIGN_COLS}, CAST(11 AS INTEGER) AS n_features, {NMISS} AS n_missing, "
             f"{f32(NMISS + ' / 11.0')} AS missing_rate, CAST(3 - {NMISS} AS INTEGER) AS filled_count, "
             f"{REJECT} AS reject_reason FROM orders")
# requests that are wrong in every way the checks know
_IS = lambda s, p: f"(o_orderstatus = {lit(s)} AND o_orderpriority = {lit(p)})"
_FEW = "o_totalprice > 400000"
REJECT_DETAIL_SQL = f"""SELECT o_orderkey AS row_index,
 CASE WHEN {_IS('P', '1-URGENT')} THEN 'invalid_input' WHEN {_IS('F', '5-LOW')} THEN 'unknown_keys'
      WHEN {_IS('O', '4-NOT SPECIFIED')} THEN 'invalid_category' WHEN {_IS('O', '3-MEDIUM')} THEN 'invalid_number'
      WHEN {_IS('F', '2-HIGH')} THEN 'invalid_binary' WHEN {_FEW} THEN 'insufficient_filled_requested' END AS reject_reason,
 CASE WHEN {_IS('P', '1-URGENT')} THEN NULL WHEN {_IS('F', '5-LOW')} THEN '{{"keys":["A_KEY","EXTRA_KEY"],"more":0}}'
      WHEN {_IS('O', '4-NOT SPECIFIED')} THEN '{{"group":"O_ORDERPRIORITY","value":"6-NEVER","examples":["1-urgent","2-high","3-medium","4-not specified","5-low"]}}'
      WHEN {_IS('O', '3-MEDIUM')} THEN '{{"key":"O_TOTALPRICE","value":"n/a?"}}'
      WHEN {_IS('F', '2-HIGH')} THEN '{{"key":"FLAG_URGENT","value":"maybe"}}'
      WHEN {_FEW} THEN '{{"requested_count":3,"filled_count":2,"min_filled_rate":1.0,"min_filled_count":3,"missing_first_20":["O_TOTALPRICE"]}}' END AS reject_detail,
 CAST(CASE WHEN {_IS('P', '1-URGENT')} THEN 0 ELSE 3 - CAST({_FEW} OR {_IS('O', '3-MEDIUM')} AS INTEGER) - CAST({_IS('O', '4-NOT SPECIFIED')} AS INTEGER) END AS INTEGER) AS filled_count,
 CAST(CASE WHEN {_IS('P', '1-URGENT')} THEN 11 ELSE CAST({_FEW} OR {_IS('O', '3-MEDIUM')} AS INTEGER) + 5 * CAST({_IS('O', '4-NOT SPECIFIED')} AS INTEGER)
      + CAST({_IS('F', '2-HIGH')} AS INTEGER) END AS INTEGER) AS n_missing FROM orders"""
PAYLOAD_SQL = ("SELECT o_orderkey AS log_seq, TIMESTAMP '2024-01-01 00:00:00' AS ts_utc, '{\"O_TOTALPRICE\":' || CAST(o_totalprice AS VARCHAR) "
               "|| ',\"O_CUSTKEY\":' || CAST(o_custkey::DOUBLE AS VARCHAR) || ',\"FLAG_URGENT\":' || CAST(" + _FLAG + " AS VARCHAR)"
               + "".join(" || ',\"O_ORDERPRIORITY_" + p + "\":' || CAST(CAST(o_orderpriority = " + lit(p) + " AS DOUBLE) AS VARCHAR)" for p in PRIOS)
               + "".join(" || ',\"O_ORDERSTATUS_" + s + "\":' || CAST(CAST(o_orderstatus = " + lit(s) + " AS DOUBLE) AS VARCHAR)" for s in STATS_)
               + " || '}' AS input_json FROM orders WHERE (" + REJECT + ") IS NULL")
COEFS = [2e-6, -1e-5, 0.4, 0.3, 0.2, 0.0, -0.1, -0.2, 0.1, 0.0, -0.1]
_XS = (["o_totalprice", "o_custkey::DOUBLE", "CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END"]
       + [f"CAST(o_orderpriority = {lit(p)} AS DOUBLE)" for p in PRIOS] + [f"CAST(o_orderstatus = {lit(s)} AS DOUBLE)" for s in STATS_])
MARGIN = "(" + "-0.7" + "".join(f" + ({x}) * {c!r}" for x, c in zip(_XS, COEFS)) + ")"
PROBA = f"(1.0 / (1.0 + exp(-{MARGIN})))"
SCORED = (f"SELECT o_orderkey AS row_index, {PROBA} AS p FROM orders WHERE ({REJECT}) IS NULL")


# --- sampling -----------------------------------------------------------------------------------
EVY = "SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS y FROM events"
RANKED = ("r AS (SELECT event_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(CAST(event_id AS VARCHAR) || '|42')) AS rk FROM d)")


def quota_sql(total: str) -> str:
    return ("c AS (SELECT y, count(*) AS n_class FROM d GROUP BY y), "
            f"q0 AS (SELECT y, n_class, sum(n_class) OVER () AS n, {total} AS t FROM c), "
            "q1 AS (SELECT *, t * n_class / n AS ex FROM q0), "
            "q2 AS (SELECT *, floor(ex) AS base, ex - floor(ex) AS rem FROM q1), "
            "q3 AS (SELECT *, t - sum(base) OVER () AS lft, row_number() OVER (ORDER BY rem DESC, y) AS pos FROM q2), "
            "quota AS (SELECT y, base + CASE WHEN pos <= lft THEN 1 ELSE 0 END AS quota FROM q3)")
