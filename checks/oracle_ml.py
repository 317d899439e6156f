"""DuckDB checks of trained models: a tree grown anew, metrics anew from scored rows."""

from __future__ import annotations

from checks import sqlgen as g

_CUTS = [round(-0.25 + 0.05 * i, 2) for i in range(11)]
_BIN = " + ".join(f"CAST(x[f + 1] > {c!r} AS INTEGER)" for c in _CUTS)
_SHRUNK = lambda x: f"(sign({x}) * greatest(abs({x}) - 0.5, 0.0))"
_SCORE = lambda x, h: f"({_SHRUNK(x)} * {_SHRUNK(x)} / ({h} + 2.0))"


def _splits(name: str, rows: str) -> str:
    """CTEs that find the best split of every node of ``rows`` (node, f, b, g, h)."""
    return (f"{name}_h AS (SELECT node, f, k.b, coalesce(sum(r.g) FILTER (r.b = k.b), 0) AS g, coalesce(sum(r.h) FILTER (r.b = k.b), 0) AS h, "
            f"count(*) FILTER (r.b = k.b) AS n FROM {rows} r, range(0, 12) k(b) GROUP BY node, f, k.b), "
            f"{name}_c AS (SELECT node, f, b, sum(g) OVER l AS gl, sum(h) OVER l AS hl, sum(n) OVER l AS nl, sum(g) OVER a AS g, sum(h) OVER a AS h, sum(n) OVER a AS n "
            f"FROM {name}_h WINDOW l AS (PARTITION BY node, f ORDER BY b), a AS (PARTITION BY node, f)), "
            f"{name}_g AS (SELECT *, {_SCORE('gl', 'hl')} + {_SCORE('(g - gl)', '(h - hl)')} - {_SCORE('g', 'h')} AS gain FROM {name}_c "
            f"WHERE b < 11 AND nl >= 20 AND n - nl >= 20 AND hl >= 1e-3 AND h - hl >= 1e-3), "
            f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, f, b) AS best FROM {name}_g) WHERE best = 1)")


def tree_sql() -> str:
    leaf = f"-{_SHRUNK('sum(g)')} / (sum(h) + 2.0)"
    side = lambda s: f"CASE WHEN b_at <= {s}.b THEN 'L' ELSE 'R' END"
    return (
        "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CAST(label = 0 AS INTEGER) AS y FROM embeddings), "
        "m AS (SELECT avg(y) AS p FROM e), r AS (SELECT vec_id, x, p - y AS g, p * (1 - p) AS h FROM e, m), "
        f"l0 AS (SELECT 'R' AS node, vec_id, f, {_BIN} AS b, g, h FROM r, range(0, 64) t(f)), {_splits('s0', 'l0')}, "
        f"n1 AS (SELECT vec_id, 'R' || {side('s0').replace('b_at', 'l0.b')} AS node FROM l0 JOIN s0 ON l0.f = s0.f), "
        f"l1 AS (SELECT n1.node, l0.vec_id, l0.f, l0.b, g, h FROM l0 JOIN n1 USING (vec_id)), {_splits('s1', 'l1')}, "
        "w AS (SELECT * FROM s1 ORDER BY gain DESC LIMIT 1), "
        f"n2 AS (SELECT l1.vec_id, l1.node || {side('w').replace('b_at', 'l1.b')} AS node FROM l1 JOIN w ON l1.f = w.f AND l1.node = w.node), "
        "ends AS (SELECT n1.vec_id, coalesce(n2.node, n1.node) AS node FROM n1 LEFT JOIN n2 USING (vec_id)) "
        f"SELECT node, CAST(n AS BIGINT) AS n, 'f' || f AS feature, CAST(b AS INTEGER) AS bin, {g.f32('gain')} AS gain, CAST(NULL AS DOUBLE) AS value "
        f"FROM (SELECT * FROM s0 UNION ALL SELECT * FROM w) UNION ALL "
        f"SELECT node, count(*), NULL, NULL, NULL, {g.f32(leaf)} FROM r JOIN ends USING (vec_id) GROUP BY node")


ORACLE_ML: dict[str, str] = {"ml7_boosted_tree": tree_sql()}
