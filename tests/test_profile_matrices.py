"""PRF16 against the plain sum of kernels, PRF20 against pairwise-complete correlations."""

import math

import numpy as np

from riskframe.operators import profile as PR


def test_density_is_within_its_bound(spark):
    rng = np.random.default_rng(1)
    rows = [(c, float(v)) for c, v in zip(rng.choice(["a", None], 3_000).tolist(), rng.lognormal(1, 1.5, 3_000))] + [("flat", 2.0)] * 5 + [("a", None)]
    got = {}
    for r in PR.kde_by_class(spark.createDataFrame(rows, "cls string, v double"), "v", "cls", grid_size=50).collect():
        got.setdefault(r.cls, {})[r.gi] = (r.x, r.density)
    assert set(got) <= {"a", None, "flat"}
    for c in ("a", None):
        v = np.array([x for k, x in rows if k == c and x is not None])
        h = v.std(ddof=1) * len(v) ** -0.2
        assert sorted(got[c]) == list(range(50))
        for x, density in got[c].values():
            want = np.exp(-0.5 * ((x - v) / h) ** 2).sum() / (len(v) * h * math.sqrt(2 * math.pi))
            assert abs(density - want) <= 1 / (8 * PR.KDE_FINE ** 2 * h * math.sqrt(2 * math.pi)) + 1e-15
    assert all(d is None for _, d in got.get("flat", {}).values())


def test_density_shuffles_nodes_not_values(spark):
    """Ten times the distinct values, about as many nodes."""
    counts = []
    for n in (2_000, 20_000):
        df = spark.range(n).selectExpr("1 AS cls", f"id / {n}D AS v")
        counts.append((PR.kde_by_class(df, "v", "cls", grid_size=3, fine=8)).count())
        text = PR.kde_by_class(df, "v", "cls", grid_size=3, fine=8)._jdf.queryExecution().optimizedPlan().toString()
        assert "cell" in text
    assert counts == [3, 3]


def test_correlations_of_a_wide_table(spark):
    rng = np.random.default_rng(2)
    p, n = 130, 400  # 8,385 pairs, far more than one aggregate would hold
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) + 1e6
    x[:, 3] = 5.0
    gone = rng.random((n, p)) < 0.1
    gone[:, 7] = True
    rows = [tuple(None if g else float(v) for v, g in zip(a, b)) for a, b in zip(x, gone)]
    cols = [f"x.{i}" for i in range(p)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols))
    out = PR.corr_matrix(df, cols)
    got = {(r.row, r.col): r["corr"] for r in out.collect()}
    assert len(got) == p * (p - 1) // 2
    for i in range(p):
        for j in range(i):
            both = ~gone[:, i] & ~gone[:, j]
            have = got[cols[i], cols[j]]
            if not both.any() or 3 in (i, j) or 7 in (i, j):
                assert have is None
            else:
                assert abs(have - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-8
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_correlations_of_nothing(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert [tuple(r) for r in PR.corr_matrix(empty, ["a", "b"]).collect()] == [("b", "a", None)]


def test_kde_rows_are_not_shuffled_by_class(spark):
    """Classes are few and large: the rows stay in their tasks, the classes' bounds go to them."""
    from riskframe.operators import profile as PR
    df = spark.range(2_000).selectExpr("cast(id % 37 as double) AS v", "if(id % 5 = 0, null, id % 2) AS y")
    out = PR.kde_by_class(df, "v", "y", grid_size=5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    assert {(r.y, r.gi) for r in out.collect()} == {(y, g) for y in (None, 0, 1) for g in range(5)}
