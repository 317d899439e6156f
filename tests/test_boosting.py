"""ML7: trees by histograms against a plain grower; penalties, leaf counts, saving."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe.operators import boosting as B
from riskframe.plans import train as TR


def plain_trees(x, y, growth, bounds):
    """Best-first growth on all rows at once, one node at a time."""
    bins = np.stack([np.searchsorted(np.array(b), x[:, i], side="left") for i, b in enumerate(bounds)], axis=1)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    shrunk = lambda g: np.sign(g) * max(abs(g) - growth.reg_alpha, 0)
    score = lambda g, h: shrunk(g) ** 2 / (h + growth.reg_lambda)

    def best(rows, g, h):
        found = None
        for f in range(x.shape[1]):
            for b in range(len(bounds[f])):
                left = rows[bins[rows, f] <= b]
                right = rows[bins[rows, f] > b]
                if min(len(left), len(right)) < growth.min_child_samples or min(h[left].sum(), h[right].sum()) < growth.min_child_weight:
                    continue
                gain = score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[rows].sum(), h[rows].sum())
                if gain > growth.min_split_gain and (found is None or gain > found[0] + 1e-9 * abs(gain)):
                    found = (gain, f, b, left, right)
        return found
    for _ in range(growth.n_estimators):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        leaves = [(np.arange(len(y)), 0)]
        splits = {0: best(leaves[0][0], g, h)}
        ends = {0: leaves[0]}
        made = 0
        while len(ends) < growth.num_leaves:
            open_ = [n for n in ends if splits[n]]
            if not open_:
                break
            n = max(open_, key=lambda k: splits[k][0])
            _, _, _, left, right = splits[n]
            depth = ends.pop(n)[1] + 1
            for part in (left, right):
                made += 1
                ends[made] = (part, depth)
                splits[made] = best(part, g, h) if growth.max_depth < 1 or depth < growth.max_depth else None
        for rows, _ in ends.values():
            margin[rows] += growth.learning_rate * -shrunk(g[rows].sum()) / (h[rows].sum() + growth.reg_lambda)
    return 1 / (1 + np.exp(-margin))


def data(spark, n=400, p=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)).round(2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.3 > 0.4).astype(int)
    rows = spark.createDataFrame([(i, int(b), 1.0, [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))], "key long, y int, w double, x array<double>")
    return x, y, rows.repartition(5)


@pytest.mark.parametrize("growth", [
    B.Growth(n_estimators=4, learning_rate=0.3, num_leaves=7, min_child_samples=5, store_every=2),
    B.Growth(n_estimators=2, num_leaves=31, max_depth=3, min_child_samples=10, reg_alpha=1.0, reg_lambda=5.0),
    B.Growth(n_estimators=2, num_leaves=4, min_child_samples=30, min_split_gain=2.0)])
def test_trees_equal_plain_growth(spark, growth):
    x, y, rows = data(spark)
    bounds = [sorted(np.quantile(x[:, i], np.linspace(0.1, 0.9, 9)).tolist()) for i in range(x.shape[1])]
    spec = B.fit_trees(rows, growth, bounds)
    model = B.BoostedTreesModel(trees=B.json.dumps(spec))
    scored = model.transform(rows.withColumn("features", array_to_vector("x"))).select("key", vector_to_array("probability")[1].alias("p"))
    got = np.array([r.p for r in scored.orderBy("key").collect()])
    assert np.allclose(got, plain_trees(x, y, growth, bounds), atol=1e-9)


def test_penalties_and_leaves(spark):
    _, _, rows = data(spark)
    ends = lambda **k: B.fit_trees(rows, B.Growth(n_estimators=1, learning_rate=1.0, min_child_samples=5, **k))["trees"][0]["values"].values()
    assert len(ends(num_leaves=6)) == 6
    assert max(map(abs, ends(num_leaves=6, reg_lambda=50.0))) < max(map(abs, ends(num_leaves=6)))
    assert list(ends(num_leaves=6, reg_alpha=1e6)) == [0.0]


def test_forest_tree_equals_plain_gini(spark):
    """One tree on all rows and columns against a recursive grower by Gini impurity."""
    x, y, rows = data(spark, n=300, p=4)
    bounds = [sorted(np.quantile(x[:, i], np.linspace(0.1, 0.9, 9)).tolist()) for i in range(4)]
    bins = np.stack([np.searchsorted(np.array(b), x[:, i], side="left") for i, b in enumerate(bounds)], axis=1)
    growth = B.Growth(objective="mean", n_estimators=1, learning_rate=1.0, num_leaves=1 << 30, max_depth=6, min_child_samples=3, min_child_weight=0.0,
                      min_samples_split=25)
    spec = B.fit_trees(rows, growth, bounds)
    gini = lambda r: 2 * y[r].mean() * (1 - y[r].mean()) * len(r) if len(r) else 0.0
    p = np.zeros(len(y))

    def grow(r, depth):
        best = None
        if len(r) >= 25 and depth < 6 and 0 < y[r].mean() < 1:
            for f in range(4):
                for b in range(9):
                    left, right = r[bins[r, f] <= b], r[bins[r, f] > b]
                    if min(len(left), len(right)) >= 3:
                        gain = gini(r) - gini(left) - gini(right)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9 * gain):
                            best = (gain, left, right)
        if best is None:
            p[r] = y[r].mean()
        else:
            grow(best[1], depth + 1)
            grow(best[2], depth + 1)
    grow(np.arange(len(y)), 0)
    model = B.BoostedTreesModel(trees=B.json.dumps(spec))
    got = model.transform(rows.withColumn("features", array_to_vector("x"))).select("key", vector_to_array("probability")[1].alias("p")).orderBy("key").collect()
    assert np.allclose([r.p for r in got], p, atol=1e-9)
    assert all(spec["trees"][0]["counts"][n] >= 25 for n in spec["trees"][0]["splits"])


def test_forest_with_least_split(spark):
    x, y, rows = data(spark)
    table = rows.select(F.col("key").alias("vec_id"), "y", *[F.col("x")[i].alias(f"f{i}") for i in range(5)])
    feats = [f"f{i}" for i in range(5)]
    res = TR.run_model(TR.random_forest(6, min_samples_split=40, balanced=True), table, table, feats)
    spec = res["model"].spec()
    assert len(spec["trees"]) == 6 and res["train_auc"] > 0.8
    for tree in spec["trees"]:
        assert all(tree["counts"][n] >= 40 for n in tree["splits"])
    assert len({str(t["splits"]) for t in spec["trees"]}) == 6


def test_draws_of_rows_and_columns_are_repeatable(spark):
    _, _, rows = data(spark)
    grow = lambda seed: B.fit_trees(rows, B.Growth(n_estimators=2, num_leaves=5, subsample=0.5, colsample_bytree=0.4, random_state=seed))["trees"]
    assert grow(1) == grow(1) != grow(2)


def test_missing_values_and_single_class(spark):
    rows = spark.createDataFrame([(i, 1, 1.0, [None, float(i)]) for i in range(50)], "key long, y int, w double, x array<double>")
    spec = B.fit_trees(rows, B.Growth(n_estimators=2))
    assert spec["bounds"][0] == [] and not spec["trees"][0]["splits"]
    with pytest.raises(ValueError):
        B.fit_trees(rows.limit(0), B.Growth())


def test_saved_pipeline_scores_the_same(spark, tmp_path):
    x, y, rows = data(spark)
    table = rows.select(F.col("key").alias("vec_id"), "y", *[F.col("x")[i].alias(f"f{i}") for i in range(5)])
    feats = [f"f{i}" for i in range(5)]
    est = TR.gradient_boosting(n_estimators=3, num_leaves=5, reg_lambda=1.0, min_child_samples=5)
    TR.final_refit(est, table, feats, str(tmp_path / "m"), {"threshold": 0.5})
    loaded = TR.load_and_score(str(tmp_path / "m"), table)
    direct = TR.run_model(est, table, table, feats)
    want = {r.vec_id: r.p for r in TR.positive_proba(direct["model"], direct["prep"].apply(table)).collect()}
    got = {r.vec_id: r.p for r in loaded.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    imp = TR.importances(spark, direct["model"], feats).collect()
    assert imp[0].importance > 0 and len(imp) == 5
    with pytest.raises(ValueError):
        TR.gradient_boosting(num_leaves=5, colour=1)


def test_search_prepares_once_and_folds_agree_with_sql(spark, monkeypatch):
    """Ten draws, one preparation per fold; fold metrics anew by DuckDB from the out-of-fold rows."""
    import duckdb

    from riskframe.plans.tables import Tables
    from tests.conftest import SF_CHECK
    rows, feats = TR.embedding_matrix(Tables(spark, SF_CHECK))
    feats = feats[:6]
    made = []
    prepare = TR.prepare
    monkeypatch.setattr(TR, "prepare", lambda *a, **k: made.append(1) or prepare(*a, **k))
    best, results = TR.random_search(lambda C: TR.logistic_regression(C, max_iter=5), {"C": [10.0 ** -k for k in range(10)]}, rows, feats, 10, 2)
    assert len(made) == 2 and len(results) == 10 and best["ap_mean_cv"] == max(r["ap_mean_cv"] for r in results)
    folds = TR.prepare_folds(rows, feats, n_splits=3)
    res = TR.run_model_cv(TR.logistic_regression(0.1, balanced=True), rows, feats, folds=folds)
    oof = res["oof"].toPandas()
    assert sorted(oof.vec_id) == sorted(r.vec_id for r in rows.select("vec_id").collect())
    want = duckdb.sql("""WITH d AS (SELECT fold, y, p, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS r FROM oof)
        SELECT fold + 1, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)),
        2.0 * count(*) FILTER (y = 1 AND p >= 0.5) / (2.0 * count(*) FILTER (y = 1 AND p >= 0.5) + count(*) FILTER (y = 0 AND p >= 0.5) + count(*) FILTER (y = 1 AND p < 0.5))
        FROM d GROUP BY fold ORDER BY fold""").fetchall()
    got = [(r.fold, r.auc, r.f1) for r in res["folds"].orderBy("fold").collect()]
    assert np.allclose(np.array(got), np.array(want, dtype=float), atol=1e-9)


def test_logistic_gradient_vanishes(spark):
    """ML4: at the returned weights the penalised loss has no slope."""
    from riskframe.plans.tables import Tables
    from tests.conftest import SF_CHECK
    rows, feats = TR.embedding_matrix(Tables(spark, SF_CHECK))
    feats = feats[:8]
    C = 0.5
    prep = TR.prepare(rows, feats)
    prepared = prep.apply(rows)
    model = TR.fit_estimator(TR.logistic_regression(C), prepared)
    table = prepared.select("y", vector_to_array("features").alias("x")).collect()
    x, y = np.array([r.x for r in table]), np.array([r.y for r in table])
    w, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(C * x.T @ (p - y) + w).max() < 1e-2 and abs((p - y).sum()) < 1e-2
