"""Sources/sinks round trips, CSV scoring, catalogue, run log, search and refit."""

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from riskframe.operators import drift as D
from riskframe.operators.align import feature_catalogue
from riskframe.operators.importance import requested_keys
from riskframe.plans import scoring as SCR
from riskframe.plans import train as TR
from riskframe.plans.tables import Tables
from riskframe.sources import sinks as SK
from riskframe.sources.tables import (InputFileError, compact_rows_from_columns, limit_rows, read_csv_table,
                                      read_importances, read_scoring_csv)
from tests.conftest import SF_CHECK, SF_SMALL


def test_csv_scan_limit_and_nan_cleaning(spark):
    base = tempfile.mkdtemp(prefix="rf-csv-")
    spark.createDataFrame([(1, "NaN", "x"), (2, "2.5", "y")], "k int, v string, c string") \
        .write.option("header", True).csv(f"{base}/t")
    df = read_csv_table(spark, f"{base}/t")
    got = {r.k: r.v for r in df.collect()}
    assert got[1] is None and got[2] == 2.5
    assert limit_rows(df, 1).count() == 1


def test_scoring_csv_path_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="rf-sc5-")
    t = Tables(spark, SF_SMALL)
    rows = SCR.compact_order_rows(t)
    wide = rows.select("row_index", *[F.col("features")[k].alias(k) for k in
                                      ["O_TOTALPRICE", "O_CUSTKEY", "FLAG_URGENT", "O_ORDERPRIORITY", "O_ORDERSTATUS"]])
    wide.coalesce(1).write.option("header", True).csv(f"{base}/in.csv")
    csv = read_scoring_csv(spark, f"{base}/in.csv")
    compact = compact_rows_from_columns(csv, [], row_id="row_index").withColumn(
        "row_index", F.col("row_index").cast("long"))
    # CSV has no per-row key set: an empty cell is a missing value, as in the reference
    log_csv, _ = SCR.predict_batch(compact, SCR.order_spec(), SCR.order_model(), SCR.order_rule(), strict=False,
                                   deterministic=True)
    log_map, _ = SCR.predict_batch(rows, SCR.order_spec(), SCR.order_model(), SCR.order_rule(), strict=False,
                                   deterministic=True)
    a = {r.log_seq: r.proba_default for r in log_csv.collect()}
    b = {r.log_seq: r.proba_default for r in log_map.collect()}
    assert a == b
    with pytest.raises(InputFileError):
        read_scoring_csv(spark, f"{base}/in.txt")


def test_drift_report_document_and_sinks(spark):
    base = tempfile.mkdtemp(prefix="rf-snk-")
    ref = spark.createDataFrame([(1.0, "x"), (2.0, "y"), (3.0, "x")], "A double, B string")
    prod = spark.createDataFrame([(1.0, "x"), (5.0, "z")], "A double, B string")
    rep = D.compute_drift(ref, prod)
    doc = D.report_document(rep, {"prod_limit": 2000})
    SK.write_drift_report(doc, f"{base}/drift", rep)
    got = json.loads(spark.read.text(f"{base}/drift/report").first()[0])
    assert got["n_ref_rows"] == 3 and got["n_prod_rows"] == 2 and got["features_total"] == 2
    assert [f["feature"] for f in got["all_features"]] == ["A", "B"]
    assert got["thresholds"] == {"psi_low": 0.1, "psi_medium": 0.2, "psi_high": 0.3}
    SK.write_reference_sample(Tables(spark, SF_SMALL).orders, "o_orderkey", f"{base}/sample", n=50)
    assert spark.read.option("header", True).csv(f"{base}/sample").count() == 50


def test_catalogue_and_requested_config(spark):
    base = tempfile.mkdtemp(prefix="rf-cat-")
    spec = SCR.order_spec()
    cat = {r.key: r for r in feature_catalogue(spark, spec).collect()}
    assert cat["O_ORDERPRIORITY"].n_dummies == 5 and "1-urgent" in cat["O_ORDERPRIORITY"].examples
    imp = read_importances(spark.createDataFrame(
        [("O_TOTALPRICE", "0.7"), ("O_ORDERPRIORITY_1-URGENT", "0.2"), ("FLAG_URGENT", "bad")], "feature string, importance string"))
    rep = requested_keys(imp, spec, 0.8)
    SK.write_requested_config(spark, rep, f"{base}/req")
    row = rep.first()
    assert row.requested_groups == ["O_ORDERPRIORITY", "O_TOTALPRICE"]
    assert row.min_filled_rate_requested == 0.4   # 2 of 13 keys -> ratio in [0.1, 0.2)


def test_run_log_and_champion(spark):
    base = tempfile.mkdtemp(prefix="rf-runs-")
    log = TR.RunLog(f"{base}/runs", "exp")
    log.start("cv_lgbm")
    log.log("tag", "model_version", "3")
    log.log("metric", "auc", 0.7)
    log.start("cv_lgbm")
    log.log("tag", "model_version", "5")
    log.flush(spark)
    runs = spark.read.parquet(f"{base}/runs")
    best = TR.resolve_run(runs, model_version="latest")
    assert best.filter("key = 'model_version'").first().value == "5"
    with pytest.raises(LookupError):
        TR.resolve_run(runs, run_id="nope")
    with pytest.raises(LookupError):
        TR.resolve_run(runs, model_version="latest", experiment="other")
    assert TR.resolve_run(runs, model_version="3").filter("key = 'auc'").count() == 1


def test_search_elimination_and_refit(spark):
    base = tempfile.mkdtemp(prefix="rf-fit-")
    data, feats = TR.embedding_matrix(Tables(spark, SF_CHECK))
    feats = feats[:8]
    best, allr = TR.random_search(lambda **p: TR.random_forest(**p), {"n_estimators": [5, 10], "max_depth": [2, 3]},
                                  data, feats, n_iter=2, n_splits=2)
    assert len(allr) == 2 and best["ap_mean_cv"] >= allr[-1]["ap_mean_cv"]
    kept, dropped = TR.eliminate_zero_importance(lambda: TR.random_forest(5, 2), data, feats, max_rounds=2)
    assert set(kept) | {f for d in dropped for f in d} == set(feats)
    meta = TR.final_refit(TR.logistic_regression(0.1, balanced=True), data, feats, f"{base}/model", {"threshold": 0.06}, smote_ratio=0.3)
    assert meta["feature_names"] == feats and len(meta["medians"]) == len(feats)
    scored = TR.load_and_score(f"{base}/model", data.withColumn(feats[0], F.when(F.col("vec_id") != 3, F.col(feats[0])))).collect()
    assert len(scored) == data.count() and all(0 <= r.p <= 1 for r in scored)


def test_estimator_parameters(spark):
    grid = {"num_leaves": [15, 31], "min_child_samples": [10, 20], "reg_lambda": [0.0, 1.0], "reg_alpha": [0.0]}
    draws = TR.draw_parameters(grid, 5)
    assert len({tuple(sorted(d.items())) for d in draws}) == 5 and TR.draw_parameters(grid, 100) and len(TR.draw_parameters(grid, 100)) == 8
    own = TR.gradient_boosting(**draws[0])
    assert json.loads(own.getOrDefault("growth")) == draws[0]
    gbt = TR.gradient_boosting(max_depth=4, min_child_samples=7)
    assert gbt.getMaxDepth() == 4 and gbt.getMinInstancesPerNode() == 7
    with pytest.raises(ValueError, match="colour"):
        TR.gradient_boosting(colour=1.0)
    deep = json.loads(TR.random_forest(max_depth=31, min_samples_split=9).getOrDefault("growth"))
    assert deep["max_depth"] == 31 and deep["min_samples_split"] == 9
    assert TR.random_forest(balanced=True).getWeightCol() == "weight" and TR.random_forest().getMaxDepth() == 30
    assert TR.logistic_regression(0.5)(200).getRegParam() == pytest.approx(0.01)


def test_resampling_in_folds_and_stable_keys(spark):
    data, feats = TR.embedding_matrix(Tables(spark, SF_SMALL))
    feats = feats[:4]
    rows = TR.resampled(data.select("vec_id", "y", *feats), feats, "vec_id", 0.5, 0.8, 42)
    a, b = (sorted(map(tuple, rows.collect())) for _ in range(2))
    assert a == b and len({r[0] for r in a}) == len(a) and any(r[0] < 0 for r in a)
    res = TR.run_model_cv(TR.logistic_regression(1.0), data, feats, "vec_id", 2, use_sampling=True, smote_ratio=0.5, use_under=True, under_ratio=0.8)
    assert res["oof"].count() == data.count() and res["oof"].where("vec_id < 0").count() == 0


def test_importance_lists(spark):
    imp = spark.createDataFrame([("a", 0.5), ("b", 0.0), ("c", 0.5), ("d", 0.0)], "feature string, importance double")
    assert [r.feature for r in TR.top_importances(imp, 2).collect()] == ["a", "c"]
    assert [r.feature for r in TR.zero_importances(imp).collect()] == ["b", "d"]
