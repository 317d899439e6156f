"""Training, cross-validation, search and selection (ML4-ML15, EV10, EXP1-EXP2).

Estimators are ``pyspark.ml`` ones; the driver only loops over folds, draws
and rounds, and each step is a distributed fit or aggregate.  Fold columns,
imputation medians and scaling come from the operators in this package so a
fold's preprocessing is fitted on that fold's training rows only.

Binding on the driver tables: ``embeddings`` (64 floats) with
``y = (label = 0)`` (about 10 % positives).
"""

from __future__ import annotations

import dataclasses
import json
import math
import random
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.expr import q
from riskframe.operators import metrics as M
from riskframe.operators.boosting import BoostedTrees, BoostedTreesModel, Growth
from riskframe.operators.preprocess import MedianImputer, Standardizer, class_weights
from riskframe.operators.sampling import stratified_folds, under_sample
from riskframe.operators.smote import smote
from riskframe.plans.tables import Tables
from riskframe.session import cut_lineage

# ---------------------------------------------------------------- estimators


def logistic_regression(C: float = 0.1, balanced: bool = False, max_iter: int = 1000):
    """ML4: L2 logistic regression; sklearn's C on a summed loss is
    regParam = 1 / (C * n) on Spark's averaged loss, so the estimator is made
    from the number of rows it is fitted on."""
    def for_rows(n_rows: int) -> LogisticRegression:
        lr = LogisticRegression(regParam=1.0 / (C * max(n_rows, 1)), elasticNetParam=0.0, maxIter=max_iter,
                                standardization=False, featuresCol="features", labelCol="y")
        return lr.setWeightCol(WEIGHT) if balanced else lr
    return for_rows


#: Spark's deepest tree.
MAX_DEPTH = 30


def random_forest(n_estimators: int = 100, max_depth: int | None = None, min_samples_leaf: int = 1, seed: int = 42,
                  balanced: bool = False, min_samples_split: int = 2):
    """ML6: without a depth limit trees grow to Spark's maximum.  A deeper limit, or a least size of split nodes beyond
    2 * min_samples_leaf, which Spark's forest lacks, is left to the forest of ``operators.boosting``."""
    if min_samples_split > 2 * min_samples_leaf or (max_depth or 0) > MAX_DEPTH:
        return BoostedTrees(growth=json.dumps({
            "objective": "mean", "n_estimators": n_estimators, "learning_rate": 1.0, "num_leaves": 1 << 30, "max_depth": max_depth or -1,
            "min_child_samples": min_samples_leaf, "min_child_weight": 0.0, "min_samples_split": min_samples_split, "bootstrap": True,
            "random_state": seed, "max_features": -1.0}), balanced=balanced)
    forest = RandomForestClassifier(numTrees=n_estimators, maxDepth=max_depth or MAX_DEPTH,
                                    minInstancesPerNode=min_samples_leaf, seed=seed,
                                    featuresCol="features", labelCol="y")
    return forest.setWeightCol(WEIGHT) if balanced else forest


GBT_PARAM_MAP = {"n_estimators": "maxIter", "learning_rate": "stepSize", "subsample": "subsamplingRate",
                 "max_depth": "maxDepth", "colsample_bytree": "featureSubsetStrategy", "random_state": "seed",
                 "min_child_samples": "minInstancesPerNode"}
#: What only the library's own boosted trees have: penalties on leaves, a number of leaves, a least gain.
OWN_BOOSTER = ("reg_alpha", "reg_lambda", "num_leaves", "min_split_gain", "min_child_weight")


def gradient_boosting(key: str = "", **params):
    """ML7: one estimator for the reference's boosters.

    With leaf penalties, ``num_leaves`` or the like the trees are those of ``operators.boosting`` (histograms, leaf-wise growth);
    else Spark's ``GBTClassifier``.  A parameter that neither has is refused by name."""
    if any(k in params for k in OWN_BOOSTER):
        known = {f.name for f in dataclasses.fields(Growth)}
        if bad := sorted(set(params) - known):
            raise ValueError(f"no parameter of boosted trees: {bad}")
        if "max_depth" in params and "num_leaves" not in params:  # depth-wise growth: as many leaves as the depth allows
            depth = int(params["max_depth"])
            params = {**params, "num_leaves": 1 << depth} if 0 < depth < 16 else params
        return BoostedTrees(growth=json.dumps(params), key=key)
    bad = [k for k in params if k not in GBT_PARAM_MAP]
    if bad:
        raise ValueError(f"no Spark GBT parameter for {bad}")
    kw = {GBT_PARAM_MAP[k]: str(v) if k == "colsample_bytree" else v for k, v in params.items()}
    if kw.get("maxDepth", 1) < 1:
        del kw["maxDepth"]  # "no limit" in the reference's boosters
    return GBTClassifier(featuresCol="features", labelCol="y", **kw)


WEIGHT = "weight"


def fit_estimator(estimator, train: DataFrame, rows: int | None = None):
    """Fit on prepared training rows: an estimator that depends on their number gets it, one with a weight column gets class weights
    (which rows may have already), any other does not see them."""
    if not isinstance(estimator, Estimator):
        estimator = estimator(train.count() if rows is None else rows)
    weighted = estimator.hasParam("weightCol") and estimator.isDefined("weightCol") and estimator.getOrDefault("weightCol") == WEIGHT
    if weighted and WEIGHT not in train.columns:
        train = class_weights(train, "y")
    return estimator.fit(train if weighted else train.drop(WEIGHT))


# ---------------------------------------------------------------- data


def embedding_matrix(t: Tables) -> tuple[DataFrame, list[str]]:
    """(vec_id, y, f0..f63) from the embeddings table."""
    e = t.embeddings
    n = 64
    cols = [F.element_at("embedding", i + 1).cast("double").alias(f"f{i}") for i in range(n)]
    return e.select("vec_id", (F.col("label") == 0).cast("int").alias("y"), *cols), [f"f{i}" for i in range(n)]


@dataclass
class Prepared:
    imputer: MedianImputer
    scaler: Standardizer
    features: list[str]

    def stages(self) -> list:
        """The same steps as savable pipeline stages: one projection, then the vector."""
        kept = [c for c in self.features if c not in self.imputer.dropped]

        def value(c: str) -> str:
            x = f"CAST({q(c)} AS DOUBLE)"
            x = f"coalesce({x}, {float(self.imputer.medians[c])!r}D)" if c in self.imputer.medians else x
            x = f"({x} - {float(self.scaler.means[c] or 0.0)!r}D)" if self.scaler.with_mean and c in self.scaler.means else x
            return f"{x} / {float(self.scaler.stds[c])!r}D" if c in self.scaler.stds else x
        sql = "SELECT *, " + ", ".join(f"{value(c)} AS {q('_x_' + c)}" for c in kept) + " FROM __THIS__"
        return [SQLTransformer(statement=sql), VectorAssembler(inputCols=["_x_" + c for c in kept], outputCol="features", handleInvalid="keep")]

    def apply(self, df: DataFrame) -> DataFrame:
        d = self.scaler.transform(self.imputer.transform(df))
        feats = [c for c in self.features if c not in self.imputer.dropped]
        return VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep").transform(d)


def prepare(train: DataFrame, features: list[str], with_mean: bool = True) -> Prepared:
    """ML1 + ML2 fitted on the training rows only."""
    imp = MedianImputer.fit(train, features)
    kept = [c for c in features if c not in imp.dropped]
    sc = Standardizer.fit(imp.transform(train), kept, with_mean)
    return Prepared(imp, sc, features)


def positive_proba(model, df: DataFrame) -> DataFrame:
    """SC1 for a fitted estimator."""
    out = model.transform(df)
    if "probability" not in out.columns:
        raise AttributeError(f"{type(model).__name__} gives no probability column")
    return out.withColumn("p", vector_to_array("probability")[1])


# ---------------------------------------------------------------- run log (EXP1)


@dataclass
class RunLog:
    """EXP1: runs, params, metrics and tags as a long table appended to Parquet."""

    path: str | None = None
    experiment: str = "default"
    rows: list[tuple] = field(default_factory=list)

    def start(self, run_name: str) -> str:
        rid = uuid.uuid4().hex
        self._current = (rid, run_name, time.time())
        return rid

    def log(self, kind: str, key: str, value, step: int | None = None):
        rid, name, t0 = self._current
        self.rows.append((self.experiment, rid, name, float(t0), kind, key, str(value), step))

    def frame(self, spark: SparkSession) -> DataFrame:
        schema = ("experiment string, run_id string, run_name string, start_time double, kind string, "
                  "key string, value string, step int")
        return spark.createDataFrame(self.rows, schema)

    def flush(self, spark: SparkSession):
        if self.path and self.rows:
            self.frame(spark).write.mode("append").parquet(self.path)
            self.rows = []


def resolve_run(runs: DataFrame, run_id: str | None = None, model_name: str | None = None, model_version: str | None = None,
                run_name: str | None = None, experiment: str | None = None) -> DataFrame:
    """EXP2: by id; else the run registered under the model name (tag ``model_name``) with the given version, or with the
    highest one (tag ``model_version``, a number); else the latest run with the name.  ``experiment`` narrows all of them.
    An empty result raises."""
    r = runs.filter(F.col("experiment") == experiment) if experiment else runs
    if run_id:
        out = r.filter(F.col("run_id") == run_id)
    elif model_name or model_version:
        tags = r.filter(F.col("kind") == "tag").groupBy("run_id", "start_time").agg(
            F.max(F.when(F.col("key") == "model_name", F.col("value"))).alias("name"),
            F.max(F.when(F.col("key") == "model_version", F.col("value").try_cast("long"))).alias("version"))
        out = tags.filter(F.col("version").isNotNull())
        out = out.filter(F.col("name") == model_name) if model_name else out
        out = out.filter(F.col("version") == int(model_version)) if model_version not in (None, "latest") else out
        out = out.orderBy(F.desc("version"), F.desc("start_time")).limit(1)
    else:
        out = r.filter(F.col("run_name") == run_name).orderBy(F.desc("start_time")).limit(1)
    first = out.select("run_id").first()
    if first is None:
        raise LookupError("no matching run")
    return r.filter(F.col("run_id") == first["run_id"])


# ---------------------------------------------------------------- fit and CV (ML8, ML9)


def run_model(estimator, train: DataFrame, valid: DataFrame, features: list[str], threshold: float = 0.5,
              log: RunLog | None = None, name: str = "run") -> dict:
    """ML8: fit on train (impute -> scale -> model), metrics on train and valid."""
    prep = prepare(train, features)
    model = fit_estimator(estimator, prep.apply(train))
    res = {}
    for prefix, d in (("train", train), ("valid", valid)):
        scored = positive_proba(model, prep.apply(d)).select("y", "p")
        res.update(M.metrics_dict(scored, threshold, prefix=f"{prefix}_"))
    if log:
        log.start(name)
        for k, v in res.items():
            log.log("metric", k, v)
    return {"model": model, "prep": prep, **res}


def resampled(rows: DataFrame, features: list[str], key: str, smote_ratio: float, under_ratio: float | None, seed: int) -> DataFrame:
    """Training rows after SMOTE and, if asked, under-sampling.  A synthetic row's key follows from its number, so a recomputed row
    keeps its key and its hash."""
    out = smote(rows, "y", key, features, smote_ratio, 5, seed)
    out = out.withColumn(key, F.coalesce(F.col(key), -F.col("synthetic_no") - 1)).drop("synthetic", "synthetic_no")
    return out if under_ratio is None else under_sample(out, "y", key, under_ratio, seed)


@dataclass
class Fold:
    """One fold's prepared rows: ``train`` and ``valid`` with their vector column, both stored; ``rows``: the number of training rows."""

    number: int
    train: DataFrame
    valid: DataFrame
    rows: int


def prepare_folds(data: DataFrame, features: list[str], key: str = "vec_id", n_splits: int = 3, seed: int = 42, use_sampling: bool = False,
                  smote_ratio: float = 1.0, use_under: bool = False, under_ratio: float = 1.0) -> list[Fold]:
    """Stratified folds with preprocessing and resampling fitted inside each training fold only (never on validation rows).

    Everything that does not depend on an estimator is done here, once, and stored, so that any number of estimators share it."""
    folded = cut_lineage(stratified_folds(data, "y", key, n_splits, seed))
    folds = []
    for k in range(n_splits):
        tr, va = folded.filter(F.col("fold") != k), folded.filter(F.col("fold") == k)
        prep = prepare(tr, features)          # fitted on the training fold, applied to both
        fit_prep = prep
        if use_sampling:
            # impute -> scale -> SMOTE -> (under-sample) -> model, samplers on the training fold only
            tr = prep.scaler.transform(prep.imputer.transform(tr))
            tr = resampled(tr, features, key, smote_ratio, under_ratio if use_under else None, seed)
            fit_prep = Prepared(MedianImputer({}, []), Standardizer({}, {}, False), features)
        train = class_weights(fit_prep.apply(tr).select(key, "y", "features"), "y")
        train = cut_lineage(train)
        folds.append(Fold(k, train, cut_lineage(prep.apply(va).select(key, "y", "features")), train.count()))
    return folds


def score_folds(estimator, folds: list[Fold], key: str = "vec_id", threshold: float = 0.5) -> tuple[DataFrame, list[tuple]]:
    """Out-of-fold probabilities (key, y, p, fold) and per fold its number from 1, auc, ap, f1."""
    parts, rows = [], []
    for fold in folds:
        model = fit_estimator(estimator, fold.train, fold.rows)
        p = cut_lineage(positive_proba(model, fold.valid).select(key, "y", "p", F.lit(fold.number).alias("fold")))
        m = M.metrics_dict(p, threshold)
        rows.append((fold.number + 1, m["auc"], m["ap"], m["f1"]))
        parts.append(p)
    oof = parts[0]
    for part in parts[1:]:
        oof = oof.unionByName(part)
    return oof, rows


def run_model_cv(estimator, data: DataFrame, features: list[str], key: str = "vec_id", n_splits: int = 3,
                 seed: int = 42, threshold: float = 0.5, use_sampling: bool = False, smote_ratio: float = 1.0,
                 use_under: bool = False, under_ratio: float = 1.0,
                 log: RunLog | None = None, name: str = "cv", folds: list[Fold] | None = None) -> dict:
    """ML9: cross-validation on ``prepare_folds`` (or folds prepared before): out-of-fold probabilities;
    per-fold auc/ap/f1 and their means (EV10); global OOF metrics (EV6)."""
    folds = folds or prepare_folds(data, features, key, n_splits, seed, use_sampling, smote_ratio, use_under, under_ratio)
    oof, fold_rows = score_folds(estimator, folds, key, threshold)
    frame = data.sparkSession.createDataFrame(fold_rows, "fold int, auc double, ap double, f1 double")
    means = M.fold_means(frame, ["auc", "ap", "f1"]).first().asDict()
    oof_m = M.metrics_dict(oof, threshold, prefix="oof_")
    if log:
        log.start(name)
        for pk, pv in (("n_splits", len(folds)), ("random_state", seed), ("threshold", threshold),
                       ("use_sampling", use_sampling), ("smote_ratio", smote_ratio if use_sampling else None),
                       ("use_under", use_under), ("under_ratio", under_ratio if (use_sampling and use_under) else None)):
            log.log("param", pk, pv)
        for f, a, ap, f1 in fold_rows:
            log.log("metric", "auc_fold", a, f)
            log.log("metric", "ap_fold", ap, f)
            log.log("metric", "f1_fold", f1, f)
        for k2, v in {**means, **oof_m}.items():
            log.log("metric", k2, v)
    return {"oof": oof, "folds": frame, **means, **oof_m}


# ---------------------------------------------------------------- search and selection


def draw_parameters(grid: dict[str, list], n_iter: int, seed: int = 42) -> list[dict]:
    """``n_iter`` different combinations of the grid's values."""
    names = sorted(grid)
    total = math.prod(len(grid[k]) for k in names)
    draws = []
    for number in random.Random(seed).sample(range(total), min(n_iter, total)):
        draw = {}
        for k in names:
            number, i = divmod(number, len(grid[k]))
            draw[k] = grid[k][i]
        draws.append(draw)
    return draws


def random_search(make_estimator, grid: dict[str, list], data: DataFrame, features: list[str], n_iter: int = 10,
                  n_splits: int = 3, seed: int = 42, key: str = "vec_id", parallel: int = 4, **sampling) -> tuple[dict, list[dict]]:
    """ML10: seeded draws from the grid without replacement (all of it, if it is smaller), each scored by CV mean AP; best first.

    Folds, medians, scales and resampled rows are made once and shared by all draws; ``parallel`` draws are submitted at a time."""
    draws = draw_parameters(grid, n_iter, seed)
    folds = prepare_folds(data, features, key, n_splits, seed, **sampling)

    def score(draw: dict) -> dict:
        _, rows = score_folds(make_estimator(**draw), folds, key)
        return {"params": draw, "ap_mean_cv": sum(r[2] for r in rows) / len(rows), "auc_mean_cv": sum(r[1] for r in rows) / len(rows)}
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        results = list(pool.map(inheritable_thread_target(data.sparkSession)(score), draws))
    results.sort(key=lambda x: -x["ap_mean_cv"])  # ties keep the order of the draws
    return results[0], results


def importances(spark: SparkSession, model, features: list[str]) -> DataFrame:
    """ML11: (feature, importance) sorted descending (ties by name)."""
    imp = model.gains() if isinstance(model, BoostedTreesModel) else model.featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(features, [float(x) for x in imp])), "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature")


def eliminate_zero_importance(make_estimator, data: DataFrame, features: list[str], max_rounds: int = 2,
                              key: str = "vec_id") -> tuple[list[str], list[list[str]]]:
    """ML12: fit, drop zero-importance features, refit, up to ``max_rounds``."""
    spark = data.sparkSession
    dropped_per_round = []
    feats = list(features)
    for _ in range(max_rounds):
        prep = prepare(data, feats)
        model = fit_estimator(make_estimator(), prep.apply(data))
        imp = importances(spark, model, [c for c in feats if c not in prep.imputer.dropped])
        zero = [r["feature"] for r in imp.filter(F.col("importance") == 0.0).select("feature").collect()]
        dropped_per_round.append(zero)
        if not zero:
            break
        feats = [c for c in feats if c not in set(zero)]
    return feats, dropped_per_round


def top_importances(imp: DataFrame, k: int = 30) -> DataFrame:
    """TOP4: the k most important features."""
    return imp.orderBy(F.desc("importance"), "feature").limit(k)


def zero_importances(imp: DataFrame) -> DataFrame:
    """TOP4: the features that no tree used, by name."""
    return imp.filter(F.col("importance") == 0.0).select("feature").orderBy("feature")


def final_refit(estimator, data: DataFrame, features: list[str], path: str, metadata: dict, key: str = "vec_id",
                smote_ratio: float | None = None, seed: int = 42) -> dict:
    """ML15: refit on all rows (impute -> scale -> SMOTE if asked -> model); saves one fitted pipeline that takes raw rows,
    and the metadata (feature order, medians, scales, threshold)."""
    prep = prepare(data, features)
    rows, fitted_on = data, prep
    if smote_ratio is not None:
        rows = resampled(prep.scaler.transform(prep.imputer.transform(data)), features, key, smote_ratio, None, seed)
        fitted_on = Prepared(MedianImputer({}, []), Standardizer({}, {}, False), features)
    model = fit_estimator(estimator, fitted_on.apply(rows))
    PipelineModel([*prep.stages(), model]).write().overwrite().save(f"{path}/model")
    meta = {**metadata, "feature_names": features, "medians": prep.imputer.medians,
            "means": prep.scaler.means, "stds": prep.scaler.stds}
    spark = data.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return meta


def load_and_score(path: str, rows: DataFrame) -> DataFrame:
    """Probabilities ``p`` of raw rows by a pipeline that ``final_refit`` saved."""
    return positive_proba(PipelineModel.load(f"{path}/model"), rows)
