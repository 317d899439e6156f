"""Boosted trees by gradient and hessian histograms (ML7), with L1/L2 penalties on leaves and leaf-wise growth.

A feature's values become bins between bounds (quantiles, or given ones).  For log loss
every row has a gradient p - y and a hessian p (1 - p).  One Spark job sums both
per (node, feature, bin): each task adds its rows into an array and sends its
non-empty cells, which are then added over tasks; what is shuffled depends on nodes,
features and bins, not on rows.

With G, H the sums of a node, T(G) = sign(G) max(|G| - reg_alpha, 0):

    leaf value = -T(G) / (H + reg_lambda)
    gain       = T(Gl)^2 / (Hl + reg_lambda) + T(Gr)^2 / (Hr + reg_lambda) - T(G)^2 / (H + reg_lambda)

Growth is best first: the leaf with the largest gain is split until there are
``num_leaves`` or no gain is above ``min_split_gain``.  A job looks at the children of all
leaves' best splits at once, so many splits are chosen between two jobs and a tree
costs about as many jobs as it has levels.  Ties go to the smaller node, feature and bin.

Rows carry their bins and a margin; trees grown since the margin was last stored are
added inside the tasks, and every ``store_every`` trees the margins are checkpointed.
The driver holds histograms and trees only.  A missing value lies in the lowest bin.

The same histograms grow the trees of a random forest (ML6, ``objective="mean"``): with
gradient -y and hessian 1 the gain is the decrease of the Gini impurity (halved), and a
leaf's value is the share of positives.  Each tree has its own bootstrap (a
Poisson count per row, drawn by a hash of the key) and each node its own columns.
"""

from __future__ import annotations

import heapq
import json
import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.session import cut_lineage


@dataclass(frozen=True)
class Growth:
    """How trees grow; names and defaults are those of the common boosters."""

    n_estimators: int = 100
    learning_rate: float = 0.1
    num_leaves: int = 31
    max_depth: int = -1
    min_child_samples: int = 20
    min_child_weight: float = 1e-3
    min_split_gain: float = 0.0
    reg_alpha: float = 0.0
    reg_lambda: float = 0.0
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    random_state: int = 42
    max_bin: int = 63
    store_every: int = 10
    objective: str = "logistic"
    #: Forests: least rows of a node that is split, share of columns that a node looks at, rows drawn with replacement.
    min_samples_split: int = 2
    max_features: float = 1.0
    bootstrap: bool = False


def _matrix(column, dtype) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1)


def tree_leaves(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The node in which each row of bins ends."""
    node = np.zeros(len(bins), dtype=np.int64)
    for number, split in sorted(tree["splits"].items()):  # a child's number is larger than its parent's
        here = node == number
        right = bins[:, split["feature"]] > split["bin"]
        node[here] = np.where(right[here], split["right"], split["left"])
    return node


def _values(tree: dict) -> np.ndarray:
    out = np.zeros(max(tree["values"]) + 1)
    for node, value in tree["values"].items():
        out[node] = value
    return out


#: Nodes whose histograms one job makes.
NODES = 128


def histograms(rows: DataFrame, trees: list[dict], base: float, leaf_of: dict, wanted: list[int], columns: np.ndarray,
               n_bins: int, subsample: float, seed: int, mean: bool = False) -> dict[int, np.ndarray]:
    """Per wanted node the sums (gradient, hessian, rows) of each column and bin."""
    if len(wanted) > NODES:
        out = {}
        for at in range(0, len(wanted), NODES):
            out |= histograms(rows, trees, base, leaf_of, wanted[at:at + NODES], columns, n_bins, subsample, seed, mean)
        return out
    place = {node: i for i, node in enumerate(wanted)}
    most = max([0, *wanted, *(s["right"] for s in leaf_of["splits"].values())])
    slot = np.array([place.get(n, -1) for n in range(most + 1)])

    def run(batches):
        total = np.zeros((len(wanted), len(columns), n_bins, 3))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _matrix(batch.column("bins"), np.int64)
            margin = batch.column("margin").to_numpy(zero_copy_only=False) + base
            for tree in trees:
                margin = margin + _values(tree)[tree_leaves(tree, bins)]
            p = 1.0 / (1.0 + np.exp(-margin))
            weight = batch.column("w").to_numpy(zero_copy_only=False)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            node = slot[tree_leaves(leaf_of, bins)]
            keep = node >= 0
            if subsample < 1.0:
                keep &= batch.column("u").to_numpy(zero_copy_only=False) < subsample
            times = batch.column("times").to_numpy(zero_copy_only=False)
            weight = weight * times
            g, h = ((-weight * y)[keep], weight[keep]) if mean else ((weight * (p - y))[keep], (weight * p * (1 - p))[keep])
            bins, node, times = bins[keep], node[keep], times[keep]
            for i, c in enumerate(columns.tolist()):
                cell = node * n_bins + bins[:, c]
                for k, value in enumerate((g, h, times)):
                    total[:, i, :, k] += np.bincount(cell, weights=value, minlength=len(wanted) * n_bins).reshape(len(wanted), n_bins)
        node, column, at = np.nonzero(total[..., 2])
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (node, column, at)] + [pa.array(total[node, column, at, k]) for k in range(3)],
                                         names=["node", "column", "bin", "g", "h", "n"])

    if subsample < 1.0:
        u = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        rows = rows.withColumn("u", u)
    parts = rows.drop("key").mapInArrow(run, "node int, column int, bin int, g double, h double, n double")
    out = np.zeros((len(wanted), len(columns), n_bins, 3))
    for r in parts.groupBy("node", "column", "bin").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect():  # bounded by nodes x columns x bins
        out[r[0], r[1], r[2]] = r[3:6]
    return {node: out[i] for node, i in place.items()}


def _shrunk(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def leaf_value(g: float, h: float, growth: Growth) -> float:
    return float(-_shrunk(g, growth.reg_alpha) / (h + growth.reg_lambda)) if h + growth.reg_lambda > 0 else 0.0


def best_split(sums: np.ndarray, columns: np.ndarray, growth: Growth, node: int = 0, number: int = 0) -> dict | None:
    """The split of a node with the largest gain, by its histogram (columns x bins x 3)."""
    if growth.max_features < 1.0:
        pick = np.random.default_rng([growth.random_state, number, node]).permutation(len(columns))[:max(1, int(growth.max_features * len(columns)))]
        pick.sort()
        sums, columns = sums[pick], columns[pick]
    # a forest's gain is never below zero but for rounding; a pure node has none
    least = 1e-9 * abs(float(sums[0, :, 1].sum())) if growth.objective == "mean" else 0.0
    left = np.cumsum(sums, axis=1)[:, :-1]
    whole = sums[0].sum(axis=0)
    right = whole - left
    score = lambda s: _shrunk(s[..., 0], growth.reg_alpha) ** 2 / np.maximum(s[..., 1] + growth.reg_lambda, 1e-300)
    gain = score(left) + score(right) - score(whole)
    fair = ((left[..., 2] >= growth.min_child_samples) & (right[..., 2] >= growth.min_child_samples)
            & (left[..., 1] >= growth.min_child_weight) & (right[..., 1] >= growth.min_child_weight))
    gain = np.where(fair, gain, -np.inf)
    if not gain.size or whole[2] < growth.min_samples_split or not gain.max() > max(growth.min_split_gain, least):
        return None
    # gains within rounding are ties; the first column and bin win
    c, b = np.unravel_index(int(np.flatnonzero(gain.ravel() >= gain.max() - 1e-9 * abs(gain.max()))[0]), gain.shape)
    return {"feature": int(columns[c]), "bin": int(b), "gain": float(gain[c, b]), "sums": (left[c, b].tolist(), right[c, b].tolist())}


def grow_tree(rows: DataFrame, trees: list[dict], base: float, n_bins: int, n_features: int, growth: Growth, number: int) -> dict:
    """One tree on the rows' gradients, best leaf first."""
    rng = np.random.default_rng([growth.random_state, number])
    columns = np.arange(n_features)
    if growth.colsample_bytree < 1.0:
        columns = np.sort(rng.choice(n_features, max(1, round(n_features * growth.colsample_bytree)), replace=False))
    seed = growth.random_state * 1_000_003 + number
    mean = growth.objective == "mean"
    if growth.bootstrap:
        u = F.pmod(F.xxhash64("key", F.lit(seed), F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
        steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
        rows = rows.withColumn("times", sum(((u >= float(s)).cast("double") for s in steps), F.lit(0.0))).where("times > 0")
    ask = lambda tree, nodes: histograms(rows, trees, base, tree, nodes, columns, n_bins, growth.subsample, seed, mean)
    tree = {"splits": {}, "values": {0: 0.0}}  # the chosen splits
    root = ask(tree, [0])[0]
    depth, split = {0: 0}, {0: best_split(root, columns, growth, 0, number)}
    sums = {0: root[0].sum(axis=0).tolist()}
    kids: dict[int, tuple[int, int]] = {}
    next_number = 1
    queue = [(-split[0]["gain"], 0)] if split[0] else []
    leaves = 1
    while queue and leaves < growth.num_leaves:
        node = queue[0][1]
        if node not in kids:  # look at the children of every leaf that could be split next, in one job
            todo = sorted(n for _, n in queue if n not in kids)
            trial = {"splits": {**tree["splits"]}, "values": {}}
            for n in todo:
                kids[n] = (next_number, next_number + 1)
                next_number += 2
                for child, part in zip(kids[n], split[n]["sums"]):
                    depth[child], sums[child] = depth[n] + 1, part
                trial["splits"][n] = {**split[n], "left": kids[n][0], "right": kids[n][1]}
            asked = [c for n in todo for c in kids[n] if growth.max_depth < 1 or depth[c] < growth.max_depth]
            found = ask(trial, asked) if asked else {}
            for n in todo:
                for c in kids[n]:
                    split[c] = best_split(found[c], columns, growth, c, number) if c in found else None
        heapq.heappop(queue)
        tree["splits"][node] = {**split[node], "left": kids[node][0], "right": kids[node][1]}
        leaves += 1
        for c in kids[node]:
            if split[c]:
                heapq.heappush(queue, (-split[c]["gain"], c))
    inner = set(tree["splits"])
    ends = [0] if not inner else sorted({c for s in tree["splits"].values() for c in (s["left"], s["right"])} - inner)
    tree["values"] = {n: growth.learning_rate * leaf_value(sums[n][0], sums[n][1], growth) for n in ends}
    tree["counts"] = {n: sums[n][2] for n in [*inner, *ends]}
    for s in tree["splits"].values():
        del s["sums"]
    return tree


def binned(df: DataFrame, features: str, bounds: list[list[float]]) -> F.Column:
    """Bin of every value: how many of its feature's bounds lie below it (a missing value: 0)."""
    table = F.from_json(F.lit(json.dumps(bounds)), "array<array<double>>")
    return F.zip_with(features, table, lambda x, cuts: F.when(x.isNull() | F.isnan(x), F.lit(0)).otherwise(F.size(F.filter(cuts, lambda c: c < x))).cast("int"))


def quantile_bounds(df: DataFrame, features: str, n_features: int, max_bin: int) -> list[list[float]]:
    """Bounds of at most ``max_bin`` bins of about equally many rows, for all features in one aggregate."""
    probs = [i / max_bin for i in range(1, max_bin)]
    found = df.agg(*[F.array_distinct(F.percentile_approx(F.nanvl(F.get(features, F.lit(i)), F.lit(None)), probs, 10_000)).alias(f"c{i}") for i in range(n_features)]).first()
    return [sorted(found[f"c{i}"] or []) for i in range(n_features)]


def fit_trees(rows: DataFrame, growth: Growth, bounds: list[list[float]] | None = None) -> dict:
    """Trees for ``rows`` of ``key``, ``y`` (0/1), ``w``, ``x`` (array<double>): bounds, base margin and trees as plain numbers."""
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no training rows")
    n_features = first["n"]
    bounds = bounds if bounds is not None else quantile_bounds(rows, "x", n_features, growth.max_bin)
    work = rows.select("key", F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"),
                       binned(rows, "x", bounds).alias("bins"), F.lit(0.0).alias("margin"), F.lit(1.0).alias("times"))
    work = cut_lineage(work)
    mean = work.agg(F.sum(F.col("w") * F.col("y")) / F.sum("w")).first()[0]
    mean = min(max(mean, 1e-12), 1 - 1e-12)
    base, n_bins = float(np.log(mean / (1 - mean))), 1 + max(map(len, bounds))
    if growth.objective == "mean":  # independent trees, whose values are averaged
        forest = [grow_tree(work, [], 0.0, n_bins, n_features, growth, number) for number in range(growth.n_estimators)]
        return {"bounds": bounds, "base": 0.0, "trees": [_plain(t) for t in forest], "n_features": n_features, "link": "mean"}
    trees: list[dict] = []
    pending: list[dict] = []
    for number in range(growth.n_estimators):
        tree = grow_tree(work, pending, base, n_bins, n_features, growth, number)
        trees.append(tree)
        if not tree["splits"] and growth.subsample == growth.colsample_bytree == 1.0:
            break  # nothing is left to gain
        pending = [*pending, tree]
        if len(pending) == growth.store_every:
            work, pending = cut_lineage(_with_margin(work, pending)), []
    return {"bounds": bounds, "base": base, "trees": [_plain(t) for t in trees], "n_features": n_features}


def _with_margin(rows: DataFrame, trees: list[dict]) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                bins = _matrix(batch.column("bins"), np.int64)
                margin = batch.column("margin").to_numpy(zero_copy_only=False).copy()
                for tree in trees:
                    margin += _values(tree)[tree_leaves(tree, bins)]
                yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin))
    return rows.mapInArrow(run, rows.schema)


def _plain(tree: dict) -> dict:
    return {k: {str(n): v for n, v in tree[k].items()} for k in ("splits", "values", "counts")}


def _numbers(tree: dict) -> dict:
    return {k: {int(n): v for n, v in tree[k].items()} for k in ("splits", "values")}


def margin_of(bins: F.Column, spec: dict) -> F.Column:
    """Base margin and the sum of all trees' leaf values, as one expression: trees are a literal array, walked a level a step."""
    nodes, depth = [], 0
    for tree in map(_numbers, spec["trees"]):
        n = 1 + max([*tree["values"], *tree["splits"]])
        table = {"f": [0] * n, "b": [0] * n, "l": [-1] * n, "r": [-1] * n, "v": [0.0] * n}
        below = {0: 0}
        for k, s in sorted(tree["splits"].items()):
            table["f"][k], table["b"][k], table["l"][k], table["r"][k] = s["feature"], s["bin"], s["left"], s["right"]
            below[s["left"]] = below[s["right"]] = below[k] + 1
        for k, v in tree["values"].items():
            table["v"][k] = v
        depth = max(depth, *below.values())
        nodes.append(table)
    if not nodes:
        return F.lit(spec["base"])
    trees = F.from_json(F.lit(json.dumps(nodes)), "array<struct<f: array<int>, b: array<int>, l: array<int>, r: array<int>, v: array<double>>>")

    # the bins are computed once, as the only element of an array that is then walked
    total = lambda b: F.aggregate(trees, F.lit(float(spec["base"])), lambda total, tree: total + F.get(tree["v"], F.aggregate(
        F.sequence(F.lit(1), F.lit(max(depth, 1))), F.lit(0),
        lambda at, _: F.when(F.get(tree["l"], at) < 0, at).when(F.get(b, F.get(tree["f"], at)) <= F.get(tree["b"], at), F.get(tree["l"], at)).otherwise(F.get(tree["r"], at)))))
    return F.get(F.transform(F.array(bins), total), F.lit(0))


class BoostedTrees(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator over ``features`` (vector), ``y`` and, if there is one, ``weight``."""

    growth = Param(Params._dummy(), "growth", "how trees grow, as JSON", TypeConverters.toString)
    key = Param(Params._dummy(), "key", "column that rows are drawn by", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "column of row weights; empty for none", TypeConverters.toString)

    @keyword_only
    def __init__(self, growth: str = "{}", key: str = "", balanced: bool = False):
        super().__init__()
        self._set(growth=growth, key=key, weightCol="weight" if balanced else "")

    def _fit(self, dataset: DataFrame) -> BoostedTreesModel:
        key = self.getOrDefault("key")
        x = vector_to_array("features")
        named = F.col(f"`{key}`") if key else F.xxhash64(x)
        weight = F.col("weight") if "weight" in dataset.columns else F.lit(1.0)
        rows = dataset.select(named.cast("long").alias("key"), F.col("y").alias("y"), weight.alias("w"), x.alias("x"))
        growth = Growth(**json.loads(self.getOrDefault("growth")))
        if growth.max_features < 0:  # the square root of the number of columns
            growth = replace(growth, max_features=max(1, math.isqrt(rows.select(F.size("x")).first()[0])) / rows.select(F.size("x")).first()[0] + 1e-9)
        return BoostedTreesModel(trees=json.dumps(fit_trees(rows, growth)))


class BoostedTreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` (vector)."""

    trees = Param(Params._dummy(), "trees", "bounds, base margin and trees, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, trees: str = "{}"):
        super().__init__()
        self._set(trees=trees)

    def spec(self) -> dict:
        return json.loads(self.getOrDefault("trees"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spec = self.spec()
        total = margin_of(binned(dataset, vector_to_array("features"), spec["bounds"]), spec)
        p = total / float(max(1, len(spec["trees"]))) if spec.get("link") == "mean" else F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
        return dataset.withColumn("__p", p).withColumn("probability", array_to_vector(F.array(F.lit(1.0) - F.col("__p"), F.col("__p")))).drop("__p")

    def gains(self) -> list[float]:
        """Summed gain of each feature's splits."""
        spec = self.spec()
        out = [0.0] * spec["n_features"]
        for tree in spec["trees"]:
            for s in tree["splits"].values():
                out[s["feature"]] += s["gain"]
        return out
