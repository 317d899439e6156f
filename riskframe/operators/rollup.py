"""Child-table rollups (AGG1-AGG3, JN1).

``agg_numeric_and_cat`` turns a child table into one row per key:
min/max/mean/sum/var of every numeric column and the share of every category
(one dummy per value plus a null dummy).  Dummies are never materialised: each
share is ``avg(cast(c <=> v as double))`` inside the same aggregate.

A partial row of such an aggregate is several times as wide as a row of the child, so
rows are combined before the shuffle only where that leaves few of them.  One scan
of the key counts the rows and keys of each task (``shuffle_plan``): where tasks hold a key
often, partial rows are shuffled, else the rows themselves, and each key is then
aggregated where it arrives.  A key that is hot among the latter (one key holding a
third of the rows) is combined in every map task as before.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import q
from riskframe.operators.encode import numeric_columns, string_columns, vocabulary

STATS = ("MIN", "MAX", "MEAN", "SUM", "VAR")


@dataclass
class RollupSpec:
    """What one rollup computes; built once from the child schema and its
    vocabulary, so the Spark plan and any SQL check share one column list."""

    key: str
    prefix: str
    numeric: list[str]
    categories: dict[str, list] = field(default_factory=dict)

    def output_columns(self) -> list[str]:
        out = [self.key]
        for c in self.numeric:
            out += [f"{self.prefix}{c}_{s}" for s in STATS]
        for c, values in self.categories.items():
            out += [f"{self.prefix}{c}_{v}_MEAN" for v in values] + [f"{self.prefix}{c}_nan_MEAN"]
        return out


def rollup_spec(df: DataFrame, key: str, prefix: str, exclude=(), vocab: dict | None = None) -> RollupSpec:
    """Numeric columns other than the key (ids included, as the reference
    does) and string columns with their vocabulary.  Timestamps and booleans
    are neither numeric nor categorical in the reference and are skipped."""
    skip = set(exclude) | {key}
    num = numeric_columns(df, skip)
    cats = string_columns(df, skip)
    if vocab is None:
        vocab = vocabulary(df, cats)
    return RollupSpec(key=key, prefix=prefix, numeric=num, categories={c: vocab[c] for c in cats})


def _sql_str(v) -> str:
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def rollup_aggregates(spec: RollupSpec) -> list:
    """Aggregate expressions, written as SQL text (one JVM call each; a wide
    rollup has hundreds of them)."""
    p = spec.prefix
    aggs = []
    for c in spec.numeric:
        x = f"CAST({q(c)} AS DOUBLE)"
        aggs += [
            f"min({x}) AS {q(p + c + '_MIN')}",
            f"max({x}) AS {q(p + c + '_MAX')}",
            f"avg({x}) AS {q(p + c + '_MEAN')}",
            # pandas: the sum of an all-missing group is 0
            f"coalesce(sum({x}), 0D) AS {q(p + c + '_SUM')}",
            f"var_samp({x}) AS {q(p + c + '_VAR')}",
        ]
    for c, values in spec.categories.items():
        for v in values:
            aggs.append(f"avg(CAST(({q(c)} <=> {_sql_str(v)}) AS DOUBLE)) AS {q(p + c + '_' + str(v) + '_MEAN')}")
        aggs.append(f"avg(CAST(({q(c)} IS NULL) AS DOUBLE)) AS {q(p + c + '_nan_MEAN')}")
    return [F.expr(a) for a in aggs]


#: A key is hot with more rows than both; so many keys at most are looked for.
HOT_SHARE, HOT_ROWS, HOT_KEYS = 1 / 1_000, 50_000, 1_000


@dataclass
class ShufflePlan:
    """``combine``: partial rows are shuffled, not rows.  ``hot``: keys whose rows are combined in any case."""

    combine: bool
    hot: list = field(default_factory=list)


def shuffle_plan(df: DataFrame, key: str, spec: RollupSpec, dealt_by: str | None = None) -> ShufflePlan:
    """How the rows of a child reach their key, from one scan of the key (a sketch a task).

    ``dealt_by``: a column by whose hash the rows will lie in tasks (none: as ``df`` is read).  A partial row holds 8 numbers a numeric column and 2 a category, a row 1 and 2 a column."""
    partial = 8 * len(spec.numeric) + 2 * sum(len(v) + 1 for v in spec.categories.values())
    row = len(spec.numeric) + 2 * len(spec.categories)
    task = F.pmod(F.hash(q(dealt_by)), F.lit(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))) if dealt_by else F.spark_partition_id()
    keyed = df.filter(F.col(q(key)).isNotNull()).select(F.col(q(key)).alias("k"), task.alias("t"))
    # the items that the sketch must find have more than 1 / (0.75 * 16,384) of the rows
    tasks = keyed.groupBy("t").agg(
        F.count("*").alias("n"), F.approx_count_distinct("k").alias("keys"),
        F.expr(f"approx_top_k_accumulate(k, {HOT_KEYS * 16})").alias("top"))
    r = tasks.agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"),
                  F.expr(f"approx_top_k_estimate(approx_top_k_combine(top, {HOT_KEYS * 16}), {HOT_KEYS})").alias("top")).first()
    if not r["n"] or r["keys"] * partial <= r["n"] * row:
        return ShufflePlan(True)
    return ShufflePlan(False, [t["item"] for t in r["top"] if t["count"] > max(HOT_SHARE * r["n"], HOT_ROWS)])


def agg_numeric_and_cat(df: DataFrame, key: str, prefix: str, exclude=(), vocab: dict | None = None,
                        spec: RollupSpec | None = None, plan: ShufflePlan | None = None) -> DataFrame:
    """AGG1: one row per non-null key with ``{prefix}{col}_{STAT}`` columns."""
    spec = spec or rollup_spec(df, key, prefix, exclude, vocab)
    plan = plan or shuffle_plan(df, key, spec)
    keyed = df.filter(F.col(q(key)).isNotNull()).select(*[F.col(q(c)) for c in dict.fromkeys([key, *spec.numeric, *spec.categories])])
    rollup = lambda rows: rows.groupBy(F.col(q(key))).agg(*rollup_aggregates(spec))
    if plan.combine:
        return rollup(keyed)
    if not plan.hot:
        return rollup(keyed.repartition(F.col(q(key))))
    is_hot = F.col(q(key)).isin(plan.hot)
    return rollup(keyed.filter(~is_hot).repartition(F.col(q(key)))).unionAll(rollup(keyed.filter(is_hot)))


def left_attach(parent: DataFrame, rollup: DataFrame, parent_key: str, rollup_key: str | None = None) -> DataFrame:
    """JN1: left equi-join of a rollup onto its parent.

    The rollup comes out of ``groupBy(key)`` and is already hash-partitioned
    on the key; only the parent side is shuffled.  Spark (AQE) switches to a
    broadcast hash join at run time when the rollup is small enough.
    """
    rollup_key = rollup_key or parent_key
    if rollup_key != parent_key:
        rollup = rollup.withColumnRenamed(rollup_key, parent_key)
    return parent.join(rollup, on=parent_key, how="left")


def two_level_rollup(grandchild: DataFrame, gc_key: str, gc_prefix: str,
                     child: DataFrame, child_key: str, parent_key: str, prefix: str,
                     gc_exclude=(), child_exclude=()) -> tuple[DataFrame, RollupSpec, RollupSpec]:
    """AGG2: grandchild -> child key, left join onto child, child -> parent key."""
    gc_spec = rollup_spec(grandchild, gc_key, gc_prefix, gc_exclude)
    gc_agg = agg_numeric_and_cat(grandchild, gc_key, gc_prefix, spec=gc_spec)
    child_ext = left_attach(child, gc_agg, child_key, gc_key)
    # new numeric columns from the grandchild rollup follow the child's own
    child_spec = rollup_spec(child, parent_key, prefix, child_exclude)
    child_spec.numeric = child_spec.numeric + [c for c in gc_spec.output_columns() if c != gc_key]
    plan = shuffle_plan(child, parent_key, child_spec, child_key)  # the join deals the child by its key and adds columns, not rows
    return agg_numeric_and_cat(child_ext, parent_key, prefix, spec=child_spec, plan=plan), gc_spec, child_spec
