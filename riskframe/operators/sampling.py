"""Deterministic sampling and stratified splits (SMP1-SMP5).

Randomness is a hash: ``md5(key | seed)``, the same in Spark and in SQL
engines, so a split is reproducible and checkable.  Row-for-row equality with
NumPy's generator is not a goal.

Ranks inside a class never use a window over the whole class (one task per
class): rows are spread over 4096 buckets by the first three hex digits of
the hash; per-(class, bucket) counts give each bucket's offset and a window
partitioned by (class, bucket) numbers the rows inside it.  A NULL label is a
class of its own: no row is lost.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.expr import q
from riskframe.operators.ordered import null_safe_join

HASH_BUCKET_HEX = 3  # 16**3 = 4096 buckets per class


def hash_key(key: str, seed: int) -> F.Column:
    return F.md5(F.concat(F.col(q(key)).cast("string"), F.lit(f"|{seed}")))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """SMP1: n rows chosen by the smallest hashes (TakeOrdered: each task
    keeps n rows, the merge sees n x tasks)."""
    return df.withColumn("_h", hash_key(key, seed)).orderBy("_h").limit(int(n)).drop("_h")


def rank_within(df: DataFrame, group: str, key: str, seed: int = 42, out: str = "rank") -> DataFrame:
    """1-based rank of each row inside its group, in hash order (exact)."""
    h = df.withColumn("_h", hash_key(key, seed)).withColumn(
        "_b", F.conv(F.substring("_h", 1, HASH_BUCKET_HEX), 16, 10).cast("int"))
    counts = h.groupBy(q(group), "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(q(group)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(q(group), "_b", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    j = null_safe_join(h, offsets, [group, "_b"])
    w2 = Window.partitionBy(q(group), "_b").orderBy("_h")
    return j.withColumn(out, F.col("_off") + F.row_number().over(w2)).drop("_h", "_b", "_off")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(q(label)).agg(F.count(F.lit(1)).alias("n_class"))


def _quota(counts: DataFrame, label: str, total_expr) -> DataFrame:
    """Largest-remainder allocation of ``total`` rows over classes in
    proportion to their size (ties: larger remainder, then class value)."""
    w_all = Window.partitionBy()
    c = counts.withColumn("_n", F.sum("n_class").over(w_all))  # one row per class: tiny
    c = c.withColumn("_t", total_expr(F.col("_n")))
    c = c.withColumn("_exact", F.col("_t") * F.col("n_class") / F.col("_n"))
    c = c.withColumn("_base", F.floor("_exact").cast("long")).withColumn("_rem", F.col("_exact") - F.col("_base"))
    c = c.withColumn("_left", F.col("_t") - F.sum("_base").over(w_all))
    w_rem = Window.partitionBy().orderBy(F.desc("_rem"), q(label))
    c = c.withColumn("_pos", F.row_number().over(w_rem))
    return c.select(q(label), "n_class", (F.col("_base") + (F.col("_pos") <= F.col("_left")).cast("long")).alias("quota"))


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """SMP2: adds ``is_test``: ceil(test_size * n) rows, spread over the
    classes by largest remainder, lowest hash ranks first."""
    counts = class_counts(df, label)
    quota = _quota(counts, label, lambda n: F.ceil(F.lit(float(test_size)) * n))
    r = rank_within(df, label, key, seed)
    return null_safe_join(r, quota.select(q(label), "quota"), [label]).withColumn(
        "is_test", F.col("rank") <= F.col("quota")).drop("quota")


def stratified_subset(df: DataFrame, label: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """SMP3: a stratified subset of exactly ``size`` rows (or all rows)."""
    counts = class_counts(df, label)
    quota = _quota(counts, label, lambda n: F.least(F.lit(int(size)).cast("long"), n))
    r = rank_within(df, label, key, seed)
    return null_safe_join(r, quota.select(q(label), "quota"), [label]).filter(
        F.col("rank") <= F.col("quota")).drop("quota", "rank")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """SMP4: ``fold`` = (rank in class - 1) mod k: class shares equal in every
    fold, fold sizes differ by at most one per class."""
    return rank_within(df, label, key, seed).withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank")


def under_sample(df: DataFrame, label: str, key: str, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """SMP5: keep every minority row and ``int(n_min / ratio)`` majority rows
    (lowest hash ranks)."""
    counts = class_counts(df, label)
    w = Window.partitionBy()
    c = counts.withColumn("_min", F.min("n_class").over(w)).withColumn(
        "_is_min", F.row_number().over(Window.partitionBy().orderBy("n_class", q(label))) == 1)
    c = c.withColumn("quota", F.when(F.col("_is_min"), F.col("n_class")).otherwise(
        F.floor(F.col("_min") / F.lit(float(ratio))).cast("long")))
    r = rank_within(df, label, key, seed)
    return null_safe_join(r, c.select(q(label), "quota"), [label]).filter(F.col("rank") <= F.col("quota")).drop(
        "quota", "rank")

