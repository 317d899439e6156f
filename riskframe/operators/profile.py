"""Table profiling (PRF1-PRF21).

Every profile is one (or a fixed few) aggregate job over the whole table with
one expression per column, then a small unpivot of the one-row result; the
number of jobs never depends on the number of columns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.expr import q
from riskframe.operators.encode import numeric_columns, string_columns
from riskframe.operators.ordered import exact_quantiles, null_safe_join
from riskframe.session import cut_lineage


def _unpivot_row(row_df: DataFrame, names: list[str], fields: dict[str, callable]) -> DataFrame:
    """Turn a one-row aggregate (columns ``{field}{i}``) into one row per name."""
    structs = [F.struct(F.lit(n).alias("column"),
                        *[F.col(f"{f}{i}").alias(f) for f in fields]) for i, n in enumerate(names)]
    return row_df.select(F.inline(F.array(*structs)))


def table_info(df: DataFrame) -> DataFrame:
    """PRF1: column, non-null count, type."""
    names = df.columns
    agg = df.agg(*[F.count(F.col(q(c))).alias(f"non_null{i}") for i, c in enumerate(names)])
    types = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"non_null{i}").alias("non_null"),
                        F.lit(types[c]).alias("dtype")) for i, c in enumerate(names)]
    return agg.select(F.inline(F.array(*structs)))


def shape(df: DataFrame) -> DataFrame:
    """PRF2: rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """PRF2: head."""
    return df.limit(n)


def dtype_counts(df: DataFrame) -> DataFrame:
    """PRF3: number of columns per type, and of the values in them (one aggregate over all rows)."""
    return table_info(df).groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("non_null").alias("n_values"))


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """PRF4 / PRF14: per column null count and percentage of rows."""
    cols = cols or df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(q(c)).isNull()).alias(f"nulls{i}") for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"nulls{i}").alias("null_count"),
                        F.try_divide(F.col(f"nulls{i}") * 100.0, F.col("_n").cast("double")).alias("null_pct"))
               for i, c in enumerate(cols)]
    return agg.select(F.inline(F.array(*structs)))


def value_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """PRF5: (column, value, count) including NULL as a value."""
    cols = cols or string_columns(df)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(q(c)).cast("string").alias("value"))
                                        for c in cols])))
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def class_distribution(df: DataFrame, col: str) -> DataFrame:
    """PRF6: value, count and share of rows (NULL excluded as pandas does)."""
    g = df.filter(F.col(q(col)).isNotNull()).groupBy(F.col(q(col)).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    # the grouped result has one row per class: a global window over it is tiny
    return g.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """PRF7: count, mean, std (n-1), min, 25/50/75 %, max per numeric column."""
    cols = cols or numeric_columns(df)
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(q(c)).cast("double").alias("v"))
                                        for c in cols])))
    # the moments need no unpivoting: one wide aggregate
    x = [F.col(q(c)).cast("double") for c in cols]
    wide = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(x) for n, f in (
        ("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    base = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{n}{i}").alias(n) for n in ("count", "mean", "std", "min", "max")])
                                          for i, c in enumerate(cols)])))
    qs = exact_quantiles(long, ["column"], "v", [0.25, 0.5, 0.75])
    qw = qs.groupBy("column").agg(*[F.max(F.when(F.col("q_index") == i, F.col("quantile"))).alias(n)
                                    for i, n in enumerate(("p25", "p50", "p75"))])
    return base.join(qw, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def missing_values_table(df: DataFrame) -> DataFrame:
    """PRF8: columns with missing values only, % rounded to 1 decimal, sorted desc."""
    nc = null_counts(df)
    return (nc.filter(F.col("null_pct") != 0)
            .select(F.col("column"), F.col("null_count").alias("missing_values"),
                    F.round("null_pct", 1).alias("pct_of_total"))
            .orderBy(F.desc("pct_of_total"), "column"))


def distinct_counts(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """PRF9: distinct non-null values per (string) column."""
    cols = cols or string_columns(df)
    f = F.countDistinct if exact else F.approx_count_distinct
    agg = df.agg(*[f(F.col(q(c))).alias(f"n_distinct{i}") for i, c in enumerate(cols)])
    return _unpivot_row(agg, cols, {"n_distinct": None})


def null_ratio_top(df: DataFrame, k: int = 20) -> DataFrame:
    """PRF10: columns by descending null ratio, first k (ties by name)."""
    nc = null_counts(df)
    return nc.select("column", (F.col("null_pct") / 100.0).alias("null_ratio")).orderBy(F.desc("null_ratio"), "column").limit(k)


def all_null_columns(df: DataFrame) -> DataFrame:
    """PRF11: columns without any non-null value."""
    cols = df.columns
    agg = df.agg(*[(F.count(F.col(q(c))) == 0).alias(f"all_null{i}") for i, c in enumerate(cols)])
    return _unpivot_row(agg, cols, {"all_null": None}).filter("all_null").select("column")


def constant_columns(df: DataFrame) -> DataFrame:
    """PRF12: at most one distinct non-null value: ``min <=> max`` per column
    (one pass, cheaper than counting distinct values)."""
    cols = df.columns
    agg = df.agg(*[F.min(F.col(q(c))).eqNullSafe(F.max(F.col(q(c)))).alias(f"const{i}") for i, c in enumerate(cols)])
    return _unpivot_row(agg, cols, {"const": None}).filter("const").select("column")


def key_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """PRF13: rows, distinct non-null keys, duplicate rows beyond the first
    (NULL keys count as one value for duplicates)."""
    k = F.col(q(key))
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(k).alias("n_distinct"),
                 F.max(k.isNull().cast("int")).alias("_has_null"))
    return agg.select("n_rows", "n_distinct",
                      (F.col("n_rows") - F.col("n_distinct") - F.coalesce(F.col("_has_null"), F.lit(0))).alias("n_duplicated"))


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """PRF15: equal-width bins from min to max, last bin closed on the right
    (NumPy ``histogram`` rules, incl. its edge corrections)."""
    v = F.col(q(col)).cast("double")
    d = df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    rng = d.agg(F.struct(F.min("v").alias("mn"), F.max("v").alias("mx"))).scalar()
    d = d.withColumn("_r", rng).withColumn("mn", F.col("_r.mn")).withColumn("mx", F.col("_r.mx"))
    mn, mx = F.col("mn"), F.col("mx")
    step = (mx - mn) / F.lit(float(bins))

    def edge(i):
        return F.when(i >= bins, mx).otherwise(mn + i.cast("double") * step)
    raw = F.when(mx > mn, ((F.col("v") - mn) * (F.lit(float(bins)) / (mx - mn))).cast("int")).otherwise(F.lit(0))
    d = d.withColumn("_i", F.least(raw, F.lit(bins - 1)))
    d = d.withColumn("_i", F.when(F.col("v") < edge(F.col("_i")), F.col("_i") - 1).otherwise(F.col("_i")))
    d = d.withColumn("_i", F.when((F.col("v") >= edge(F.col("_i") + 1)) & (F.col("_i") != bins - 1),
                                  F.col("_i") + 1).otherwise(F.col("_i")))
    counts = d.groupBy("_i").agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias("_i"), rng.alias("_r")) \
        .withColumn("mn", F.col("_r.mn")).withColumn("mx", F.col("_r.mx"))
    out = grid.join(counts, "_i", "left")
    return out.select(F.col("_i").alias("bin"), edge(F.col("_i")).alias("lower"), edge(F.col("_i") + 1).alias("upper"),
                      F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


#: Cells of a bandwidth in the density's binning.
KDE_FINE = 256


def kde_by_class(df: DataFrame, value_col: str, class_col: str, grid_size: int = 200, cut: float = 3.0, fine: int = KDE_FINE) -> DataFrame:
    """PRF16: Gaussian density per class on an evenly spaced grid of
    ``grid_size`` points from min - cut*h to max + cut*h, h = Scott's rule
    (sample std * n^(-1/5)).

    Linear binning: a value shares its weight between the two nearest nodes of a
    cell lattice with ``fine`` cells a bandwidth, combined on the map side, and the
    kernel is summed over nodes.  The shuffle holds nodes, not values: at most
    ``fine`` * ((max - min) / h + 2 cut) a class, however many distinct values there
    are.  The classes' bounds, one row a class, are broadcast, so the rows stay where they
    are read and a frequent class is no single task.  Each value's kernel is off by at most 1 / (8 fine^2) of its peak, so the density by at most
    1 / (8 fine^2 h sqrt(2 pi)) (2e-6 / (h sqrt(2 pi)) at 256).  A class of equal values has no bandwidth and gives NULL densities."""
    v = F.col(q(value_col)).cast("double")
    d = df.select(F.col(q(class_col)).alias("cls"), v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    st = d.groupBy("cls").agg(F.count("v").alias("n"), F.stddev_samp("v").alias("sd"),
                              F.min("v").alias("mn"), F.max("v").alias("mx"))
    st = st.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    st = cut_lineage(st.withColumn("lo", F.col("mn") - F.lit(cut) * F.col("h")).withColumn("hi", F.col("mx") + F.lit(cut) * F.col("h")).drop("mn", "mx", "sd"))
    step = F.col("h") / F.lit(float(fine))
    at = (F.col("v") - F.col("lo")) / F.nullif(step, F.lit(0.0))
    binned = null_safe_join(d, F.broadcast(st.select("cls", "lo", "h")), ["cls"]).select("cls", F.floor(at).cast("long").alias("cell"), (at - F.floor(at)).alias("part"))
    cells = binned.groupBy("cls", "cell").agg(F.count("*").alias("w"), F.sum("part").alias("up"))
    nodes = cells.select("cls", F.inline(F.array(F.struct(F.col("cell"), (F.col("w") - F.col("up")).alias("weight")),
                                                 F.struct((F.col("cell") + 1).alias("cell"), F.col("up").alias("weight")))))
    j = null_safe_join(nodes, F.broadcast(st), ["cls"]).withColumn("node", F.col("lo") + F.col("cell").cast("double") * step)
    j = j.withColumn("gi", F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1))))
    gx = F.col("lo") + F.col("gi").cast("double") * ((F.col("hi") - F.col("lo")) / F.lit(float(grid_size - 1)))
    gx = F.when(F.col("gi") == grid_size - 1, F.col("hi")).otherwise(gx)
    z = (gx - F.col("node")) / F.nullif(F.col("h"), F.lit(0.0))
    g = j.groupBy("cls", "gi").agg(F.first(gx).alias("x"), F.sum(F.col("weight") * F.exp(F.lit(-0.5) * z * z)).alias("_s"),
                                   F.first("n").alias("n"), F.first("h").alias("h"))
    peak = F.nullif(F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)), F.lit(0.0))
    return g.select(F.col("cls").alias(class_col), "gi", "x", (F.col("_s") / peak).alias("density"))


def fixed_bins_mean(df: DataFrame, col: str, edges: list[float], value_cols: list[str]) -> DataFrame:
    """PRF17 + AGG5: right-closed bins (e_i, e_i+1] (values outside are dropped),
    then the mean of ``value_cols`` per bin; empty bins are kept with NULL means."""
    x = F.col(q(col)).cast("double")
    k = len(edges) - 1
    idx = F.lit(-1)
    for e in edges[:-1]:
        idx = idx + (x > F.lit(float(e))).cast("int")
    inside = (x > F.lit(float(edges[0]))) & (x <= F.lit(float(edges[-1])))
    d = df.select(F.when(inside, idx).alias("bin"), *[F.col(q(c)).cast("double").alias(c) for c in value_cols])
    means = d.filter(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.avg(q(c)).alias(f"{c}_mean") for c in value_cols])
    spark = df.sparkSession
    grid = spark.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(k)],
                                 "bin int, lower double, upper double")
    return grid.join(means, "bin", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("long"))


def corr_with_label(df: DataFrame, label: str, cols: list[str] | None = None) -> DataFrame:
    """PRF18: Pearson correlation of each numeric column with the label over
    pairwise-complete rows, sorted ascending (head/tail give TOP5)."""
    cols = cols or [c for c in numeric_columns(df) if c != label]
    y = F.col(q(label)).cast("double")
    agg = df.agg(*[F.corr(F.col(q(c)).cast("double"), y).alias(f"corr{i}") for i, c in enumerate(cols)])
    return _unpivot_row(agg, cols, {"corr": None}).select(F.col("column").alias("feature"), "corr")


def pair_corr(df: DataFrame, a: str, b: str) -> DataFrame:
    """PRF19."""
    return df.agg(F.corr(F.col(q(a)).cast("double"), F.col(q(b)).cast("double")).alias("corr"))


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """PRF20: lower triangle (i > j) of the correlation matrix over pairwise-complete rows, in one scan at any width.

    Each task multiplies its rows, as a matrix and a matrix of what is present, into six sums per pair (counts, sums,
    squares, products, of values less a constant per column, which keeps digits); the sums are added over tasks.  What is shuffled
    depends on the number of columns and tasks only.  A pair without common rows, or with a column constant there, is NULL."""
    p = len(cols)
    data = df.select(*[F.nanvl(F.col(q(c)).cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(cols)])
    some = data.limit(1_000).agg(*[F.coalesce(F.avg(f"c{i}"), F.lit(0.0)).alias(f"c{i}") for i in range(p)]).first()
    shift = np.array([some[f"c{i}"] for i in range(p)])  # any constant gives the same result

    def grams(batches):
        total = np.zeros((6, p, p))
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                part = batch.slice(at, 4_096)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns]) - shift
                there = ~np.isnan(x)
                x, m = np.where(there, x, 0.0), there.astype(np.float64)
                total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        for i in range(p):
            rows = pa.array([total[s, i, :i].tolist() for s in range(6)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(rows.slice(s, 1) for s in range(6))], names=["i", *names])

    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    sums = data.mapInArrow(grams, "i int, " + ", ".join(f"{n} array<double>" for n in names))
    pairs = sums.select("i", F.posexplode(F.arrays_zip(*names)).alias("j", "s")).groupBy("i", "j").agg(*[F.sum(f"s.{n}").alias(n) for n in names])
    n = F.nullif(F.col("n"), F.lit(0.0))
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    varies = (vx > F.col("sxx") * 1e-14) & (vy > F.col("syy") * 1e-14)  # below, what is left is rounding
    name = lambda at: F.get(F.array(*[F.lit(c) for c in cols]), at)
    return pairs.select(name(F.col("i")).alias("row"), name(F.col("j")).alias("col"), F.when(varies, cov / F.sqrt(vx * vy)).alias("corr"))


def segment_compare(df: DataFrame, flag: F.Column, label: str) -> DataFrame:
    """PRF21: label mean and row count per segment (e.g. anomalous vs normal)."""
    return df.groupBy(flag.alias("segment")).agg(F.avg(F.col(q(label)).cast("double")).alias("label_mean"),
                                                 F.count(F.lit(1)).alias("n_rows"))


def top_bottom(df: DataFrame, by: str, k: int = 15) -> tuple[DataFrame, DataFrame]:
    """TOP5: the k highest and k lowest rows by a column (ties by the first column)."""
    first = df.columns[0]
    return df.orderBy(F.desc_nulls_last(by), first).limit(k), df.orderBy(F.asc_nulls_last(by), first).limit(k)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("math", "np", "pa", "T")]
