"""Drift between a reference table and production data (DR1-DR9, TOP2-TOP7).

Both sides are unpivoted to one long table ``(side, feature, v_str, v_num,
raw_null)``; every statistic is then a grouped aggregate over that table, so
the number of jobs does not grow with the number of features and the work is
spread over (feature, value) keys.  Only per-feature results are small enough to
be broadcast; they are checkpointed, and no cache is left behind.

Semantics kept from the reference (see README, "Drift"):
* numeric vs categorical is decided on the reference side only: at least 95 %
  of its non-missing values parse as numbers (an all-missing column is numeric);
* numeric PSI: bins from the distinct reference quantiles (linear method),
  equal-width fallback when fewer than 3 edges remain, outer edges open,
  right-closed bins, a MISSING bin; bin shares over non-missing rows and the
  missing share over all rows, both divided by (1 + missing share);
* a reference with at most one distinct value uses CONST/MISSING shares;
* categorical PSI: top-k reference categories (MISSING may take a slot),
  the rest OTHER; shares over all rows;
* shares are floored at 1e-6; PSI = sum((a - b) * ln(a / b)).
Deviation: an empty production side gives NULL PSI and rates ("no data" is
not reported as "no drift").
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.expr import clean_double, parse_numeric_text, q
from riskframe.operators.encode import reindex_union
from riskframe.operators.ordered import exact_quantiles
from riskframe.session import cut_lineage

# Fixed values of the reference's drift rules.
EPS = 1e-6
MIN_NUMERIC_RATIO = 0.95
PSI_BANDS = (0.1, 0.2, 0.3)  # low < 0.1 <= moderate < 0.2 <= high < 0.3 <= severe
KIND_VALUE, KIND_OTHER, KIND_MISSING = 0, 1, 2


def to_long(df: DataFrame, side: str, cols: list[str] | None = None) -> DataFrame:
    """(side, feature, v_str, v_num, raw_null) for every cell of ``cols``.

    v_num is the guarded numeric reading (NaN/Inf -> NULL); v_str the text;
    raw_null marks NULL/NaN cells (the reference's raw missing rate).
    """
    cols = cols or df.columns
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    structs = []
    for c in cols:
        x = F.col(q(c))
        t = types[c]
        if isinstance(t, T.StringType):
            num = parse_numeric_text(x)
            txt = x
            raw_null = x.isNull()
        elif isinstance(t, (T.NumericType, T.BooleanType)):
            num = clean_double(x.cast("double"))
            txt = x.cast("string")
            raw_null = x.isNull() | (F.isnan(x.cast("double")) if isinstance(t, (T.DoubleType, T.FloatType)) else F.lit(False))
            txt = F.when(raw_null, F.lit(None).cast("string")).otherwise(txt)
        else:
            num = F.lit(None).cast("double")
            txt = x.cast("string")
            raw_null = x.isNull()
        structs.append(F.struct(F.lit(c).alias("feature"), txt.alias("v_str"), num.alias("v_num"),
                                raw_null.alias("raw_null")))
    return df.select(F.lit(side).alias("side"), F.inline(F.array(*structs)))


def psi_term(a: F.Column, b: F.Column) -> F.Column:
    """(a - b) ln(a / b) with shares floored at EPS; NULL (skipped by sum) when
    either share is undefined (``greatest`` alone would skip the NULL)."""
    a2 = F.greatest(a, F.lit(EPS))
    b2 = F.greatest(b, F.lit(EPS))
    return F.when(a.isNotNull() & b.isNotNull(), (a2 - b2) * F.log(a2 / b2))


def feature_stats(long: DataFrame) -> DataFrame:
    """Per feature: row counts, raw non-null and numeric counts, min/max of the
    numeric reading, for each side (one aggregate)."""
    def on(side, e):
        return F.when(F.col("side") == side, e)
    return long.groupBy("feature").agg(
        F.count(on("ref", F.lit(1))).alias("ref_n"),
        F.count(on("prod", F.lit(1))).alias("prod_n"),
        F.count(on("ref", F.when(~F.col("raw_null"), 1))).alias("ref_nonnull"),
        F.count(on("prod", F.when(~F.col("raw_null"), 1))).alias("prod_nonnull"),
        F.count(on("ref", F.col("v_num"))).alias("ref_vals"),
        F.count(on("prod", F.col("v_num"))).alias("prod_vals"),
        F.min(on("ref", F.col("v_num"))).alias("ref_min"),
        F.max(on("ref", F.col("v_num"))).alias("ref_max"),
    ).withColumn(
        # DR1: decided on the reference side
        "is_numeric",
        (F.col("ref_nonnull") == 0) | (F.col("ref_vals") >= F.lit(MIN_NUMERIC_RATIO) * F.col("ref_nonnull")),
    )


def numeric_edges(long: DataFrame, stats: DataFrame, bins: int) -> DataFrame:
    """DR2: per numeric non-constant feature, the inner bin edges and the bin count."""
    probs = [float(x) for x in np.linspace(0, 1, bins + 1)]
    feats = stats.filter(F.col("is_numeric") & (F.col("ref_min") < F.col("ref_max"))).select("feature", "ref_min", "ref_max")
    ref_vals = long.filter((F.col("side") == "ref") & F.col("v_num").isNotNull()).join(
        F.broadcast(feats.select("feature")), "feature", "left_semi")  # one row per feature: bounded by the schema
    qs = exact_quantiles(ref_vals, ["feature"], "v_num", probs)
    edges = qs.groupBy("feature").agg(F.array_distinct(F.array_sort(F.collect_list("quantile"))).alias("_q"))
    edges = edges.join(feats, "feature")
    mn, mx = F.col("ref_min"), F.col("ref_max")
    step = (mx - mn) / F.lit(float(bins))
    lin = F.array(*[mn + F.lit(float(i)) * step for i in range(bins)], mx)
    e = F.when(F.size("_q") < 3, lin).otherwise(F.col("_q"))
    edges = edges.select("feature", e.alias("edges"))
    return edges.select("feature", F.slice("edges", 2, F.size("edges") - 2).alias("inner"),
                        (F.size("edges") - 1).alias("n_bins"))


def bin_index(inner: F.Column, v: F.Column, max_inner: int) -> F.Column:
    """Right-closed bin id: the number of inner edges strictly below v."""
    total = F.lit(0)
    for i in range(1, max_inner + 1):
        total = total + F.coalesce((F.try_element_at(inner, F.lit(i)) < v).cast("int"), F.lit(0))
    return total


def numeric_psi(long: DataFrame, stats: DataFrame, bins: int) -> DataFrame:
    """DR3 + DR4: (feature, psi) for numeric features."""
    edges = cut_lineage(numeric_edges(long, stats, bins))
    vals = long.filter(F.col("v_num").isNotNull()).join(F.broadcast(edges), "feature")
    counts = vals.groupBy("feature", "side", bin_index(F.col("inner"), F.col("v_num"), bins - 1).alias("bin")).agg(
        F.count(F.lit(1)).alias("cnt"))
    grid = edges.select("feature", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))
    wide = grid.join(counts.groupBy("feature", "bin").agg(
        F.sum(F.when(F.col("side") == "ref", F.col("cnt"))).alias("c_ref"),
        F.sum(F.when(F.col("side") == "prod", F.col("cnt"))).alias("c_prod")), ["feature", "bin"], "left")
    st = stats.select("feature", "ref_n", "prod_n", "ref_vals", "prod_vals")
    wide = wide.join(st, "feature")
    m_ref = F.try_divide(F.col("ref_n") - F.col("ref_vals"), F.col("ref_n").cast("double"))
    m_prod = F.try_divide(F.col("prod_n") - F.col("prod_vals"), F.col("prod_n").cast("double"))
    # shares are renormalised by their sum; bin shares of a side without
    # numeric values are undefined (skipped), so that sum is then the missing share alone
    norm_ref = F.when(F.col("ref_vals") > 0, F.lit(1.0)).otherwise(F.lit(0.0)) + m_ref
    norm_prod = F.when(F.col("prod_vals") > 0, F.lit(1.0)).otherwise(F.lit(0.0)) + m_prod
    a = F.when(F.col("ref_vals") > 0, F.coalesce(F.col("c_ref"), F.lit(0)) / F.col("ref_vals") / norm_ref)
    b = F.when(F.col("prod_vals") > 0, F.coalesce(F.col("c_prod"), F.lit(0)) / F.col("prod_vals") / norm_prod)
    bin_part = wide.groupBy("feature").agg(F.sum(psi_term(a, b)).alias("psi_bins"))
    miss = st.join(edges.select("feature"), "feature").select(
        "feature", psi_term(F.try_divide(m_ref, norm_ref), F.try_divide(m_prod, norm_prod)).alias("psi_missing"))
    binned = miss.join(bin_part, "feature", "left").select(
        "feature", (F.coalesce(F.col("psi_bins"), F.lit(0.0)) + F.col("psi_missing")).alias("psi"))
    # DR4: constant (or empty) reference: CONST vs MISSING shares over all rows
    const = stats.filter(F.col("is_numeric") & ~(F.col("ref_min") < F.col("ref_max")).eqNullSafe(True))
    c_ref = F.try_divide(F.col("ref_vals"), F.col("ref_n").cast("double"))
    c_prod = F.try_divide(F.col("prod_vals"), F.col("prod_n").cast("double"))
    const_psi = const.select(
        "feature",
        F.when((F.col("ref_vals") == 0) & (F.col("prod_vals") == 0), F.lit(0.0)).otherwise(
            psi_term(c_ref, c_prod) + psi_term(F.lit(1.0) - c_ref, F.lit(1.0) - c_prod)).alias("psi"))
    return binned.unionByName(const_psi)


def categorical_psi(long: DataFrame, stats: DataFrame, top_k: int) -> DataFrame:
    """DR5: (feature, psi) for categorical features."""
    cat = stats.filter(~F.col("is_numeric")).select("feature", "ref_n", "prod_n")
    cl = long.join(F.broadcast(cat.select("feature")), "feature", "left_semi")
    counts = cl.groupBy("feature", "side", "v_str").agg(F.count(F.lit(1)).alias("cnt"))
    # TOP6: ref categories ranked by count, ties by value (MISSING, a NULL here,
    # ranks last).  Two stages so that no task sorts all values of a
    # high-cardinality feature: the top k inside each of 256 hash buckets, then
    # the top k of that union (exact: a global top-k value is in its bucket's top k).
    order = (F.desc("cnt"), F.asc_nulls_last("v_str"))
    ref_counts = counts.filter(F.col("side") == "ref").withColumn(
        "_hb", F.pmod(F.hash(F.coalesce(F.col("v_str"), F.lit(""))), F.lit(256)))
    w1 = Window.partitionBy("feature", "_hb").orderBy(*order)
    local = ref_counts.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= top_k)
    w = Window.partitionBy("feature").orderBy(*order)
    top = (local.withColumn("_r", F.row_number().over(w))
           .filter(F.col("_r") <= top_k).select("feature", "v_str", F.lit(True).alias("_top")))
    mapped = counts.join(top, ["feature", "v_str"], "left").select(
        "feature", "side", "cnt",
        F.when(F.col("v_str").isNull(), F.lit(KIND_MISSING))
         .when(F.col("_top").isNotNull(), F.lit(KIND_VALUE)).otherwise(F.lit(KIND_OTHER)).alias("kind"),
        F.when(F.col("_top").isNotNull() & F.col("v_str").isNotNull(), F.col("v_str")).alias("cat"))
    shares = mapped.groupBy("feature", "kind", "cat").agg(
        F.sum(F.when(F.col("side") == "ref", F.col("cnt"))).alias("c_ref"),
        F.sum(F.when(F.col("side") == "prod", F.col("cnt"))).alias("c_prod")).join(cat, "feature")
    a = F.try_divide(F.coalesce(F.col("c_ref"), F.lit(0)), F.col("ref_n").cast("double"))
    b = F.try_divide(F.coalesce(F.col("c_prod"), F.lit(0)), F.col("prod_n").cast("double"))
    return shares.groupBy("feature").agg(F.sum(psi_term(a, b)).alias("psi"))


def severity(psi: F.Column) -> F.Column:
    """DR9 band."""
    lo, mid, hi = PSI_BANDS
    return (F.when(psi.isNull(), F.lit(None)).when(psi < lo, "low").when(psi < mid, "moderate")
            .when(psi < hi, "high").otherwise("severe"))


def compute_drift(ref: DataFrame, prod: DataFrame, bins: int = 10, cat_top_k: int = 30) -> DataFrame:
    """DR8: one row per feature of the column union: feature, type, psi,
    ref_missing_rate, prod_missing_rate, missing_rate_delta, ref_n, prod_n,
    severity."""
    ref2, prod2, cols = reindex_union(ref, prod)
    long = to_long(ref2, "ref", cols).unionByName(to_long(prod2, "prod", cols))
    return drift_from_long(long, bins, cat_top_k)


def drift_from_long(long: DataFrame, bins: int = 10, cat_top_k: int = 30) -> DataFrame:
    """DR8 on an already unpivoted table.  The sources are scanned once per
    kind of statistic (column-pruned); nothing of their size is cached.  The
    per-feature statistics and edges are checkpointed."""
    stats = cut_lineage(feature_stats(long))
    psi = numeric_psi(long, stats, bins).unionByName(categorical_psi(long, stats, cat_top_k))
    r_ref = F.try_divide(F.col("ref_n") - F.col("ref_nonnull"), F.col("ref_n").cast("double"))
    r_prod = F.try_divide(F.col("prod_n") - F.col("prod_nonnull"), F.col("prod_n").cast("double"))
    out = stats.join(psi, "feature", "left").select(
        "feature",
        F.when(F.col("is_numeric"), "numeric").otherwise("categorical").alias("type"),
        F.when(F.col("prod_n") > 0, F.col("psi")).alias("psi"),
        F.try_divide(F.col("ref_n") - F.col("ref_nonnull"), F.col("ref_n").cast("double")).alias("ref_missing_rate"),
        F.try_divide(F.col("prod_n") - F.col("prod_nonnull"), F.col("prod_n").cast("double")).alias("prod_missing_rate"),
        F.when((F.col("ref_n") > 0) & (F.col("prod_n") > 0), r_prod - r_ref).alias("missing_rate_delta"),
        F.col("ref_n").cast("long").alias("ref_n"), F.col("prod_n").cast("long").alias("prod_n"),
    )
    return out.withColumn("severity", severity(F.col("psi")))


def top_psi(report: DataFrame, k: int = 30) -> DataFrame:
    """TOP2: highest PSI first, ties by feature name."""
    return report.orderBy(F.desc_nulls_last("psi"), "feature").limit(k)


def top_missing_delta(report: DataFrame, k: int = 30) -> DataFrame:
    """TOP3: largest absolute missing-rate change first, ties by feature name."""
    return report.orderBy(F.desc_nulls_last(F.abs("missing_rate_delta")), "feature").limit(k)


def report_view(report: DataFrame, min_psi: float = 0.1, only_high_missing: bool = False) -> DataFrame:
    """TOP7: the dashboard filter: psi >= min, optional |delta| >= 0.05, psi desc."""
    v = report.filter(F.col("psi") >= F.lit(float(min_psi)))
    if only_high_missing:
        v = v.filter(F.abs("missing_rate_delta") >= F.lit(0.05))
    return v.orderBy(F.desc("psi"), "feature")


def report_document(report: DataFrame, extra: dict | None = None, k: int = 30) -> DataFrame:
    """SNK4 shape: one row with the summary scalars and the three lists."""
    fields = [F.struct(*[F.col(c) for c in report.columns]) for _ in range(1)][0]
    summary = report.agg(
        F.max("ref_n").alias("n_ref_rows"), F.max("prod_n").alias("n_prod_rows"),
        F.count(F.lit(1)).alias("features_total"),
        F.sort_array(F.collect_list(F.struct(
            F.coalesce(-F.col("psi"), F.lit(float("inf"))).alias("_k1"), F.col("feature").alias("_k2"), fields.alias("f"))))
        .alias("_by_psi"),
        F.sort_array(F.collect_list(F.struct(
            F.coalesce(-F.abs(F.col("missing_rate_delta")), F.lit(float("inf"))).alias("_k1"),
            F.col("feature").alias("_k2"), fields.alias("f")))).alias("_by_missing"),
        F.sort_array(F.collect_list(F.struct(F.col("feature").alias("_k"), fields.alias("f")))).alias("_all"),
    )
    doc = summary.select(
        "n_ref_rows", "n_prod_rows", "features_total",
        F.slice(F.col("_by_psi.f"), 1, k).alias("top_psi"),
        F.slice(F.col("_by_missing.f"), 1, k).alias("top_missing_delta"),
        F.col("_all.f").alias("all_features"),
        F.struct(*[F.lit(v).alias(n) for v, n in zip(PSI_BANDS, ("psi_low", "psi_medium", "psi_high"))]).alias("thresholds"),
    )
    for key, value in (extra or {}).items():
        doc = doc.withColumn(key, F.lit(value))
    return doc
