"""Fitted preprocessing (ML1, ML2, ML3, ML5).

Fitting is one aggregate over the training table; the fitted values are a
handful of numbers per column, applied as plain column expressions.
``ml.Imputer`` (its median is not interpolated) and ``ml.StandardScaler``
(sample std) give other numbers than the reference's imputer and scaler,
so both are written here.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.expr import q
from riskframe.operators.ordered import exact_quantiles, null_safe_join


@dataclass
class MedianImputer:
    """ML1: exact interpolated median per column; all-missing columns are dropped."""

    medians: dict[str, float] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str]) -> "MedianImputer":
        long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(q(c)).cast("double").alias("v"))
                                            for c in cols])))
        rows = exact_quantiles(long, ["column"], "v", [0.5]).select("column", "quantile").collect()
        med = {r["column"]: r["quantile"] for r in rows}
        return cls({c: med[c] for c in cols if c in med}, [c for c in cols if c not in med])

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.dropped:
                continue
            if c in self.medians:
                out.append(F.coalesce(F.col(q(c)).cast("double"), F.lit(float(self.medians[c]))).alias(c))
            else:
                out.append(F.col(q(c)))
        return df.select(*out)

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(sorted(self.medians.items()), "column string, median double")


@dataclass
class Standardizer:
    """ML2: (x - mean) / population std, a zero std counts as 1; centring optional."""

    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)
    with_mean: bool = True

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str], with_mean: bool = True) -> "Standardizer":
        row = df.agg(*[F.avg(F.col(q(c)).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_pop(F.col(q(c)).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        means = {c: row[f"m{i}"] for i, c in enumerate(cols)}
        stds = {c: (row[f"s{i}"] if row[f"s{i}"] else 1.0) for i, c in enumerate(cols)}
        return cls(means, stds, with_mean)

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.stds:
                x = F.col(q(c)).cast("double")
                if self.with_mean:
                    x = x - F.lit(float(self.means[c] or 0.0))
                out.append((x / F.lit(float(self.stds[c]))).alias(c))
            else:
                out.append(F.col(q(c)))
        return df.select(*out)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """ML5: 'balanced' weight n / (k * n_class) per row (k = number of classes; a NULL label is a class)."""
    counts = df.groupBy(q(label)).agg(F.count(F.lit(1)).alias("_nc"))
    w = Window.partitionBy()
    counts = counts.withColumn("weight", F.sum("_nc").over(w) / (F.count(F.lit(1)).over(w) * F.col("_nc")))
    return null_safe_join(df, counts.select(q(label), "weight"), [label])


def prior_baseline(df: DataFrame, label: str, strategy: str = "prior") -> DataFrame:
    """ML3: constant model.  'prior' gives the positive rate as probability;
    'most_frequent' gives the majority class as 0/1 probability."""
    stats = df.agg(F.avg(F.col(q(label)).cast("double")).alias("_p"))
    if strategy == "most_frequent":
        stats = stats.select((F.col("_p") > 0.5).cast("double").alias("_p"))
    # the one statistic as a scalar subquery (run once, no join)
    return df.withColumn("proba_default", stats.select("_p").scalar())
