"""Binding of the library's roles to the driver's test tables.

The reference works on loan tables that are not available; each role is bound
to a driver table (see README, "Binding").  Everything here reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.sources.tables import read_table


class Tables:
    """Lazy accessor: ``Tables(spark, sf_dir).orders`` reads orders.parquet."""

    def __init__(self, spark: SparkSession, base_dir: str):
        self.spark = spark
        self.base_dir = base_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, self.base_dir, name)
        return self._cache[name]


def scored_lineitem(t: Tables) -> DataFrame:
    """(y, p) table for the metric operators: y = returnflag 'R', p = price/110000."""
    li = t.lineitem
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("y"),
                     (F.col("l_extendedprice") / F.lit(110000.0)).alias("p"))


def profile_base(t: Tables) -> DataFrame:
    """lineitem with nulls made by ``nullif`` (the driver tables hold none)."""
    li = t.lineitem
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.expr("nullif(l_discount, 0.0)").alias("l_discount"),
        F.expr("nullif(l_tax, 0.0)").alias("l_tax"),
        F.expr("nullif(l_returnflag, 'N')").alias("l_returnflag"),
        "l_linestatus",
    )
