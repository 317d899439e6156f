"""SMOTE (SMP6): synthetic minority rows between exact nearest neighbours.

1. Minority points are numbered in the order of their id: rows are range-partitioned
   and sorted, partitions' counts give the offsets (no single-task window).
2. ``neighbours.nearest`` finds each point's k nearest minority points, exactly.
3. ``int(n_major * ratio - n_minor)`` rows from ``range``: row j picks a (point,
   neighbour) pair and a gap in [0, 1) by a hash of j; x_new = x + gap * (neighbour - x).

A point is one array column throughout; joins are on numbers and ids.  A hash-drawn
pair is spread evenly, so no key of these joins is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.expr import q
from riskframe.operators.neighbours import CELL, nearest
from riskframe.session import cut_lineage


def numbered(points: DataFrame, order: str) -> DataFrame:
    """The rows with ``rank``: 0, 1, ... in the order of a column without repeats."""
    sorted_rows = points.repartitionByRange(order).sortWithinPartitions(order)
    rows = cut_lineage(sorted_rows.withColumn("__at", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftright("__at", 33))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__from"))
    rank = F.col("__from") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(offsets), "__part").withColumn("rank", rank).drop("__at", "__part", "__from")


def points_of(rows: DataFrame, id_col: str, features: list[str]) -> DataFrame:
    """``id`` and ``x``, the features as one array."""
    return rows.select(F.col(q(id_col)).alias("id"), F.expr("array(" + ", ".join(f"cast({q(f)} as double)" for f in features) + ")").alias("x"))


def smote(data: DataFrame, label: str, id_col: str, features: list[str], ratio: float = 1.0, k: int = 5,
          seed: int = 42, cell: int = CELL) -> DataFrame:
    """Original rows plus ``int(n_major * ratio - n_minor)`` synthetic minority
    rows (the minority's label, id NULL, ``synthetic`` = true, numbered by ``synthetic_no``).

    Ids are different whole numbers; features have no nulls."""
    counts = {r[label]: r["n"] for r in data.groupBy(q(label)).agg(F.count(F.lit(1)).alias("n")).collect()}
    base = data.select(q(id_col), q(label), *[F.col(q(f)).cast("double").alias(f) for f in features], F.lit(False).alias("synthetic"),
                       F.lit(None).cast("long").alias("synthetic_no"))
    if not counts:
        return base
    minority = min(counts, key=lambda c: (counts[c], c))
    n_min = counts[minority]
    n_maj = max(v for c, v in counts.items() if c != minority) if len(counts) > 1 else 0
    n_new = int(n_maj * ratio - n_min)
    if n_new <= 0 or n_min < 2:
        return base
    kk = min(k, n_min - 1)
    points = cut_lineage(numbered(points_of(data.filter(F.col(q(label)) == minority), id_col, features), "id"))
    found = nearest(points, "id", "x", kk, cell, seed).rows
    h = F.md5(F.concat(F.col("no").cast("string"), F.lit(f"|smote|{seed}")))
    drawn = data.sparkSession.range(n_new).select(F.col("id").alias("no")).select(
        "no", F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("long"), F.lit(n_min * kk)).alias("pair"),
        (F.conv(F.substring(h, 16, 8), 16, 10).cast("double") / F.lit(float(16 ** 8))).alias("gap"))
    drawn = drawn.select("no", F.floor(F.col("pair") / kk).cast("long").alias("rank"), (F.col("pair") % kk + 1).cast("int").alias("position"), "gap")
    ends = points.select(F.col("id").alias("neighbour"), F.col("x").alias("y"))
    pairs = (drawn.join(points, "rank").join(found.select("id", "position", "neighbour"), ["id", "position"]).join(ends, "neighbour"))
    made = pairs.select("no", "gap", F.zip_with("x", "y", lambda a, b: b - a).alias("way"), "x").select(
        "no", F.zip_with("x", F.transform("way", lambda w: F.col("gap") * w), lambda a, w: a + w).alias("x"))
    made = cut_lineage(made)
    synthetic = made.select(F.lit(None).cast(data.schema[id_col].dataType).alias(id_col), F.lit(minority).cast(data.schema[label].dataType).alias(label),
                            *[F.get("x", F.lit(i)).alias(f) for i, f in enumerate(features)], F.lit(True).alias("synthetic"),
                            F.col("no").alias("synthetic_no"))
    return base.unionByName(synthetic)
