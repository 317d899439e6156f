"""AGG4: the whole feature table (flagship plan).

Parent features (PRJ4, PRJ8, PRJ9, PRJ10) on the applicant table, the two-level
rollup (AGG2) and the one-level rollups (AGG3), all left-joined on the parent
key (JN1) in one lazy plan.  Driver barriers: the vocabulary job(s) only.

Binding on the driver tables: applicant = customer, child = orders,
grandchild = lineitem, other child = events (by user_id).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.expr import q, safe_div
from riskframe.operators.encode import label_encode, one_hot, string_columns, vocabulary_and_nulls
from riskframe.operators.rollup import (
    RollupSpec,
    agg_numeric_and_cat,
    left_attach,
    rollup_spec,
    two_level_rollup,
)
from riskframe.plans.tables import Tables


@dataclass
class ChildRollup:
    table: DataFrame
    key: str
    prefix: str
    exclude: tuple = ()


def parent_features(customer: DataFrame) -> tuple[DataFrame, list[str]]:
    """Scalar features on the applicant table.

    ``c_name`` is a free-text id and is not a category; it is dropped before
    encoding.  Ratios divide with NULL on a zero divisor.
    """
    base = customer.drop("c_name").withColumn(
        "ACCTBAL_PER_NATION", safe_div(F.col("c_acctbal"), F.col("c_nationkey")))
    cats = string_columns(base, ("c_custkey",))
    vocab, nulls = vocabulary_and_nulls(base, cats)  # one job shared by both encoders
    base, _, encoded = label_encode(base, None, exclude=("c_custkey",), vocab_nulls=(vocab, nulls))
    rest = [c for c in cats if c not in encoded]
    base, dummies = one_hot(base, rest, dummy_na=False, vocab=vocab)
    return base, dummies


def feature_table(t: Tables, extra_children: list[ChildRollup] | None = None) -> tuple[DataFrame, dict]:
    parent, dummies = parent_features(t.customer)
    ord_agg, li_spec, ord_spec = two_level_rollup(
        t.lineitem, "l_orderkey", "LI_", t.orders, "o_orderkey", "o_custkey", "ORD_")
    out = left_attach(parent, ord_agg, "c_custkey", "o_custkey")
    specs: dict[str, RollupSpec] = {"LI_": li_spec, "ORD_": ord_spec}
    children = extra_children if extra_children is not None else [
        ChildRollup(t.events, "user_id", "EVT_", ("props",)),
    ]
    for ch in children:
        spec = rollup_spec(ch.table, ch.key, ch.prefix, ch.exclude)
        specs[ch.prefix] = spec
        out = left_attach(out, agg_numeric_and_cat(ch.table, ch.key, ch.prefix, spec=spec), "c_custkey", ch.key)
    return out, {"specs": specs, "dummies": dummies}


def children_of_customers(t: Tables) -> list[tuple[ChildRollup, str]]:
    """Four children of a customer with the parent column that each is attached by: events (the number in their JSON included), orders,
    line items of these orders, and the suppliers of the customer's nation."""
    events = t.events.withColumn("props_k", F.get_json_object("props", "$.k").try_cast("double")).drop("props")
    lines = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return [(ChildRollup(events, "user_id", "EVT_"), "c_custkey"), (ChildRollup(t.orders, "o_custkey", "PREV_"), "c_custkey"),
            (ChildRollup(lines, "o_custkey", "INST_"), "c_custkey"), (ChildRollup(t.supplier, "s_nationkey", "SUP_", ("s_name",)), "c_nationkey")]


def attach_children(parent: DataFrame, children: list[tuple[ChildRollup, str]]) -> tuple[DataFrame, dict[str, RollupSpec]]:
    """AGG3: one-level rollups of any number of children, left-joined to the parent; the categories of all of them come from one job."""
    pairs = None
    for i, (ch, _) in enumerate(children):
        cats = string_columns(ch.table, {ch.key, *ch.exclude})
        if cats:
            found = ch.table.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.col(q(c)).alias("v")) for c in cats])))
            pairs = found if pairs is None else pairs.unionAll(found)
    vocab: dict[int, dict[str, list]] = {i: {c: [] for c in string_columns(ch.table, {ch.key, *ch.exclude})} for i, (ch, _) in enumerate(children)}
    for r in pairs.where("v IS NOT NULL").distinct().orderBy("i", "c", "v").collect() if pairs is not None else []:  # each becomes a column
        vocab[r["i"]][r["c"]].append(r["v"])
    specs, out = {}, parent
    for i, (ch, parent_key) in enumerate(children):
        specs[ch.prefix] = spec = rollup_spec(ch.table, ch.key, ch.prefix, ch.exclude, vocab[i])
        out = left_attach(out, agg_numeric_and_cat(ch.table, ch.key, ch.prefix, spec=spec), parent_key, ch.key)
    return out, specs


def orders_rollup(t: Tables) -> tuple[DataFrame, RollupSpec]:
    """AGG1 alone: orders by customer, prefix ORD_."""
    spec = rollup_spec(t.orders, "o_custkey", "ORD_")
    return agg_numeric_and_cat(t.orders, "o_custkey", "ORD_", spec=spec), spec


def order_lines_rollup(t: Tables) -> tuple[DataFrame, RollupSpec, RollupSpec]:
    """AGG2 alone: lineitem -> orders -> customer key."""
    return two_level_rollup(t.lineitem, "l_orderkey", "LI_", t.orders, "o_orderkey", "o_custkey", "ORD_")


# Fixed value shared with the SQL checks: a scale that moves "round" numbers
# (halves, quarters) away from the float rounding boundaries.
SNAP_SCALE = 1.0000000441


def snap(c):
    """Round a double to float precision through an odd scale (see SNAP_SCALE)."""
    return (c.cast("double") * F.lit(SNAP_SCALE)).cast("float").cast("double") / F.lit(SNAP_SCALE)


def passed_through(name: str) -> bool:
    """Whether a rollup's column is a value of the data (a smallest or largest one), not the result of a summation."""
    return name.endswith(("_MIN", "_MAX")) and not any(s in name for s in ("_MEAN", "_SUM", "_VAR"))


def snap_doubles(df: DataFrame, raw: tuple | list = ()) -> DataFrame:
    """Round doubles but the ``raw`` ones to float precision (for order-insensitive checks
    where summation order differs between engines).  Built as SQL text: one
    call per column instead of one per operator."""
    from pyspark.sql import types as T
    cols = []
    for f in df.schema.fields:
        if f.name not in set(raw) and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(f"CAST(CAST(CAST({q(f.name)} AS DOUBLE) * {SNAP_SCALE!r} AS FLOAT) AS DOUBLE) "
                        f"/ {SNAP_SCALE!r} AS {q(f.name)}")
        else:
            cols.append(q(f.name))
    return df.selectExpr(*cols)
