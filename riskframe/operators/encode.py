"""Vocabularies and encodings (PRJ9-PRJ14).

One-hot columns are data-driven, so the vocabulary of each string column is
found first (one aggregate job for all columns together; only the distinct
values travel to the driver: each names a column of the result).  The dummies are
then plain projections ``cast(c <=> v as int)``: no ``ml.OneHotEncoder``
because named columns ``COL_value`` are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.expr import q

def string_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in set(exclude)]


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    num = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, num) and f.name not in set(exclude)]


def vocabulary_and_nulls(df: DataFrame, cols: list[str], max_categories: int | None = None
                         ) -> tuple[dict[str, list], dict[str, bool]]:
    """Sorted distinct non-null values per column and whether it holds NULLs,
    in one job.

    The (column, value) pairs are made distinct by a shuffle (spread over
    tasks, map-side combined).  Each of them becomes a column of the result,
    so their number is bounded by what a table can hold; ``max_categories``
    (none by default) refuses a column with more non-null values by name.
    """
    if not cols:
        return {}, {}
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(q(c)).cast("string").alias("v"))
                                        for i, c in enumerate(cols)]))).distinct()
    if max_categories is not None:
        for r in pairs.where("v is not null").groupBy("c").count().where(F.col("count") > max_categories).collect():
            raise ValueError(f"column {cols[r['c']]!r} has {r['count']} distinct values (> {max_categories}); not a categorical column")
    vocab: dict[str, list] = {c: [] for c in cols}
    nulls = dict.fromkeys(cols, False)
    for r in pairs.collect():
        if r["v"] is None:
            nulls[cols[r["c"]]] = True
        else:
            vocab[cols[r["c"]]].append(r["v"])
    return {c: sorted(values) for c, values in vocab.items()}, nulls


def vocabulary(df: DataFrame, cols: list[str], max_categories: int | None = None) -> dict[str, list]:
    """Sorted distinct non-null values per column (see ``vocabulary_and_nulls``)."""
    return vocabulary_and_nulls(df, cols, max_categories)[0]


def dummy_name(col: str, value) -> str:
    return f"{col}_{value}"


def dummy_specs(vocab: dict[str, list], dummy_na: bool) -> list[tuple[str, str, object]]:
    """(source column, dummy name, value or None for the null dummy), in
    pandas ``get_dummies`` order: by column, values sorted, null dummy last."""
    specs = []
    for c, values in vocab.items():
        for v in values:
            specs.append((c, dummy_name(c, v), v))
        if dummy_na:
            specs.append((c, dummy_name(c, "nan"), None))
    return specs


def dummy_expr(source: str, value) -> F.Column:
    c = F.col(q(source))
    if value is None:
        return c.isNull().cast("int")
    return c.eqNullSafe(F.lit(value)).cast("int")


def one_hot(df: DataFrame, cols: list[str] | None = None, dummy_na: bool = False,
            vocab: dict[str, list] | None = None) -> tuple[DataFrame, list[str]]:
    """PRJ10 / PRJ11: replace every string column by its dummies.

    ``dummy_na=True`` always adds ``COL_nan`` (even without nulls), as the
    reference's ``one_hot_encoder`` does; ``False`` mirrors ``get_dummies``.
    Returns the new frame and the list of dummy columns.
    """
    cols = string_columns(df) if cols is None else cols
    vocab = vocabulary(df, cols) if vocab is None else vocab
    specs = dummy_specs({c: vocab[c] for c in cols}, dummy_na)
    keep = [F.col(q(c)) for c in df.columns if c not in set(cols)]
    dummies = [dummy_expr(src, v).alias(name) for src, name, v in specs]
    return df.select(*keep, *dummies), [name for _, name, _ in specs]


def label_encode(train: DataFrame, test: DataFrame | None = None, max_distinct: int = 2,
                 exclude=(), vocab_nulls: tuple[dict, dict] | None = None) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """PRJ9: string columns with <= ``max_distinct`` values (NULL counted as a
    value) get the code = rank in sorted order; the same codes go on ``test``.

    A test value unseen in train raises, like the reference encoder.
    """
    cols = string_columns(train, exclude)
    vocab, nulls = vocab_nulls if vocab_nulls is not None else vocabulary_and_nulls(train, cols)
    chosen = [c for c in cols if len(vocab[c]) + (1 if nulls[c] else 0) <= max_distinct]

    def apply(df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in chosen:
                # sorted order of the encoder: values ascending, NULL sorts last
                e = F.when(F.col(q(c)).isNull(), F.lit(len(vocab[c]) if nulls[c] else None))
                for code, v in enumerate(vocab[c]):
                    e = e.when(F.col(q(c)) == F.lit(v), F.lit(code))
                out.append(e.cast("int").alias(c))
            else:
                out.append(F.col(q(c)))
        return df.select(*out)

    if test is not None and chosen:
        unseen_cond = None
        for c in chosen:
            ok = F.col(q(c)).isin(*vocab[c]) if vocab[c] else F.lit(False)
            if nulls[c]:
                ok = ok | F.col(q(c)).isNull()
            else:
                ok = ok & F.col(q(c)).isNotNull()
            cond = ~ok
            unseen_cond = cond if unseen_cond is None else (unseen_cond | cond)
        bad = test.filter(unseen_cond).select(*[q(c) for c in chosen]).limit(5).collect()
        if bad:
            raise ValueError(f"test table holds labels unseen in train: {[r.asDict() for r in bad]}")
    return apply(train), (apply(test) if test is not None else None), chosen


def align_columns(train: DataFrame, test: DataFrame, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """PRJ12: keep the columns common to both (train order), then put the label back on train."""
    common = [c for c in train.columns if c in set(test.columns) and c != label]
    tr_cols = common + ([label] if label and label in train.columns else [])
    return train.select(*[q(c) for c in tr_cols]), test.select(*[q(c) for c in common])


def column_difference(spark, left: DataFrame, right: DataFrame) -> DataFrame:
    """PRJ13: columns only in left / only in right, as a 2-column table."""
    a, b = set(left.columns), set(right.columns)
    rows = [("left_only", c) for c in sorted(a - b)] + [("right_only", c) for c in sorted(b - a)]
    schema = "side string, column string"
    return spark.createDataFrame(rows, schema)


def reindex_union(ref: DataFrame, prod: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """PRJ14: both tables on the sorted union of columns, absent -> NULL.

    Types of a column present on one side only are kept; when both sides have
    it with different types the common type is text.
    """
    cols = sorted(set(ref.columns) | set(prod.columns))
    rt = dict((f.name, f.dataType) for f in ref.schema.fields)
    pt = dict((f.name, f.dataType) for f in prod.schema.fields)

    def side(df, own, other):
        out = []
        for c in cols:
            t = own.get(c) or other.get(c)
            if c in own and c in other and own[c] != other[c]:
                t = T.StringType()
            out.append((F.col(q(c)) if c in own else F.lit(None)).cast(t).alias(c))
        return df.select(*out)

    return side(ref, rt, pt), side(prod, pt, rt), cols
