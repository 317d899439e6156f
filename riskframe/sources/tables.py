"""Table sources (SRC1-SRC3, SRC5).

All readers return lazy DataFrames; nothing is collected.  Numeric columns are
cleaned so that NaN and +-Inf become NULL (the only missing marker used by the
library).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.expr import clean_double, parse_numeric_text, q

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Parquet table ``{base_dir}/{name}.parquet``."""
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


def clean_numeric(df: DataFrame) -> DataFrame:
    """Map NaN / +-Inf to NULL in every float/double column (other columns untouched)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(clean_double(F.col(q(f.name))).cast(f.dataType).alias(f.name))
        else:
            out.append(F.col(q(f.name)))
    return df.select(*out)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   infer: bool = True) -> DataFrame:
    """SRC1: CSV with a header.  An explicit schema is the cluster path
    (inference costs one extra pass over the data); ``infer`` mirrors the
    reference's inferred types on small files."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True)
    return clean_numeric(reader.csv(path))


def limit_rows(df: DataFrame, row_limit: int | None) -> DataFrame:
    """SRC2: optional row-limited scan (the limit is pushed to the reader)."""
    return df if row_limit is None else df.limit(int(row_limit))


class InputFileError(ValueError):
    """Unreadable, empty or non-CSV scoring input."""


def read_scoring_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: compact scoring rows from CSV, every column as text.

    Rejects a path that is not ``.csv`` and a file without data rows.  The
    check runs a ``LIMIT 1`` job only, not a full count.
    """
    if not str(path).lower().endswith(".csv"):
        raise InputFileError(f"expected a .csv file, got {path!r}")
    try:
        df = spark.read.option("header", True).option("inferSchema", False).csv(path)
        empty = df.isEmpty()
    except Exception as exc:  # unreadable file
        raise InputFileError(f"cannot read CSV {path!r}: {exc}") from exc
    if empty or not df.columns:
        raise InputFileError(f"CSV {path!r} has no rows")
    return df


def compact_rows_from_columns(df: DataFrame, key_cols: list[str], row_id: str | None = None) -> DataFrame:
    """Turn a wide all-text batch into ``(row_index, features map<string,string>)``.

    Empty cells become NULL map values, as a CSV reader would give NaN.
    """
    feats = [c for c in df.columns if c not in key_cols and c != row_id]
    pairs = []
    for c in feats:
        pairs += [F.lit(c), F.col(q(c)).cast("string")]
    out = df.select(*([F.col(q(row_id)).alias("row_index")] if row_id else []),
                    *[F.col(q(k)) for k in key_cols],
                    F.create_map(*pairs).alias("features"))
    return out


def compact_rows_from_json(df: DataFrame, json_col: str, id_col: str | None = None) -> DataFrame:
    """JSON objects -> ``(row_index, features map<string,string>)``.

    Values are parsed as VARIANT and rendered as text, so a JSON number keeps
    its numeric form (``1.0`` -> ``"1"``) while a JSON string keeps its text
    (``"1.0"``): a binary field then accepts the number 1.0 and rejects the
    string "1.0", as the reference's parser does.  Malformed text or JSON that
    is not an object gives a NULL map (rejected as ``invalid_input``)."""
    m = F.from_json(F.col(q(json_col)), "map<string,variant>")
    feats = F.transform_values(m, lambda k, v: F.variant_get(v, "$", "string"))
    return df.select(*([F.col(q(id_col)).alias("row_index")] if id_col else []), feats.alias("features"))


def read_importances(df: DataFrame) -> DataFrame:
    """SRC5: (feature, importance) with unparseable importance -> 0.

    Raises when either column is absent.
    """
    missing = {"feature", "importance"} - set(df.columns)
    if missing:
        raise ValueError(f"importance table needs columns feature, importance; missing {sorted(missing)}")
    imp = F.coalesce(clean_double(parse_numeric_text(F.col("importance").cast("string"))), F.lit(0.0))
    return df.select(F.col("feature").cast("string").alias("feature"), imp.alias("importance"))


def read_importances_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_importances(spark.read.option("header", True).csv(path))
