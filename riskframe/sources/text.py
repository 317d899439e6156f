"""CSV text as rows (SRC1-SRC3): lines are parsed inside the plan.

``lines`` is a frame of ``line_no`` (the line's number, different for every line) and
``line``; a value does not span lines.  Types come from a given schema or from the
data: one aggregate over all lines asks, for every column, whether each value reads
as a whole number, a number, a timestamp.  Every line is then either a row or
malformed, with a reason; nothing is dropped silently.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.expr import q
from riskframe.sources.tables import InputFileError, clean_numeric

#: How values are read, the narrowest type first; text that is none of them stays text.
_TYPES = (("long", T.LongType()), ("double", T.DoubleType()), ("timestamp_ntz", T.TimestampNTZType()))
_CORRUPT = "__corrupt"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files under ``path`` without their headers (each file's first line), numbered; unreadable paths are refused."""
    if not str(path).lower().endswith(".csv"):
        raise InputFileError(f"expected a .csv file, got {path!r}")
    try:
        header = spark.read.text(path).first()
        rows = spark.read.text(path)
    except Exception as exc:  # unreadable file
        raise InputFileError(f"cannot read CSV {path!r}: {exc}") from exc
    if header is None:
        raise InputFileError(f"CSV {path!r} has no rows")
    return rows.where(F.col("value") != header["value"]).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def render_lines(df: DataFrame, line_no: str, columns: list[str]) -> DataFrame:
    """SRC1's inverse: each row as a CSV line (nulls as nothing, empty text as \"\")."""
    return df.select(F.col(q(line_no)).cast("long").alias("line_no"), F.to_csv(F.struct(*[F.col(q(c)) for c in columns]), {
        "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]"}).alias("line"))


@dataclass
class CsvRows:
    """``rows``: ``line_no`` and the columns; ``malformed``: ``line_no``, ``line`` and the reason (``field_count`` or ``invalid_value``)."""

    rows: DataFrame
    malformed: DataFrame
    schema: T.StructType

    def refuse_malformed(self) -> DataFrame:
        """The rows, or an error that names the first malformed line."""
        first = self.malformed.orderBy("line_no").first()
        if first is not None:
            raise InputFileError(f"line {first['line_no']}: {first['reason']}: {first['line']!r}")
        return self.rows


def _fields(lines: DataFrame, schema: T.StructType) -> DataFrame:
    wide = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = F.from_csv("line", F.lit(", ".join(f"{q(f.name)} {f.dataType.simpleString()}" for f in wide.fields)),
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    return lines.withColumn("__v", parsed)


def infer_schema(lines: DataFrame, columns: list[str]) -> T.StructType:
    """The narrowest type that reads every value of a column, over all well-formed lines; a column without values is text."""
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    values = _fields(lines, text).where(F.col(f"__v.{_CORRUPT}").isNull())
    reads = [F.min(F.when(F.col(f"__v.{q(c)}").isNotNull(), F.col(f"__v.{q(c)}").try_cast(t).isNotNull())).alias(f"r{i}_{k}")
             for i, c in enumerate(columns) for k, (_, t) in enumerate(_TYPES)]
    found = values.agg(*reads).first()
    kind = lambda i: next((t for k, (_, t) in enumerate(_TYPES) if found[f"r{i}_{k}"]), T.StringType())
    return T.StructType([T.StructField(c, kind(i)) for i, c in enumerate(columns)])


def read_csv_lines(lines: DataFrame, columns: list[str], schema: T.StructType | None = None) -> CsvRows:
    """SRC1 (types inferred or given) and SRC3 (a schema of text): rows and malformed lines; NaN and infinities become NULL."""
    schema = schema or infer_schema(lines, columns)
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    counted = _fields(lines, text).select("line_no", "line", F.col(f"__v.{_CORRUPT}").isNotNull().alias("__count"))
    parsed = _fields(counted, schema)
    wrong = F.when(F.col("__count"), "field_count").when(F.col(f"__v.{_CORRUPT}").isNotNull(), "invalid_value")
    parsed = parsed.withColumn("reason", wrong)
    rows = parsed.where("reason IS NULL").select("line_no", *[F.col(f"__v.{q(c)}").alias(c) for c in columns])
    return CsvRows(clean_numeric(rows), parsed.where("reason IS NOT NULL").select("line_no", "line", "reason"), schema)


def scoring_lines(lines: DataFrame, columns: list[str]) -> CsvRows:
    """SRC3: compact scoring rows, every value as text; no lines at all are refused."""
    if lines.isEmpty():
        raise InputFileError("the CSV has no rows")
    return read_csv_lines(lines, columns, T.StructType([T.StructField(c, T.StringType()) for c in columns]))
