"""Scalar expressions shared by the operators.

SQL NULL is the only missing marker inside the library: NaN and +-Inf are
turned to NULL at every source (``clean_double``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour -------------------
# Text tokens read as "missing" (after trim, any case).
MISSING_TOKENS = ("", "nan", "none", "null")
# Text tokens of a binary field.
TRUE_TOKENS = ("1", "true", "t", "yes", "y", "oui")
FALSE_TOKENS = ("0", "false", "f", "no", "n", "non")
# Plain decimal number with optional exponent (no "1.5d", no "true").
NUMERIC_TEXT_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# --------------------------------------------------------------------------


def q(name: str) -> str:
    """Back-tick quote a column name (names may hold spaces, commas, dots)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def clean_double(c: Column) -> Column:
    """double with NaN and +-Inf mapped to NULL."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(d)


json_safe_double = clean_double


def safe_div(a: Column, b: Column) -> Column:
    """a / b with NULL on a zero divisor (pandas would give +-inf/NaN)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def null_safe_eq(c: Column, value) -> Column:
    """Equality where NULL compares false (pandas ``==`` on NaN)."""
    return c.eqNullSafe(F.lit(value))


def is_missing_value(c: Column) -> Column:
    """True for NULL, NaN, or a text token among MISSING_TOKENS."""
    s = F.lower(F.trim(c.cast("string")))
    return c.isNull() | s.isin(*MISSING_TOKENS) | (s == F.lit("nan"))


def norm_category(c: Column) -> Column:
    """trim, collapse runs of white space, lower-case."""
    return F.lower(F.regexp_replace(F.trim(c.cast("string")), r"\s+", " "))


def parse_numeric_text(c: Column) -> Column:
    """Guarded text -> double: NULL unless the text is a plain decimal number."""
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(NUMERIC_TEXT_PATTERN), s.cast("double")).otherwise(F.lit(None).cast("double"))


def lenient_number(c: Column) -> Column:
    """Scoring-input number: missing -> NULL, decimal comma accepted.

    A non-missing value that does not parse also gives NULL; callers pair this
    with ``lenient_number_invalid`` to reject such rows.
    """
    s = F.replace(F.trim(c.cast("string")), F.lit(","), F.lit("."))
    parsed = F.when(s.rlike(NUMERIC_TEXT_PATTERN), s.cast("double"))
    return F.when(is_missing_value(c), F.lit(None).cast("double")).otherwise(parsed)


def lenient_number_invalid(c: Column) -> Column:
    return (~is_missing_value(c)) & lenient_number(c).isNull()


def binary_token(c: Column) -> Column:
    """0/1 field: tokens yes/no/oui/non/t/f/... ; NULL when missing or invalid."""
    s = F.lower(F.trim(c.cast("string")))
    return (
        F.when(is_missing_value(c), F.lit(None).cast("double"))
        .when(s.isin(*TRUE_TOKENS), F.lit(1.0))
        .when(s.isin(*FALSE_TOKENS), F.lit(0.0))
        .otherwise(F.lit(None).cast("double"))
    )


def binary_token_invalid(c: Column) -> Column:
    return (~is_missing_value(c)) & binary_token(c).isNull()
