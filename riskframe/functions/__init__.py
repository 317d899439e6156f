"""Column-expression helpers (all JVM-side, no Python row functions)."""

from riskframe.functions.expr import (  # noqa: F401
    NUMERIC_TEXT_PATTERN,
    binary_token,
    clean_double,
    is_missing_value,
    json_safe_double,
    lenient_number,
    norm_category,
    null_safe_eq,
    parse_numeric_text,
    q,
    safe_div,
)
