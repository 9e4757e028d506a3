"""Column-expression helpers (all JVM-side built-ins, no UDF)."""

from tabrisk.functions.expressions import (  # noqa: F401
    as_text,
    clip_prob,
    fmt_decimals,
    is_blank,
    nan_to_null,
    normalize_nans,
    parse_number,
    range_text,
    sigmoid,
    stable_hash,
    trunc_int,
)
