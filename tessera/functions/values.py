"""Cell-level expressions: missing tokens, invalid patterns, strict numeric parsing,
target binarisation, deterministic hashing.  All JVM-side (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's rules) -------------------------------
# Default missing-value tokens, compared after trim and lower-casing.
DEFAULT_MISSING_TOKENS = (
    "", " ", "na", "n/a", "nan", "none", "null", "?", "unknown", "missing",
    "not available", "invalid", "bad", "--",
)
# Notebook variant: whole-cell pattern, case-insensitive, tested on trimmed text.
INVALID_PATTERN = r"^\s*$|^(nan|none|null|n/a|invalid|\?|unknown|error|missing|-)$"
# -----------------------------------------------------------------------------------

# Plain decimal / scientific notation.  Deliberately excludes 'inf', 'nan', '1d',
# '1_000', hex: both Spark and DuckDB accept some of those and disagree.
NUMERIC_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_tokens(extra=()) -> list[str]:
    return sorted({t.strip().lower() for t in DEFAULT_MISSING_TOKENS} |
                  {t.strip().lower() for t in extra})


# every character str.strip() removes (Spark's trim only removes ' ')
_WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def trim_ws(c) -> Column:
    """Strip leading/trailing whitespace like Python's str.strip (no regex)."""
    return F.btrim(_c(c), F.lit(_WHITESPACE))


def null_if_token(c, tokens=None) -> Column:
    """NULL when lower(value) is a missing token or the value is empty."""
    c = _c(c)
    toks = tokens if tokens is not None else missing_tokens()
    return F.when(F.lower(c).isin(list(toks)) | (c == ""), F.lit(None).cast("string")).otherwise(c)


def null_if_invalid(c, pattern: str = INVALID_PATTERN) -> Column:
    """NULL when the trimmed value matches the invalid pattern (case-insensitive)."""
    t = trim_ws(c)
    return F.when(t.rlike("(?i)" + pattern), F.lit(None).cast("string")).otherwise(t)


def strict_double(c, trimmed: bool = False) -> Column:
    """String -> double only for plain numeric text, else NULL (never raises)."""
    t = _c(c) if trimmed else trim_ws(c)
    return F.when(t.rlike(NUMERIC_PATTERN), t.try_cast("double"))


def to_double(c, dtype: str) -> Column:
    """Numeric coercion by source type: strings parsed strictly, numbers cast."""
    if dtype == "string":
        return strict_double(c)
    if dtype == "boolean":
        return _c(c).cast("int").cast("double")
    return _c(c).cast("double")


def binarize(c, threshold: float = 0.0, dtype: str = "double") -> Column:
    """1 when numeric(value) > threshold, NULL/unparsable counted as 0."""
    v = to_double(c, dtype)
    return F.when(F.coalesce(v, F.lit(0.0)) > F.lit(float(threshold)), F.lit(1)).otherwise(F.lit(0))


def uniform01(key: Column, seed: int | str, salt: str = "") -> Column:
    """Deterministic U[0,1) from md5(key:salt:seed) (same value in DuckDB)."""
    parts = [key.cast("string")] + ([F.lit(salt)] if salt else []) + [F.lit(str(seed))]
    h = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def md5_key(key: Column, seed: int | str) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def to_datetime(c, formats=("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")) -> Column:
    """Parse text to a timestamp trying each format; unparsable -> NULL (never raises)."""
    c = _c(c)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])
