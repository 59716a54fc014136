"""Scalar column expressions (all JVM-side, codegen friendly; no Python UDFs)."""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Mapping

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# arithmetic
# --------------------------------------------------------------------------

def safe_div(a, b) -> Column:
    """NULL when the denominator is zero or NULL (never raises under ANSI)."""
    return F.try_divide(col(a), col(b))


def strict_div(a, b) -> Column:
    """Unguarded ratio: under ANSI mode a zero denominator raises DIVIDE_BY_ZERO."""
    return col(a) / col(b)


def pct(a, b) -> Column:
    """Relative change (a - b) / b as a fraction; NULL when b is NULL or 0."""
    return F.try_divide(col(a) - col(b), col(b))


def weighted_avg(v, w) -> Column:
    """Aggregate: sum(v * w) / sum(w), NULL on a zero or NULL weight total."""
    return F.try_divide(F.sum(col(v) * col(w)), F.sum(col(w)))


def clip(c, lo=None, hi=None) -> Column:
    out = col(c)
    if lo is not None:
        out = F.greatest(out, col(lo) if not isinstance(lo, (int, float)) else F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, col(hi) if not isinstance(hi, (int, float)) else F.lit(float(hi)))
    return out


def row_sum(cols: Iterable) -> Column:
    """Row-wise sum of several columns (NULL members count as 0, like pandas)."""
    return reduce(lambda a, b: a + b, [F.coalesce(col(c), F.lit(0)) for c in cols])


def round_half_up(c, n: int = 0) -> Column:
    """Spark's round is half-up (Python's builtin is half-even)."""
    return F.round(col(c), n)


def to_double(c, strict: bool = False) -> Column:
    """Cast text to double; ``try_cast`` (NULL on bad text) unless ``strict``."""
    return col(c).cast("double") if strict else col(c).try_cast("double")


# --------------------------------------------------------------------------
# dates
# --------------------------------------------------------------------------

def day(c) -> Column:
    return F.to_date(col(c))


def month_start(c) -> Column:
    return F.trunc(F.to_date(col(c)), "month")


def month_range(start: str, end: str, step_months: int = 1) -> Column:
    """Array of month-start dates from ``start`` to ``end`` inclusive."""
    return F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr(f"INTERVAL {step_months} MONTH"))


# --------------------------------------------------------------------------
# text / JSON / hashing
# --------------------------------------------------------------------------

def scalar_json(c, path: str) -> Column:
    """Scalar at a JSON path; NULL when the value there is an object or array."""
    v = F.get_json_object(col(c), path)
    return F.when(v.startswith("{") | v.startswith("["), F.lit(None).cast("string")).otherwise(v)


def hash_id(c) -> Column:
    """Hex SHA-256 of the text form of the id (anonymous join key)."""
    return F.sha2(col(c).cast("string"), 256)


def like_any(c, patterns: Iterable[str], negate: bool = False) -> Column:
    pats = list(patterns)
    pred = reduce(lambda a, b: a | b, [col(c).like(p) for p in pats])
    return ~pred if negate else pred


def ilike_pattern(c, pattern: str) -> Column:
    return F.lower(col(c)).like(pattern.lower())


def clean_key(c) -> Column:
    """Join key for mission/grant names: drop (...) groups, drop 'grant' prefixes
    (case-sensitive, before lower-casing), squeeze whitespace, trim, lower."""
    s = col(c).cast("string")
    s = F.regexp_replace(s, r"\(.*?\)", "")
    s = F.regexp_replace(s, r"grant[:\- ]*", "")
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    return F.lower(F.trim(s))


# Fixed patterns for community-message cleaning, applied in this order:
# mentions, URLs, markdown marks, custom emoji, astral-plane characters, whitespace.
MENTION_RE = r"<@!?[0-9]+>"
URL_RE = r"http\S+|www\.\S+"
MARKDOWN_RE = r"[*_~`]"
CUSTOM_EMOJI_RE = r"<:[a-zA-Z0-9_]+:[0-9]+>"
ASTRAL_RE = r"[\x{10000}-\x{10FFFF}]"


def clean_message(c) -> Column:
    s = col(c)
    s = F.regexp_replace(s, MENTION_RE, "")
    s = F.regexp_replace(s, "(?U)" + URL_RE, "")
    s = F.regexp_replace(s, MARKDOWN_RE, "")
    s = F.regexp_replace(s, CUSTOM_EMOJI_RE, "")
    s = F.regexp_replace(s, ASTRAL_RE, "")
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def first_chars(c, n: int = 4000) -> Column:
    return F.substring(col(c), 1, n)


# --------------------------------------------------------------------------
# formatting
# --------------------------------------------------------------------------

def fmt_money(c, scale: float = 1e6, suffix: str = "M", decimals: int = 1) -> Column:
    """``$1.2M`` style."""
    return F.format_string(f"$%.{decimals}f{suffix}", col(c) / F.lit(scale))


def fmt_pct(c, decimals: int = 1, signed: bool = False) -> Column:
    """``12.3%`` from a fraction."""
    sign = "+" if signed else ""
    return F.format_string(f"%{sign}.{decimals}f%%", col(c) * F.lit(100.0))


def fmt_int(c) -> Column:
    """``1,234`` thousands separators, no decimals."""
    return F.format_number(col(c), 0)


def compact_json(c) -> Column:
    """Compact JSON of a struct/array; NaN becomes null and null fields are kept."""
    return F.to_json(col(c), {"ignoreNullFields": "false"})


def label(code_col, mapping: Mapping, default) -> Column:
    """Map codes to names (``cluster_name``); unmatched -> default."""
    out = None
    for k, v in mapping.items():
        cond = col(code_col) == F.lit(k)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out.otherwise(F.lit(default))
