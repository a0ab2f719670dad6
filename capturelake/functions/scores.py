"""Numeric helpers, truthiness rules and typed coercions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def clamp(value: Column, low, high) -> Column:
    """NULL stays NULL, although greatest/least themselves skip NULLs."""
    return F.when(value.isNotNull(), F.greatest(as_col(low), F.least(as_col(high), value)))


def clamp01(value: Column) -> Column:
    return clamp(value, 0.0, 1.0)


def score_linear(value: Column, low: float, high: float) -> Column:
    if high <= low:
        return F.lit(0.0)
    return clamp01((value - low) / (high - low))


def peak_score(value: Column, target: float, spread: float) -> Column:
    """1 at the target, falling to 0 at a distance of ``spread``."""
    return clamp01(1.0 - F.abs(value - target) / spread)


def pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100.0, 3)).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))


def truthy(value: Column) -> Column:
    """NULL where a number is 0: zero counts as missing in the record chains."""
    return F.nullif(value, F.lit(0))


def first_truthy(*values: Column, default=0) -> Column:
    return F.coalesce(*[truthy(v) for v in values], as_col(default))


def first_text(*values: Column, default: str | None = None) -> Column:
    """First value that is not blank, trimmed."""
    picked = [F.nullif(F.trim(v), F.lit("")) for v in values]
    return F.coalesce(*picked, F.lit(default))


def group_key(value: Column) -> Column:
    """Trimmed key with case kept; blank becomes ``unknown``."""
    return first_text(value.cast("string"), default="unknown")


def lower_key(value: Column) -> Column:
    return first_text(F.lower(value.cast("string")), default="unknown")


def to_int(text: Column) -> Column:
    """Integer part of a numeric text, 0 when blank or malformed."""
    return F.coalesce(F.trim(text).try_cast("double").cast("bigint"), F.lit(0).cast("bigint"))


def to_float(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0))


def to_bool(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes", "si"), F.lit(False))


def finite(value: Column) -> Column:
    """NULL for NaN and the infinities."""
    bad = F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.when(~bad, value)


def reasons(*rules: tuple[Column, str | Column]) -> Column:
    """Array of the texts whose condition holds, in rule order, without repeats."""
    hits = [F.when(cond, as_col(text)) for cond, text in rules]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def parse_time(text: Column) -> Column:
    """ISO text to timestamp; epoch when it cannot be read."""
    epoch = F.timestamp_seconds(F.lit(0))
    return F.coalesce(F.try_to_timestamp(text), epoch)
