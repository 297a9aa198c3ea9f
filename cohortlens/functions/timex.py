"""Date/time expressions (p_floor_days, p_abs_duration, p_date_literal)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["floor_days", "abs_duration_hours", "ts_literal", "MICROS_PER_DAY"]

MICROS_PER_DAY = 86_400_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _micros(x) -> Column:
    return F.unix_micros(_c(x).cast("timestamp"))


def floor_days(a, b) -> Column:
    """(a - b) in whole days, floored like pandas ``.dt.days`` (not datediff):
    +2 h over midnight -> 0, -2 h -> -1, exactly 24 h -> 1."""
    return F.floor((_micros(a) - _micros(b)) / float(MICROS_PER_DAY)).cast("bigint")


def abs_duration_hours(a, b) -> Column:
    """|a - b| in hours (double)."""
    return F.abs(_micros(a) - _micros(b)) / 3.6e9


def ts_literal(s: str) -> Column:
    """p_date_literal: a wall-clock timestamp literal (no time zone)."""
    return F.lit(s).cast("timestamp_ntz")
