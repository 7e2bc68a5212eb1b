"""Calendar columns derived from a timestamp: four published column sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def season(month: Column) -> Column:
    """1 spring (Mar-May), 2 summer, 3 autumn, 4 winter."""
    return F.when(month.between(3, 5), 1).when(month.between(6, 8), 2).when(month.between(9, 11), 3).otherwise(4)


def _cycle(prefix: str, value: Column, period: Column | float) -> dict[str, Column]:
    turn = F.lit(2 * math.pi) * value / (period if isinstance(period, Column) else F.lit(float(period)))
    return {f"{prefix}_sin": F.sin(turn), f"{prefix}_cos": F.cos(turn)}


def columns(ts: str, variant: str) -> dict[str, Column]:
    """Name -> expression for one variant.

    A: cleaning set, day cycle over the real month length.  B: feature set with day of year and month edges.
    C: forecasting set, day cycle over 31 and ``dow`` names.  D: daily set used on merged external data.
    """
    t = F.col(ts)
    hour, day, month, dow = F.hour(t), F.dayofmonth(t), F.month(t), F.weekday(t)
    weekend = dow >= 5
    if variant == "A":
        return {
            "hour": hour, "day": day, "month": month, "year": F.year(t), "dayofweek": dow, "quarter": F.quarter(t),
            "is_weekend": weekend, "season": season(month),
            **_cycle("hour", hour, 24), **_cycle("day", day, F.dayofmonth(F.last_day(t))),
        }
    if variant == "B":
        return {
            "hour": hour, "dayofweek": dow, "month": month, "quarter": F.quarter(t), "year": F.year(t),
            "dayofyear": F.dayofyear(t), "is_month_start": day == 1, "is_month_end": F.to_date(t) == F.last_day(t),
            "is_weekend": weekend.cast("int"),
            **_cycle("hour", hour, 24), **_cycle("dayofweek", dow, 7), **_cycle("month", month, 12),
        }
    if variant == "C":
        return {
            "hour": hour, "day": day, "month": month, "day_of_week": dow, "is_weekend": weekend.cast("int"),
            **_cycle("hour", hour, 24), **_cycle("day", day, 31), **_cycle("month", month, 12),
            **_cycle("dow", dow, 7), "season": season(month),
        }
    if variant == "D":
        return {
            "year": F.year(t), "month": month, "day": day, "dayofweek": dow, "is_weekend": weekend,
            "season": season(month),
        }
    raise ValueError(f"unknown calendar variant {variant!r}")


def add(df: DataFrame, ts: str, variant: str = "B") -> DataFrame:
    """Append one calendar set; existing columns of the same name are replaced."""
    return df.withColumns(columns(ts, variant))
