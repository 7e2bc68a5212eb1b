"""Daily external data: union of dates, per-day counts, capacity carried between months, day joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions import calendar
from plantlens.functions.domain import HIGH_IMPACT
from plantlens.operators import blocks


def date_spine(frames: Sequence[DataFrame], date: str = "date") -> DataFrame:
    """Distinct dates of all sources."""
    return reduce(lambda a, b: a.unionByName(b), [f.select(F.to_date(date).alias(date)) for f in frames]).distinct()


def policy_counts(policy: DataFrame, date: str = "date") -> DataFrame:
    return policy.groupBy(F.to_date(date).alias(date)).agg(F.count("*").alias("policy_count"))


def event_counts(events: DataFrame, date: str = "date", impact: str = "impact_level", high: str = HIGH_IMPACT) -> DataFrame:
    return events.groupBy(F.to_date(date).alias(date)).agg(
        F.count("*").alias("event_count"), F.count_if(F.col(impact) == high).alias("high_impact_event_count")
    )


def city_weather(weather: DataFrame, cities: Sequence[str], metrics: Sequence[str], date: str = "date") -> DataFrame:
    """One row per day with ``{city}_{metric}`` columns."""
    return weather.groupBy(F.to_date(date).alias(date)).agg(*[
        F.max(F.when(F.col("city") == c, F.col(m))).alias(f"{c}_{m}") for c in cities for m in metrics
    ])


def carry_capacity(spine: DataFrame, capacity: DataFrame, provinces: Sequence[str], date: str = "date",
                   value: str = "total_renewable") -> DataFrame:
    """Monthly capacity joined to the days and carried forward until the next figure."""
    names = [f"{p}_renewable_capacity" for p in provinces]
    monthly = capacity.groupBy(F.to_date(date).alias(date)).agg(*[
        F.max(F.when(F.col("province") == p, F.col(value))).alias(n) for p, n in zip(provinces, names)
    ])
    joined = spine.join(monthly, date, "left").withColumn(blocks.POS, F.unix_date(date).cast("long"))
    return blocks.nearest(joined, [], forward={n: F.col(n) for n in names}).drop(blocks.POS)


def merge_by_date(
    weather: DataFrame, policy: DataFrame, events: DataFrame, capacity: DataFrame, *, cities: Sequence[str],
    metrics: Sequence[str] = ("temperature", "humidity", "wind_speed"), provinces: Sequence[str], date: str = "date",
    high: str = HIGH_IMPACT,
) -> DataFrame:
    """Everything known about a day, on the union of all days, with calendar columns."""
    spine = date_spine([weather, policy, events, capacity], date)
    merged = (
        carry_capacity(spine, capacity, provinces, date)
        .join(city_weather(weather, cities, metrics, date), date, "left")
        .join(policy_counts(policy, date), date, "left")
        .join(event_counts(events, date, high=high), date, "left")
        .fillna(0, ["policy_count", "event_count", "high_impact_event_count"])
        .withColumn("policy_impact", (F.col("policy_count") > 0).cast("int"))
    )
    return calendar.add(merged, date, "D")


def join_daily(df: DataFrame, ext: DataFrame, *, ts: str, date: str = "date") -> DataFrame:
    """Left join a series to daily rows on the calendar day; duplicate external days fan out."""
    day = ext.withColumn("_day", F.to_date(date)).drop(date)
    return blocks.attach(df.withColumn("_day", F.to_date(ts)), day, ["_day"]).drop("_day")
