"""Environment and load expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def discomfort_index(temp: Column, humidity: Column) -> Column:
    return F.lit(0.81) * temp + F.lit(0.01) * humidity * (F.lit(0.99) * temp - F.lit(14.3)) + F.lit(46.3)


def wind_chill(temp: Column, wind: Column) -> Column:
    v = F.pow(wind, F.lit(0.16))
    return F.lit(13.12) + F.lit(0.6215) * temp - F.lit(11.37) * v + F.lit(0.3965) * temp * v
