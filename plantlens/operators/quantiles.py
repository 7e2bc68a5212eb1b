"""Exact order statistics for groups of any size.

Built-in exact percentiles hold every distinct value of a group in one task. Here a sketch brackets each
wanted rank, one aggregation counts everything below the bracket and the values inside it, and only those
few values are ranked. Groups whose rows are bounded (a day of hourly rows) use the built-in instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.operators.blocks import attach

SMALL_GROUP, LARGE_GROUP = 2_000, 200_000
WIDE, NARROW, ACCURACY = 2e-3, 1e-4, 50_000


def _edges(p: float) -> list[float]:
    return [max(0.0, p - WIDE), max(0.0, p - NARROW), min(1.0, p + NARROW), min(1.0, p + WIDE)]


def exact(df: DataFrame, keys: Sequence[str], cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles in long form: keys, ``col``, ``p``, ``value``."""
    keys = list(keys)
    long = df.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x"),
    ).select(*keys, "x.col", "x.v").filter(F.col("v").isNotNull() & ~F.isnan("v"))
    group = [*keys, "col"]
    marks = [e for p in probs for e in _edges(p)]
    sketch = long.groupBy(*group).agg(
        F.count("*").alias("_n"), F.percentile_approx("v", marks, ACCURACY).alias("_m")
    )
    wants = []
    for i, p in enumerate(probs):
        def at(j: int, i=i):
            return F.element_at("_m", 4 * i + j + 1)

        big = F.col("_n") > LARGE_GROUP
        open_low = (F.col("_n") <= SMALL_GROUP) | F.lit(p - WIDE <= 0)
        open_high = (F.col("_n") <= SMALL_GROUP) | F.lit(p + WIDE >= 1)
        wants.append(F.struct(
            F.lit(float(p)).alias("p"),
            F.when(open_low, F.lit(float("-inf"))).when(big, at(1)).otherwise(at(0)).alias("lo"),
            F.when(open_high, F.lit(float("inf"))).when(big, at(2)).otherwise(at(3)).alias("hi"),
        ))
    brackets = sketch.select(*group, "_n", F.array(*wants).alias("_want"))
    side = brackets if keys else F.broadcast(brackets)  # without keys a row for each column; a shuffle would put a column into one task
    inside = (
        attach(long, side, group)
        .select(*group, "_n", "v", F.explode("_want").alias("w"))
        .filter(F.col("v") <= F.col("w.hi"))
        .select(*group, "_n", F.col("w.p").alias("p"), F.when(F.col("v") >= F.col("w.lo"), F.col("v")).alias("v"))
        .groupBy(*group, "_n", "p", "v").agg(F.count("*").alias("_c"))
    )
    w = Window.partitionBy(*group, "p").orderBy(F.col("v").asc_nulls_first())
    upto = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rank = F.col("p") * (F.col("_n") - 1)
    low = F.floor(rank)
    high = F.least(low + 1, F.col("_n") - 1)

    def value_at(k):
        return F.max(F.when((F.col("_to") - F.col("_c") <= k) & (k < F.col("_to")), F.col("v")))

    found = (
        inside.withColumn("_to", upto)
        .groupBy(*group, "p", "_n")
        .agg(value_at(low).alias("_a"), value_at(high).alias("_b"))
    )
    missed = F.col("_a").isNull() | F.col("_b").isNull()
    frac = rank - low
    return found.select(
        *group, "p",
        F.when(missed, F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"))
        .otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * frac).alias("value"),
    )


def exact_wide(df: DataFrame, keys: Sequence[str], cols: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """One row per group with columns ``{col}_{name}``."""
    keys = list(keys)
    long = exact(df, keys, cols, list(probs.values()))
    return long.groupBy(*keys).agg(*[
        F.max(F.when((F.col("col") == c) & (F.col("p") == float(p)), F.col("value"))).alias(f"{c}_{n}")
        for c in cols for n, p in probs.items()
    ])


def mode_value(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Most frequent non-null value per group, the smallest on ties; counts combine before the shuffle."""
    keys = list(keys)
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("_c"))
    return counts.groupBy(*keys).agg(F.min_by(col, F.struct((-F.col("_c")).alias("c"), F.col(col).alias("v"))).alias(f"{col}_mode"))
