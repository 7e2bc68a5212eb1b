"""Descriptive statistics: per-period summaries, correlations, box and histogram numbers."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.operators import blocks, quantiles


def skew(col: str) -> Column:
    """Bias-corrected skewness; 0 for a constant group, null below three values."""
    n = F.count(col).cast("double")
    g = F.skewness(col) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, None).when(F.min(col) == F.max(col), 0.0).otherwise(g)


def kurt(col: str) -> Column:
    """Bias-corrected excess kurtosis; 0 for a constant group, null below four values."""
    n = F.count(col).cast("double")
    g = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col) + 6)
    return F.when(n < 4, None).when(F.min(col) == F.max(col), 0.0).otherwise(g)


def period_key(ts: str, period: str, merge_years: bool = False) -> dict[str, Column]:
    """Grouping columns of a day, ISO week or month; ``merge_years`` drops the year."""
    t = F.col(ts)
    if period == "day":
        return {"day": F.to_date(t)}
    if period == "week":
        year = F.extract(F.lit("YEAROFWEEK"), t)
        key = {"week": F.weekofyear(t)}
    elif period == "month":
        year, key = F.year(t), {"month": F.month(t)}
    else:
        raise ValueError(f"unknown period {period!r}")
    return key if merge_years else {"year": year, **key}


def by_period(
    df: DataFrame, *, keys: Sequence[str], ts: str, cols: Sequence[str], period: str = "day", merge_years: bool = False
) -> DataFrame:
    """Eleven statistics per column and period, one aggregation.

    Built-in exact percentiles hold a group's distinct values; a gridded series has at most one row per
    entity and grid step, so a period's group is bounded by the calendar. ``merge_years`` groups are not,
    and take the quantiles from the bracketed operator instead.
    """
    group = period_key(ts, period, merge_years)
    aggs: list[Column] = []
    for c in cols:
        aggs += [
            F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"), (F.max(c) - F.min(c)).alias(f"{c}_range"), skew(c).alias(f"{c}_skew"),
            kurt(c).alias(f"{c}_kurt"),
        ]
        if not merge_years:
            aggs.append(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q_{c}"))
    keyed = df.withColumns(group)
    names = [*keys, *group]
    out = keyed.groupBy(*names).agg(*aggs)
    if merge_years:
        q = quantiles.exact_wide(keyed, names, cols, {"q25": 0.25, "median": 0.5, "q75": 0.75})
        out = out.join(q, names, "left")
        parts = {c: (F.col(f"{c}_q25"), F.col(f"{c}_median"), F.col(f"{c}_q75")) for c in cols}
    else:
        parts = {c: tuple(F.col(f"_q_{c}")[i] for i in range(3)) for c in cols}
    final = [F.col(n) for n in names]
    for c in cols:
        lo, mid, hi = parts[c]
        final += [F.col(f"{c}_{s}") for s in ("mean", "std", "min", "max", "range")]
        final += [mid.alias(f"{c}_median"), F.col(f"{c}_skew"), F.col(f"{c}_kurt"), lo.alias(f"{c}_q25"),
                  hi.alias(f"{c}_q75"), (hi - lo).alias(f"{c}_iqr")]
    return out.select(*final)


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form (c1, c2, r), pairwise complete, every pair in one aggregation."""
    pairs = list(combinations(cols, 2))
    row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(f"r{i}").alias("r"))
             for i, pair in enumerate(pairs) for a, b in (pair, pair[::-1])]
    cells += [F.struct(F.lit(c).alias("c1"), F.lit(c).alias("c2"), F.lit(1.0).alias("r")) for c in cols]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def box_summary(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (furthest values inside the fences) and outlier count per column."""
    keys = list(keys)
    q = quantiles.exact(df, keys, cols, [0.25, 0.5, 0.75]).groupBy(*keys, "col").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    ).withColumns({"_lo": F.expr("q1 - 1.5 * (q3 - q1)"), "_hi": F.expr("q3 + 1.5 * (q3 - q1)")})
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")
    ).select(*keys, "x.*").filter(F.col("v").isNotNull())
    inside = F.col("v").between(F.col("_lo"), F.col("_hi"))
    return (
        blocks.attach(long, q, [*keys, "col"])
        .groupBy(*keys, "col", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def histogram(df: DataFrame, col: str, bins: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between the group's minimum and maximum; the last bin is closed on both sides."""
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(col).cast("double").alias("_a"), F.max(col).cast("double").alias("_b"))
    wide = blocks.attach(df.filter(F.col(col).isNotNull()), span, keys)
    width = (F.col("_b") - F.col("_a")) / F.lit(bins)
    index = F.when(F.col("_b") == F.col("_a"), 0).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col(col) - F.col("_a")) / width)).cast("int")
    )
    return (
        wide.groupBy(*keys, "_a", "_b", index.alias("bin")).agg(F.count("*").alias("n"))
        .select(*keys, "bin", (F.col("_a") + width * F.col("bin")).alias("low"), (F.col("_a") + width * (F.col("bin") + 1)).alias("high"), "n")
    )
