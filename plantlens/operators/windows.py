"""Rolling, lag, fill and ranking operators over entity series."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plantlens.operators import blocks
from plantlens.operators.blocks import POS


@dataclass(frozen=True)
class Feature:
    """A named window column together with how far its frame reaches."""

    name: str
    build: Callable[[WindowSpec], Column]
    before: int = 0
    after: int = 0


def add(df: DataFrame, keys: Sequence[str], features: Sequence[Feature], pos: str = POS) -> DataFrame:
    """All features in one pass: one shuffle, one sort, one projection."""
    return blocks.over_blocks(
        df, keys, lambda w: [f.build(w).alias(f.name) for f in features],
        before=max((f.before for f in features), default=0), after=max((f.after for f in features), default=0), pos=pos,
    )


_AGG = {"mean": F.avg, "avg": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}


def rolling(col: str, stat: str, window: int, name: str, *, min_periods: int | None = None, shift: int = 0) -> Feature:
    """Rolling statistic of the ``window`` rows ending ``shift`` rows before the current one.

    Null unless the frame holds at least ``min_periods`` (default: ``window``) non-null values.
    """
    need = window if min_periods is None else min_periods

    def build(w: WindowSpec) -> Column:
        frame = w.rowsBetween(-(window - 1 + shift), -shift)
        return F.when(F.count(col).over(frame) >= need, _AGG[stat](col).over(frame))

    return Feature(name, build, before=window - 1 + shift)


def lag(col: str, periods: int, name: str) -> Feature:
    return Feature(name, lambda w: F.lag(col, periods).over(w), before=periods)


def lead(col: str, periods: int, name: str) -> Feature:
    return Feature(name, lambda w: F.lead(col, periods).over(w), after=periods)


def diff(col: str, periods: int, name: str) -> Feature:
    return Feature(name, lambda w: F.col(col) - F.lag(col, periods).over(w), before=periods)


def pct_change(col: str, periods: int, name: str) -> Feature:
    """col / lag - 1, null where the earlier value is zero; ``col`` is expected forward-filled."""
    return Feature(name, lambda w: F.try_divide(F.col(col), F.lag(col, periods).over(w)) - F.lit(1.0), before=periods)


def ewm_mean(col: str, alpha: float, name: str) -> Feature:
    """Exponentially weighted mean, weights normalised over the observed rows, nulls skipped but aged.

    Both sums are running sums of values scaled by the growth factor, so each row costs O(1). The halo is
    long enough that the dropped weight is below double precision.
    """
    keep = 1.0 - alpha
    halo = math.ceil(math.log(1e-17) / math.log(keep))
    if (blocks.BLOCK_ROWS + halo) * -math.log10(keep) > 290:
        raise ValueError("alpha too large for the block length: scaled sums would overflow")

    def build(w: WindowSpec) -> Column:
        frame = w.rowsBetween(Window.unboundedPreceding, 0)
        age = (F.col(blocks.REL) + halo).cast("double")
        weight = F.when(F.col(col).isNotNull(), F.pow(F.lit(1.0 / keep), age))
        return F.sum(weight * F.col(col)).over(frame) / F.sum(weight).over(frame)

    return Feature(name, build, before=halo)


def ffill(df: DataFrame, keys: Sequence[str], cols: Sequence[str], pos: str = POS) -> DataFrame:
    return blocks.nearest(df, keys, forward={c: F.col(c) for c in cols}, pos=pos).select(*df.columns)


def bfill(df: DataFrame, keys: Sequence[str], cols: Sequence[str], pos: str = POS) -> DataFrame:
    return blocks.nearest(df, keys, backward={c: F.col(c) for c in cols}, pos=pos).select(*df.columns)


def interpolate(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], pos: str = POS) -> DataFrame:
    """Time-weighted linear interpolation: leading gaps stay null, trailing gaps take the last value."""
    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(blocks.epoch(ts).alias("t"), F.col(c).alias("v")))

    out = blocks.nearest(
        df, keys, forward={f"_prev_{c}": known(c) for c in cols}, backward={f"_next_{c}": known(c) for c in cols}, pos=pos, order=ts,
    )

    def value(c: str) -> Column:
        p, n = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        share = (blocks.epoch(ts) - p["t"]) / (n["t"] - p["t"])
        return (
            F.when(F.col(c).isNotNull(), F.col(c)).when(p.isNull(), None)
            .when(n.isNull(), p["v"]).otherwise(p["v"] + (n["v"] - p["v"]) * share)
        )

    return out.select(*[value(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def gaps(df: DataFrame, keys: Sequence[str], ts: str, pos: str = POS) -> DataFrame:
    """Seconds to the previous row of the entity; null on its first row."""
    prev = blocks.nearest(df, keys, forward={"_prev": blocks.epoch(ts)}, pos=pos, inclusive=False, order=ts)
    return prev.withColumn("gap", blocks.epoch(ts) - F.col("_prev")).drop("_prev")


def gap_profile(df: DataFrame, keys: Sequence[str], ts: str, pos: str = POS) -> DataFrame:
    """Per entity: number of distinct gaps and the most common gap (shortest on ties)."""
    keys = list(keys)
    counts = gaps(df, keys, ts, pos).filter(F.col("gap").isNotNull()).groupBy(*keys, "gap").agg(F.count("*").alias("_c"))
    return counts.groupBy(*keys).agg(
        F.count("*").alias("distinct_gaps"),
        F.min_by("gap", F.struct((-F.col("_c")).alias("c"), F.col("gap").alias("g"))).alias("modal_gap"),
    )


def quartile_level(df: DataFrame, keys: Sequence[str], col: str, ts: str, name: str, quarters: int = 4) -> DataFrame:
    """Equal-count level 0..quarters-1 of ``col``, ties split by time, without ranking whole entities.

    Same levels as cutting first-come ranks into quantile bins; see ``value_rank`` for the distribution.
    """
    keys = list(keys)
    ranked = value_rank(df, keys, col, ts)
    n, r = F.col("_size"), F.col("_rank")
    level = F.when(n == 1, F.lit(0)).otherwise(
        F.greatest(F.lit(0), F.ceil(F.lit(quarters) * (r - 1) / (n - 1)).cast("int") - 1)
    )
    return ranked.select(*df.columns, F.when(F.col(col).isNotNull(), level).cast("int").alias(name))


RANK_SLICES = 64


def value_rank(df: DataFrame, keys: Sequence[str], col: str, ts: str) -> DataFrame:
    """Append ``_rank`` (1-based, by value then time, nulls last) and ``_size`` (non-null rows) per entity.

    Rows are sliced by sketch quantiles of the value and, inside a slice, by time block where the slice is a
    single repeated value; slice counts give each slice its starting rank.
    """
    keys = list(keys)
    cuts = [i / RANK_SLICES for i in range(1, RANK_SLICES)]
    sketch = df.groupBy(*keys).agg(
        F.percentile_approx(col, cuts, 10_000).alias("_cuts"), F.count(col).alias("_size")
    )
    sliced = blocks.attach(df, sketch.withColumn("_cuts", F.array_distinct("_cuts")), keys)
    below = F.size(F.filter("_cuts", lambda c: c < F.col(col)))
    tied = F.array_contains("_cuts", F.col(col))
    sliced = sliced.withColumns({
        "_slice": F.when(F.col(col).isNull(), F.lit(2 * RANK_SLICES)).otherwise(2 * below + F.when(tied, 1).otherwise(0)),
        "_sub": F.when(tied | F.col(col).isNull(), blocks.floor_div(blocks.epoch(ts), 3600 * blocks.BLOCK_ROWS)).otherwise(F.lit(0)),
    })
    part = [*keys, "_slice", "_sub"]
    counts = sliced.groupBy(*part).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_slice", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*part, F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_start"))
    rn = F.row_number().over(Window.partitionBy(*part).orderBy(col, ts))
    return (
        blocks.by_block(sliced, keys, "_slice", "_sub").withColumn("_rn", rn).join(starts, part, "left")
        .select(*df.columns, (F.col("_start") + F.col("_rn")).alias("_rank"), "_size")
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, tie: str | None = None) -> DataFrame:
    """The newest row per key; among equal stamps the row with the smallest ``tie``. One aggregation."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(ts).alias("t"), (-F.col(tie)).alias("k")) if tie else F.col(ts)
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; the rank filter lets Spark prune each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
