"""Cleaning: profiles, fills, three-sigma clipping, hourly gridding, scaling, key checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.operators import blocks, quantiles, windows
from plantlens.session import staged

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC) and f.name not in skip]


def string_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is the missing marker of file sources; aggregates only skip NULL."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols}) if cols else df


def tokens_to_null(df: DataFrame, token: str = "-") -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(token)) for c in string_columns(df)})


def missing_profile(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Missing count and percentage per column, in one pass, in long form."""
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"), *aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in cols]))
    return counts.select(*keys, "_n", rows.alias("x")).select(
        *keys, F.col("x.column"), F.col("x.missing"),
        F.when(F.col("_n") > 0, F.col("x.missing") / F.col("_n") * 100).otherwise(F.lit(0.0)).alias("missing_pct"),
    )


def sigma_bounds(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), sigma: float = 3.0) -> DataFrame:
    """``{c}_lo`` and ``{c}_hi``: mean -/+ sigma sample deviations (null for a single row)."""
    aggs = []
    for c in cols:
        known = F.nanvl(F.col(c).cast("double"), F.lit(None))
        m, s = F.avg(known), F.stddev_samp(known)
        aggs += [(m - sigma * s).alias(f"{c}_lo"), (m + sigma * s).alias(f"{c}_hi")]
    return df.groupBy(*keys).agg(*aggs)


def winsorise(value: Column, lo: Column, hi: Column) -> Column:
    """Clip to [lo, hi]; nulls and missing bounds pass through."""
    return F.when(value < lo, lo).when(value > hi, hi).otherwise(value)


def clip_sigma(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), sigma: float = 3.0) -> DataFrame:
    wide = blocks.attach(df, sigma_bounds(df, cols, keys, sigma), keys)
    return wide.select(*[
        winsorise(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.col(f"{c}_lo"), F.col(f"{c}_hi")).alias(c) if c in cols else F.col(c) for c in df.columns
    ])


def hourly_mean(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Mean per entity and clock hour."""
    hour = F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz").alias(ts)
    return df.groupBy(*keys, hour).agg(*[F.avg(c).alias(c) for c in cols])


def regular_grid(df: DataFrame, keys: Sequence[str], ts: str, step_seconds: int | Column = 3600) -> DataFrame:
    """Every grid stamp between an entity's first and last stamp; off-grid rows drop, gaps become null rows.

    The grid starts at the first stamp and keeps its minute offset. ``step_seconds`` may be a per-entity
    column of ``df``. Stamps are produced block by block, so no entity builds one long array.
    """
    keys = list(keys)
    step = step_seconds if isinstance(step_seconds, Column) else F.lit(step_seconds)
    span = df.groupBy(*keys).agg(
        F.min(blocks.epoch(ts)).alias("_a"), F.max(blocks.epoch(ts)).alias("_b"), F.max(step).alias("_step")
    )
    length = F.lit(blocks.BLOCK_ROWS) * F.col("_step")
    starts = blocks.by_block(span.select("*", F.explode(F.sequence("_a", "_b", length)).alias("_s")), keys, "_s")
    stamps = starts.select(
        *keys,
        F.explode(F.sequence(F.col("_s"), F.least(F.col("_b"), F.col("_s") + length - F.col("_step")), F.col("_step"))).alias("_t"),
    )
    grid = stamps.select(*keys, blocks.from_epoch(F.col("_t")).alias(ts))
    return blocks.join_nulls(grid, df, [*keys, ts]).select(*df.columns)


def modal_steps(df: DataFrame, keys: Sequence[str], ts: str, step_seconds: int = 3600) -> DataFrame:
    """keys, ``_modal``: the most common gap of each entity that has two rows or more."""
    placed = blocks.slot_position(df, ts, step_seconds)
    return windows.gap_profile(placed, keys, ts).select(*keys, F.col("modal_gap").alias("_modal"))


def grid_position(df: DataFrame, keys: Sequence[str], ts: str, steps: DataFrame, step_seconds: int = 3600) -> DataFrame:
    """Consecutive positions of gridded series: from the entity's own first stamp, in its own step."""
    first = df.groupBy(*keys).agg(F.min(blocks.epoch(ts)).alias("_first"))
    wide = blocks.attach(blocks.attach(df, first, keys), steps, keys)
    at = (blocks.epoch(ts) - F.col("_first")) / F.coalesce(F.col("_modal"), F.lit(step_seconds))
    return wide.select(*df.columns, at.cast("long").alias(blocks.POS))


def repair_irregular(
    df: DataFrame, keys: Sequence[str], ts: str, targets: Sequence[str], step_seconds: int = 3600, steps: DataFrame | None = None,
) -> DataFrame:
    """Entities with more than one distinct gap are put on their most common step and targets interpolated.

    ``steps`` passes on what ``modal_steps`` returned for ``df``.
    """
    keys = list(keys)
    profile = modal_steps(df, keys, ts, step_seconds) if steps is None else steps
    stepped = blocks.attach(df, profile, keys).withColumn("_modal", F.coalesce("_modal", F.lit(step_seconds)))
    grid = regular_grid(stepped, keys, ts, F.col("_modal")).drop("_modal")
    placed = blocks.slot_position(grid, ts, step_seconds)
    return windows.interpolate(placed, keys, ts, targets).drop(blocks.POS)


def clean_series(
    df: DataFrame, *, keys: Sequence[str], ts: str, cols: Sequence[str], max_missing: float = 0.30,
    sigma: float = 3.0, step_seconds: int = 3600, grid: bool = True,
) -> DataFrame:
    """Fill small gaps forward then backward, clip at three sigma, then put the series on its grid.

    A column of an entity is filled only if strictly less than ``max_missing`` of it is missing; bounds are
    taken after the fill; gridding comes last, so gaps it opens stay null. The filled rows are written once,
    because bounds, clipping and the grid all read them.
    """
    keys, cols = list(keys), list(cols)
    share = df.groupBy(*keys).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(f"_m_{c}") for c in cols])
    placed = blocks.slot_position(df, ts, step_seconds)
    filled = blocks.nearest(
        placed, keys, forward={f"_f_{c}": F.col(c) for c in cols}, backward={f"_b_{c}": F.col(c) for c in cols}, order=ts,
    )
    filled = blocks.attach(filled, share, keys)
    filled = filled.select(*[
        F.when(F.col(f"_m_{c}") < max_missing, F.coalesce(F.col(c), F.col(f"_f_{c}"), F.col(f"_b_{c}"))).otherwise(F.col(c)).alias(c)
        if c in cols else F.col(c) for c in df.columns
    ])
    clipped = clip_sigma(staged(filled, "filled"), cols, keys, sigma)
    return regular_grid(clipped, keys, ts, step_seconds) if grid else clipped


def clean_table(
    df: DataFrame, *, keys: Sequence[str] = (), numeric: Sequence[str] | None = None,
    strings: Sequence[str] | None = None, sigma: float = 3.0,
) -> DataFrame:
    """Median fill of numeric columns, three-sigma clip, mode fill of string columns."""
    keys = list(keys)
    num = list(numeric if numeric is not None else numeric_columns(df, keys))
    txt = list(strings if strings is not None else string_columns(df, keys))
    out = df
    if num:
        out = blocks.attach(out, quantiles.exact_wide(df, keys, num, {"median": 0.5}), keys)
        out = out.select(*[F.coalesce(F.col(c).cast("double"), F.col(f"{c}_median")).alias(c) if c in num else F.col(c) for c in df.columns])
        out = clip_sigma(out, num, keys, sigma)
    for c in txt:
        out = blocks.attach(out, quantiles.mode_value(df, keys, c), keys)
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"{c}_mode"))).drop(f"{c}_mode")
    return out.select(*df.columns)


def fit_scaler(df: DataFrame, cols: Sequence[str], method: str = "standard", keys: Sequence[str] = ()) -> DataFrame:
    """Scaling parameters as data: keys, ``column``, ``centre``, ``scale``; save it as Parquet to reuse it.

    standard: mean and population deviation; minmax: minimum and range. A constant column scales by one.
    """
    keys = list(keys)
    aggs = []
    for c in cols:
        if method == "standard":
            centre, scale = F.avg(c), F.stddev_pop(c)
        elif method == "minmax":
            centre, scale = F.min(c).cast("double"), (F.max(c) - F.min(c)).cast("double")
        else:
            raise ValueError(f"unknown scaling {method!r}")
        aggs.append(F.struct(F.lit(c).alias("column"), centre.alias("centre"),
                             F.when(scale == 0, 1.0).otherwise(scale).alias("scale")).alias(f"_s_{c}"))
    stats = df.groupBy(*keys).agg(*aggs)
    return stats.select(*keys, F.explode(F.array(*[f"_s_{c}" for c in cols])).alias("s")).select(*keys, "s.*")


def _scale_columns(scaler: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return scaler.groupBy(*keys).agg(*[
        F.max(F.when(F.col("column") == c, F.col(v))).alias(f"_{v}_{c}") for c in cols for v in ("centre", "scale")
    ])


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    wide = blocks.attach(df, _scale_columns(scaler, cols, keys), keys)
    return wide.select(*[
        ((F.col(c) - F.col(f"_centre_{c}")) / F.col(f"_scale_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns
    ])


def invert_scaler(df: DataFrame, scaler: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    wide = blocks.attach(df, _scale_columns(scaler, cols, keys), keys)
    return wide.select(*[
        (F.col(c) * F.col(f"_scale_{c}") + F.col(f"_centre_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns
    ])


def duplicate_keys(df: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*pk).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def orphans(child: DataFrame, parent: DataFrame, column: str, parent_column: str | None = None) -> DataFrame:
    """Child rows whose reference has no parent."""
    other = parent.select(F.col(parent_column or column).alias(column)).distinct()
    return child.filter(F.col(column).isNotNull()).join(other, column, "left_anti")
