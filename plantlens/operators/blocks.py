"""Ordered-row operations that never put a whole series into one task.

A window partitioned only by entity sends every row of an entity to one task; one entity may hold a third
of all rows. Here a series is cut into blocks of consecutive positions:

* bounded frames (rolling, lag, lead) copy the few rows a neighbouring block needs (a halo), compute per
  (entity, block) and drop the copies;
* unbounded fills compute inside the block and join a carry taken from a one-row-per-block summary.

Both give exactly the rows of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 1024
POS = "_pos"
REL = "_rel"


def epoch(ts: str | Column) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone (sessions are pinned to UTC)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_seconds(c.cast("timestamp"))


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def floor_div(a: Column, size: int) -> Column:
    return ((a - F.pmod(a, F.lit(size))) / F.lit(size)).cast("long")


def by_block(df: DataFrame, keys: Sequence[str], *block: str) -> DataFrame:
    """Distribute rows by entity and block.

    Said explicitly because a frame already distributed by entity alone (after a join on it) would satisfy a
    window over entity and block, and leave a hot entity in one task.
    """
    return df.repartition(*keys, *block)


def slot_position(df: DataFrame, ts: str, step_seconds: int = 3600) -> DataFrame:
    """Position on a regular grid: consecutive rows of a gridded series get consecutive numbers."""
    return df.withColumn(POS, floor_div(epoch(ts), step_seconds))


def row_position(df: DataFrame, keys: Sequence[str], ts: str, step_seconds: int = 3600) -> DataFrame:
    """Exact row number per entity in ``ts`` order for a series with gaps.

    (keys, ts) must be unique and stamps at least ``step_seconds`` apart on average, which bounds a time
    block by BLOCK_ROWS rows. Rows are numbered inside their time block and shifted by the row counts of
    the earlier blocks.
    """
    keys = list(keys)
    blocked = df.withColumn("_tb", floor_div(epoch(ts), step_seconds * BLOCK_ROWS))
    spread = by_block(blocked, keys, "_tb")
    counts = blocked.groupBy(*keys, "_tb").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_tb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    rn = F.row_number().over(Window.partitionBy(*keys, "_tb").orderBy(ts))
    return join_nulls(spread.withColumn("_rn", rn), offsets, [*keys, "_tb"]).select(
        *df.columns, (F.col("_off") + F.col("_rn") - 1).alias(POS))


Build = Callable[[WindowSpec], list[Column]]


def over_blocks(
    df: DataFrame, keys: Sequence[str], build: Build, before: int, after: int = 0, pos: str = POS,
    block_rows: int | None = None,
) -> DataFrame:
    """Append window columns whose frames reach at most ``before`` rows back and ``after`` rows ahead.

    ``build`` receives the window (entity + block, ordered by position) and returns aliased columns, so all
    features of a call share one shuffle and one sort. Positions must be consecutive per entity.
    """
    keys = list(keys)
    size = max(block_rows or BLOCK_ROWS, before, after)
    home, off = floor_div(F.col(pos), size), F.pmod(F.col(pos), F.lit(size))
    copies = [home]
    if before:
        copies.append(F.when(off >= size - before, home + 1))
    if after:
        copies.append(F.when(off < after, home - 1))
    spread = df.select(
        "*", home.alias("_home"), F.explode(F.array_compact(F.array(*copies))).alias("_block")
    )
    # offset from the block start, negative in the leading halo; features may use it as a local clock
    spread = by_block(spread.withColumn(REL, F.col(pos) - F.col("_block") * size), keys, "_block")
    w = Window.partitionBy(*keys, "_block").orderBy(pos)
    return spread.select(*df.columns, *build(w), "_home", "_block").filter("_home = _block").drop("_home", "_block")


def nearest(
    df: DataFrame, keys: Sequence[str], forward: dict[str, Column] | None = None,
    backward: dict[str, Column] | None = None, pos: str = POS, inclusive: bool = True, block_rows: int | None = None,
    order: str | None = None,
) -> DataFrame:
    """Append, per name, the nearest non-null value at or before (``forward``) / at or after (``backward``) a row.

    ``inclusive=False`` looks strictly before / after. ``pos`` only has to be ordered, not gap-free; where rows can
    share a position, ``order`` names the finer column (the stamp) that orders them. Both directions share one shuffle,
    one sort and one summary.
    """
    keys, by = list(keys), order or pos
    wanted = [(n, c, True) for n, c in (forward or {}).items()] + [(n, c, False) for n, c in (backward or {}).items()]
    base = df.withColumns({**{f"_v_{n}": c for n, c, _ in wanted}, "_block": floor_div(F.col(pos), block_rows or BLOCK_ROWS)})

    def edge(n: str, ahead: bool) -> Column:
        known = F.when(F.col(f"_v_{n}").isNotNull(), F.col(by))
        return (F.max_by if ahead else F.min_by)(F.col(f"_v_{n}"), known).alias(f"_v_{n}")

    summary = base.groupBy(*keys, "_block").agg(*[edge(n, ahead) for n, _, ahead in wanted])
    across = Window.partitionBy(*keys).orderBy("_block")
    inside = Window.partitionBy(*keys, "_block").orderBy(by)
    end = 0 if inclusive else 1
    frames = {
        True: (F.last, across.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, -end)),
        False: (F.first, across.rowsBetween(1, Window.unboundedFollowing), inside.rowsBetween(end, Window.unboundedFollowing)),
    }

    def picked(n: str, ahead: bool, far: bool) -> Column:
        pick, outer, inner = frames[ahead]
        return pick(f"_v_{n}", ignorenulls=True).over(outer if far else inner).alias(f"{'_c' if far else '_n'}_{n}")

    carry = summary.select(*keys, "_block", *[picked(n, ahead, True) for n, _, ahead in wanted])
    near = by_block(base, keys, "_block").select("*", *[picked(n, ahead, False) for n, _, ahead in wanted])
    names = [n for n, _, _ in wanted]
    return join_nulls(near, carry, [*keys, "_block"]).select(
        *[c for c in df.columns if c not in names],
        *[F.coalesce(F.col(f"_n_{n}"), F.col(f"_c_{n}")).alias(n) for n in names],
    )


def join_nulls(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on ``keys`` in which a null key meets a null key; adds the other columns of ``side``."""
    keys = list(keys)
    other = side.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in side.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(other, same, "left").drop(*[f"_k_{k}" for k in keys])


def attach(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join a side that is usually tiny (statistics per entity, one row per day).

    Null keys meet null keys. The optimiser and adaptive execution broadcast the side if its size allows and split
    skewed keys if not. A side without keys is one row, which becomes literals.
    """
    keys = list(keys)
    if keys:
        return join_nulls(df, side, keys)
    row, types = side.first(), dict(side.dtypes)
    return df.withColumns({c: F.lit(row[c]).cast(types[c]) for c in side.columns})
