"""Feature sets for forecasting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.functions import calendar, weather
from plantlens.operators import blocks, external, quality, windows
from plantlens.operators.windows import Feature
from plantlens.session import staged

# Column keywords that name a pollutant, and the fallback target names.
POLLUTANT_KEYWORDS = ("so2", "nox", "soot", "二氧化硫", "氮氧化物", "烟尘")
DEFAULT_TARGETS = ("VENT_SO2_CHK", "VENT_NOX_CHK", "VENT_SOOT_CHK")


def choose_targets(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    """Pollutant columns by keyword (any case), else the first three numeric columns, else the default names."""
    names = [c for c in df.columns if c not in skip]
    hits = [c for c in names if any(k in c.lower() for k in POLLUTANT_KEYWORDS)]
    return hits or quality.numeric_columns(df, skip)[:3] or list(DEFAULT_TARGETS)


def target_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "target" in c]


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def shrink(n: int, windows_: Sequence[int], horizon: int) -> tuple[list[int], int]:
    """Windows and horizon that fit a series of ``n`` rows."""
    if n >= max(windows_) + horizon:
        return list(windows_), horizon
    m = min(windows_)
    while m > 1 and m + horizon > n:
        m //= 2
    return [w for w in windows_ if w <= m] or [m], min(horizon, n - m)


def halvings(window: int) -> list[int]:
    """The window and its repeated halves, down to one row."""
    out = [window]
    while out[-1] > 1:
        out.append(out[-1] // 2)
    return out


def frame(n: Column, windows_: Sequence[int], horizon: int) -> tuple[Column, Column]:
    """``shrink`` as columns: the one window of a short series (null where all fit) and the horizon, at least zero."""
    fits = F.coalesce(*[F.when(n >= m + horizon, m) for m in halvings(min(windows_))], F.lit(1))
    short = n < max(windows_) + horizon
    return F.when(short, fits).cast("int"), F.when(short, F.greatest(F.least(F.lit(horizon), n - fits), F.lit(0))).otherwise(horizon).cast("int")


def sliding_features(targets: Sequence[str], windows_: Sequence[int], horizon: int) -> list[Feature]:
    """Rolling statistics, differences, changes and the next ``horizon`` values of each target."""
    out: list[Feature] = []
    for c in targets:
        for w in windows_:
            half = max(1, w // 2)
            out += [windows.rolling(c, s, w, f"{c}_{s}_{w}h", min_periods=half) for s in ("mean", "std", "min", "max")]
            out += [windows.diff(c, w, f"{c}_diff_{w}h"), windows.pct_change(f"_pad_{c}", w, f"{c}_pct_change_{w}h")]
        out += [windows.lead(c, h, f"{c}_target_{h}h") for h in range(1, horizon + 1)]
    return out


def sliding(
    df: DataFrame, *, keys: Sequence[str], ts: str, targets: Sequence[str], windows_: Sequence[int] = (24, 48, 72),
    horizon: int = 24, step_seconds: int = 3600, null_policy: str = "auto", repair: bool = True, by_length: bool = False,
) -> DataFrame:
    """Sliding-window training rows: repair the grid, add features and targets, apply the null policy.

    A series too short for its windows gives no complete row, unless ``by_length`` lets windows and horizon shrink with
    it (``sliding_by_length``).

    Fills read their input twice, so the series is written once before and once after the repair. A repaired series is
    positioned by its own first stamp and step; without repair all entities lie on the grid of ``step_seconds``.
    """
    if repair:
        rows = staged(df, "series")
        steps = staged(quality.modal_steps(rows, keys, ts, step_seconds), "steps")
        series = staged(quality.repair_irregular(rows, keys, ts, targets, step_seconds, steps), "repaired")
        placed = quality.grid_position(series, keys, ts, steps, step_seconds)
    else:
        placed = blocks.slot_position(df, ts, step_seconds)
    if by_length:
        return sliding_by_length(placed, keys=keys, targets=targets, windows_=windows_, horizon=horizon, null_policy=null_policy).drop(blocks.POS)
    padded = blocks.nearest(placed, keys, forward={f"_pad_{c}": F.col(c) for c in targets})
    feats = sliding_features(targets, windows_, horizon)
    wide = windows.add(padded, keys, feats).drop(blocks.POS, *[f"_pad_{c}" for c in targets])
    return drop_incomplete(wide, [f.name for f in feats], null_policy)


def sliding_by_length(
    placed: DataFrame, *, keys: Sequence[str], targets: Sequence[str], windows_: Sequence[int] = (24, 48, 72),
    horizon: int = 24, null_policy: str = "auto",
) -> DataFrame:
    """Sliding-window rows in which each entity's windows and horizon fit the number of its rows (``shrink``).

    ``placed`` carries row positions. One count per entity puts it into a class: all windows fit, or the one window left
    of halving the smallest. There are log2(smallest window) + 2 classes at most, whatever the number of entities, and a
    class computes only its own windows. The columns are the same for any data: those of ``windows_``, of all
    halvings, and ``frame_window`` (null where all windows fit) and ``frame_horizon``. What is not in an entity's frame is
    null, and the null policy does not ask for it. The policy looks at each entity as a table of its own: 'drop' keeps complete
    rows; 'auto' does too, but where fewer than five of more than five rows are complete, it keeps the rows with all
    targets and fills them with the entity's means (null where it has no value); 'keep' keeps all rows. An entity of
    one row has no target, hence no complete row. Null keys are an entity; an empty table gives an empty one.
    """
    keys = list(keys)
    window, ahead = frame(F.col("_n"), windows_, horizon)
    counts = placed.groupBy(*keys).agg(F.count("*").alias("_n"))
    sized = counts.select(*keys, window.alias("frame_window"), ahead.alias("frame_horizon"))
    padded = blocks.nearest(placed, keys, forward={f"_pad_{c}": F.col(c) for c in targets})
    rows = staged(blocks.attach(padded, sized, keys), "framed")
    present = {r[0] for r in rows.select("frame_window").distinct().collect()}
    halves = halvings(min(windows_))
    wide = None
    for m in [None, *[m for m in halves if m in present]]:
        feats = sliding_features(targets, windows_ if m is None else [m], horizon)
        part = windows.add(rows.filter(F.col("frame_window").eqNullSafe(F.lit(m).cast("int"))), keys, feats)
        wide = part if wide is None else wide.unionByName(part, allowMissingColumns=True)
    stats = {f.name: w for w in dict.fromkeys([*windows_, *halves]) for f in sliding_features(targets, [w], 0)}
    ahead_of = {f"{c}_target_{h}h": h for c in targets for h in range(1, horizon + 1)}
    given = [c for c in placed.columns if c not in stats and c not in ahead_of]

    def in_frame(c: str) -> Column:
        if c in ahead_of:
            return F.col("frame_horizon") >= ahead_of[c]
        alone = F.col("frame_window").eqNullSafe(F.lit(stats[c]))
        return alone | F.col("frame_window").isNull() if stats[c] in windows_ else alone

    def all_known(names: Sequence[str]) -> Column:
        out = F.col("frame_horizon") > 0
        for c in names:
            out = out & (F.col(c).isNotNull() | ~in_frame(c) if c in stats or c in ahead_of else F.col(c).isNotNull())
        return out

    cells = [(F.when(in_frame(c), F.col(c)) if c in wide.columns else F.lit(None).cast("double")).alias(c) for c in [*stats, *ahead_of]]
    out = wide.select(*given, "frame_window", "frame_horizon", *cells)
    if null_policy == "keep":
        return out
    aimed, complete = all_known(list(ahead_of)), all_known([*[c for c in given if c not in keys], *stats, *ahead_of])
    if null_policy == "drop":
        return out.filter(complete)
    out = staged(out.withColumns({"_complete": complete, "_aimed": aimed}), "features")
    means = quality.numeric_columns(out, [*keys, *ahead_of, blocks.POS, "frame_window", "frame_horizon"])
    facts = out.groupBy(*keys).agg(
        ((F.count_if("_complete") < 5) & (F.count("*") > 5)).alias("_fill"), *[F.avg(F.when(F.col("_aimed"), F.col(c))).alias(f"_mean_{c}") for c in means])
    judged = blocks.attach(out, facts, keys).filter(F.when(F.col("_fill"), F.col("_aimed")).otherwise(F.col("_complete")))
    return judged.select(*[
        F.coalesce(F.col(c), F.when(F.col("_fill"), F.col(f"_mean_{c}"))).alias(c) if c in means else F.col(c)
        for c in out.columns if c not in ("_complete", "_aimed")])


def drop_incomplete(df: DataFrame, created: Sequence[str], policy: str = "auto") -> DataFrame:
    """Keep complete rows; if fewer than five of more than five remain, keep rows with targets and mean-fill.

    'auto' has to count first, so it writes the rows once and reads them back; 'drop' skips that.
    """
    if policy == "keep":
        return df
    if policy in ("auto", "fill"):
        df = staged(df, "features")
    if policy == "auto":
        complete = None
        for c in df.columns:
            t = F.col(c).isNotNull()
            complete = t if complete is None else complete & t
        n = df.agg(F.count("*").alias("n"), F.count_if(complete).alias("ok")).first()
        policy = "fill" if n["ok"] < 5 and n["n"] > 5 else "drop"
    if policy == "drop":
        return df.dropna("any")
    kept = df.dropna("any", subset=[c for c in created if "_target_" in c])
    num = quality.numeric_columns(kept)
    means = kept.agg(*[F.avg(c).alias(c) for c in num]).first().asDict()
    return kept.fillna({c: v for c, v in means.items() if v is not None})


def environment(df: DataFrame, *, keys: Sequence[str], pos: str = blocks.POS) -> DataFrame:
    """Interactions of whatever environment columns exist."""
    have, add = set(df.columns), {}
    t, h, v = F.col("temperature"), F.col("humidity"), F.col("wind_speed")
    if {"temperature", "humidity"} <= have:
        add["temp_humid_interaction"] = t * h
        add["discomfort_index"] = weather.discomfort_index(t, h)
    if {"temperature", "wind_speed"} <= have:
        add["wind_chill"] = weather.wind_chill(t, v)
    out = df.withColumns(add) if add else df
    if "pressure" in have:
        out = windows.add(out, keys, [Feature(
            "pressure_change", lambda w: F.coalesce(F.col("pressure") - F.lag("pressure").over(w), F.lit(0.0)), before=1)], pos)
    return out


def load(df: DataFrame, *, keys: Sequence[str], ts: str, alpha: float = 0.3, col: str = "load") -> DataFrame:
    """Load gradient, square, exponentially weighted mean and quartile level. Needs row positions."""
    out = windows.add(df, keys, [
        Feature("load_gradient", lambda w: F.coalesce(F.col(col) - F.lag(col).over(w), F.lit(0.0)), before=1),
        windows.ewm_mean(col, alpha, "load_ema"),
    ]).withColumn("load_squared", F.col(col) * F.col(col))
    return windows.quartile_level(out, keys, col, ts, "load_level")


def history_features(target: str, lookbacks: Sequence[int], limit: str | None = None) -> list[Feature]:
    out = []
    for w in lookbacks:
        out += [windows.rolling(target, s, w, f"{target}_{s}_{w}h", shift=1) for s in ("avg", "max", "min", "std")]
    out += [windows.lag(target, 24, f"{target}_24h_ago"), windows.diff(target, 1, f"{target}_trend_1h"),
            windows.diff(target, 3, f"{target}_trend_3h")]
    if limit:
        out.append(windows.rolling(limit, "sum", 24, f"{target}_over_limit_24h", shift=1))
    return out


def history(
    df: DataFrame, *, keys: Sequence[str], targets: Sequence[str], lookbacks: Sequence[int] = (1, 3, 6, 12, 24, 48),
    fill: str = "none",
) -> DataFrame:
    """Look-back statistics that exclude the current row. ``fill='bfill_ffill'`` reproduces the leaking fill."""
    flags = {f"{c}_over_limit": (F.col(c) > F.col(f"{c}_limit")).cast("int") for c in targets if f"{c}_limit" in df.columns}
    base = df.withColumns(flags) if flags else df
    feats = [f for c in targets for f in history_features(c, lookbacks, f"{c}_over_limit" if f"{c}_over_limit" in flags else None)]
    out = windows.add(base, keys, feats)
    if fill == "none":
        return out
    out = staged(out, "history")
    names = [c for c in out.columns if c not in {*keys, blocks.POS}]
    both = blocks.nearest(out, keys, forward={f"_f_{c}": F.col(c) for c in names}, backward={f"_b_{c}": F.col(c) for c in names})
    return both.select(*[F.coalesce(F.col(f"_b_{c}"), F.col(f"_f_{c}")).alias(c) if c in names else F.col(c) for c in out.columns])


def all_features(df: DataFrame, *, keys: Sequence[str], ts: str, targets: Sequence[str]) -> DataFrame:
    """Calendar, environment, load and history features of a series with gaps."""
    placed = staged(blocks.row_position(calendar.add(df, ts, "C"), keys, ts), "placed")
    out = environment(placed, keys=keys)
    if "load" in df.columns:
        out = staged(load(out, keys=keys, ts=ts), "load")
    return history(out, keys=keys, targets=targets).drop(blocks.POS)


def build_training_set(
    series: DataFrame, ext: DataFrame | None, *, keys: Sequence[str], ts: str, targets: Sequence[str],
    windows_: Sequence[int] = (24, 48, 72), horizon: int = 24, null_policy: str = "auto",
) -> DataFrame:
    """Series with daily external columns and sliding-window features."""
    rows = sliding(series, keys=keys, ts=ts, targets=targets, windows_=windows_, horizon=horizon, null_policy=null_policy)
    return external.join_daily(rows, ext, ts=ts) if ext is not None else rows


def widen_sensors(history_rows: DataFrame, tags: DataFrame, *, ts: str, names: Sequence[str]) -> DataFrame:
    """Long sensor rows to one column per tag name, by plant and time."""
    joined = blocks.attach(history_rows, tags, ["tag"]).filter(F.col("name").isNotNull())
    return joined.groupBy("plant_id", ts).pivot("name", list(names)).agg(F.avg("value"))
