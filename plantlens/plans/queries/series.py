"""Window operators over hourly series, with gaps (row frames) and on the grid (time frames)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.functions import calendar
from plantlens.operators import blocks, features, quality, spectrum, stats, windows
from plantlens.plans import catalog
from plantlens.plans.queries.base import GRID, HOURLY, ROWS, query
from plantlens.session import staged

KEY = ["unit"]


def _hourly(spark, d):
    """The hourly series, aggregated from the readings once and kept as a table."""
    return staged(catalog.hourly(spark, d), "hourly")


def _rows(spark, d):
    """Hourly series with their exact row positions."""
    return blocks.row_position(_hourly(spark, d), KEY, "ts")


def _grid(spark, d):
    """Hourly series on a gap-free grid; missing hours are null rows."""
    return blocks.slot_position(quality.regular_grid(_hourly(spark, d), KEY, "ts"), "ts")


def _filled(spark, d):
    """Gridded series with every gap interpolated."""
    return windows.interpolate(_grid(spark, d), KEY, "ts", ["value", "load"])


_W = "WINDOW w AS (PARTITION BY unit ORDER BY ts)"


def _frame(fn: str, col: str, lo: str, hi: str, need: int) -> str:
    f = f"OVER (PARTITION BY unit ORDER BY ts ROWS BETWEEN {lo} AND {hi})"
    return f"CASE WHEN count({col}) {f} >= {need} THEN {fn}({col}) {f} END"


def _roll(col: str, stat: str, w: int, name: str, need: int | None = None, shift: int = 0) -> str:
    fn = {"mean": "avg", "avg": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum"}[stat]
    hi = f"{shift} PRECEDING" if shift else "CURRENT ROW"
    return f"{_frame(fn, col, f'{w - 1 + shift} PRECEDING', hi, w if need is None else need)} AS {name}"


_STATS = ("mean", "std", "min", "max")


@query("W01_rolling", "s:unit t:ts f:" + ",".join(f"value_{s}_{w}h" for w in (24, 48, 72) for s in _STATS),
       f"WITH {HOURLY}, {GRID} SELECT unit, ts, " + ", ".join(_roll("value", s, w, f"value_{s}_{w}h", w // 2) for w in (24, 48, 72) for s in _STATS) + " FROM grid")
def w01(spark, d):
    feats = [windows.rolling("value", s, w, f"value_{s}_{w}h", min_periods=w // 2) for w in (24, 48, 72) for s in _STATS]
    return windows.add(_grid(spark, d), KEY, feats)


_BACK = (1, 3, 6, 12, 24, 48)


@query("W02_rolling_shifted", "s:unit t:ts f:" + ",".join(f"value_{s}_{w}h" for w in _BACK for s in ("avg", "max", "min", "std")),
       f"WITH {HOURLY} SELECT unit, ts, " + ", ".join(_roll("value", s, w, f"value_{s}_{w}h", shift=1) for w in _BACK for s in ("avg", "max", "min", "std")) + " FROM hourly")
def w02(spark, d):
    feats = [windows.rolling("value", s, w, f"value_{s}_{w}h", shift=1) for w in _BACK for s in ("avg", "max", "min", "std")]
    return windows.add(_rows(spark, d), KEY, feats)


@query("W03_forward_fill", "s:unit t:ts f:value", f"WITH {HOURLY}, {GRID} SELECT unit, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY unit ORDER BY ts ROWS UNBOUNDED PRECEDING) AS value FROM grid")
def w03(spark, d):
    return windows.ffill(_grid(spark, d), KEY, ["value"])


@query("W04_backward_fill", "s:unit t:ts f:value", f"WITH {HOURLY}, {GRID} SELECT unit, ts, first_value(value IGNORE NULLS) OVER (PARTITION BY unit ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM grid")
def w04(spark, d):
    return windows.bfill(_grid(spark, d), KEY, ["value"])


@query("W05_difference", "s:unit t:ts f:d1,d24", f"WITH {HOURLY} SELECT unit, ts, value - lag(value) OVER w AS d1, value - lag(value, 24) OVER w AS d24 FROM hourly {_W}")
def w05(spark, d):
    return windows.add(_rows(spark, d), KEY, [windows.diff("value", 1, "d1"), windows.diff("value", 24, "d24")])


@query("W06_relative_change", "s:unit t:ts f:change",
       f"""WITH {HOURLY}, {GRID}, p AS (SELECT unit, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY unit ORDER BY ts ROWS UNBOUNDED PRECEDING) AS v FROM grid)
       SELECT unit, ts, v / nullif(lag(v, 24) OVER w, 0) - 1 AS change FROM p {_W}""")
def w06(spark, d):
    return windows.add(windows.ffill(_grid(spark, d), KEY, ["value"]), KEY, [windows.pct_change("value", 24, "change")])


@query("W07_seasonal_lag", "s:unit t:ts f:day_ago,trend_3h", f"WITH {HOURLY} SELECT unit, ts, lag(value, 24) OVER w AS day_ago, value - lag(value, 3) OVER w AS trend_3h FROM hourly {_W}")
def w07(spark, d):
    return windows.add(_rows(spark, d), KEY, [windows.lag("value", 24, "day_ago"), windows.diff("value", 3, "trend_3h")])


@query("W08_targets", "s:unit t:ts f:" + ",".join(f"value_target_{h}h" for h in range(1, 25)),
       f"WITH {HOURLY}, {GRID} SELECT unit, ts, " + ", ".join(f"lead(value, {h}) OVER w AS value_target_{h}h" for h in range(1, 25)) + f" FROM grid {_W}")
def w08(spark, d):
    return windows.add(_grid(spark, d), KEY, [windows.lead("value", h, f"value_target_{h}h") for h in range(1, 25)])


@query("W09_exceedances_in_24", "s:unit t:ts i:over_24h", f"WITH {HOURLY}, f AS (SELECT unit, ts, CASE WHEN value > 300 THEN 1 ELSE 0 END AS flag FROM hourly) SELECT unit, ts, {_roll('flag', 'sum', 24, 'over_24h', shift=1)} FROM f")
def w09(spark, d):
    rows = _rows(spark, d).withColumn("flag", (F.col("value") > 300).cast("int"))
    return windows.add(rows, KEY, [windows.rolling("flag", "sum", 24, "over_24h", shift=1)])


@query("W10_weighted_mean", "s:unit t:ts f:ema",
       f"""WITH {HOURLY}, {ROWS} SELECT a.unit, a.ts, sum(b.load * pow(0.7, a.pos - b.pos)) / sum(pow(0.7, a.pos - b.pos)) AS ema
       FROM rows_ a JOIN rows_ b ON a.unit = b.unit AND b.pos <= a.pos GROUP BY 1, 2""")
def w10(spark, d):
    return windows.add(_rows(spark, d), KEY, [windows.ewm_mean("load", 0.3, "ema")])


_LEVEL = "greatest(0, CAST(ceil(4.0::DOUBLE * (r - 1) / (size - 1)) AS BIGINT) - 1)"


@query("W11_quartile_level", "s:unit t:ts i:level",
       f"WITH {HOURLY}, k AS (SELECT unit, ts, row_number() OVER (PARTITION BY unit ORDER BY load, ts) AS r, count(*) OVER (PARTITION BY unit) AS size FROM hourly) SELECT unit, ts, {_LEVEL} AS level FROM k")
def w11(spark, d):
    return windows.quartile_level(_hourly(spark, d), KEY, "load", "ts", "level")


@query("W13_gap_profile", "s:unit i:distinct_gaps,modal_gap",
       f"""WITH {HOURLY}, g AS (SELECT unit, epoch(ts - lag(ts) OVER w)::BIGINT AS gap FROM hourly {_W}), c AS (SELECT unit, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2)
       SELECT unit, count(*) AS distinct_gaps, arg_min(gap, (-n) * 1000000000 + gap) AS modal_gap FROM c GROUP BY 1""")
def w13(spark, d):
    return windows.gap_profile(blocks.slot_position(_hourly(spark, d), "ts"), KEY, "ts")


INTERP = """fill_ AS (SELECT unit, ts, {c}, last_value(CASE WHEN {c} IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER b AS pt, last_value({c} IGNORE NULLS) OVER b AS pv,
  first_value(CASE WHEN {c} IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER f AS nt, first_value({c} IGNORE NULLS) OVER f AS nv FROM {src}
  WINDOW b AS (PARTITION BY unit ORDER BY ts ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY unit ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  interp AS (SELECT unit, ts, CASE WHEN {c} IS NOT NULL THEN {c} WHEN pt IS NULL THEN NULL WHEN nt IS NULL THEN pv ELSE pv + (nv - pv) * (epoch(ts) - pt) / (nt - pt) END AS {c} FROM fill_)"""


@query("W14_interpolate", "s:unit t:ts f:value", f"WITH {HOURLY}, {GRID}, {INTERP.format(c='value', src='grid')} SELECT unit, ts, value FROM interp")
def w14(spark, d):
    return windows.interpolate(_grid(spark, d), KEY, "ts", ["value"])


@query("W15_ranking", "s:unit t:ts f:value i:rank",
       f"WITH {HOURLY} SELECT * FROM (SELECT unit, ts, value, row_number() OVER (PARTITION BY unit ORDER BY value, ts) AS rank FROM hourly) WHERE rank <= 3")
def w15(spark, d):
    return windows.top_per_group(catalog.hourly(spark, d), KEY, [F.asc("value"), F.asc("ts")], 3)


# ---- statistics per period ----

def _eleven(c: str) -> str:
    skew = f"CASE WHEN count({c}) < 3 THEN NULL WHEN min({c}) = max({c}) THEN 0 ELSE skewness({c}) END"
    kurt = f"CASE WHEN count({c}) < 4 THEN NULL WHEN min({c}) = max({c}) THEN 0 ELSE kurtosis({c}) END"
    q = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    return (f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max, max({c}) - min({c}) AS {c}_range, {skew} AS {c}_skew, {kurt} AS {c}_kurt, "
            + ", ".join(f"quantile_cont({c}, {p}) AS {c}_{n}" for n, p in q.items()) + f", quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_iqr")


_NAMES = ",".join(f"value_{s}" for s in ("mean", "std", "min", "max", "range", "median", "q25", "q75", "iqr"))


@query("A08_statistics_by_day", f"s:unit d:day f:{_NAMES} f4:value_skew,value_kurt", f"WITH {HOURLY} SELECT unit, CAST(ts AS DATE) AS day, {_eleven('value')} FROM hourly GROUP BY 1, 2")
def a08_day(spark, d):
    return stats.by_period(catalog.hourly(spark, d), keys=KEY, ts="ts", cols=["value"], period="day")


@query("A08_statistics_by_week", f"s:unit i:year,week f:{_NAMES} f4:value_skew,value_kurt", f"WITH {HOURLY} SELECT unit, isoyear(ts) AS year, week(ts) AS week, {_eleven('value')} FROM hourly GROUP BY 1, 2, 3")
def a08_week(spark, d):
    return stats.by_period(catalog.hourly(spark, d), keys=KEY, ts="ts", cols=["value"], period="week")


@query("E04_statistics_by_month", f"s:unit i:month f:{_NAMES} f4:value_skew,value_kurt", f"WITH {HOURLY} SELECT unit, month(ts) AS month, {_eleven('value')} FROM hourly GROUP BY 1, 2")
def e04(spark, d):
    return stats.by_period(catalog.hourly(spark, d), keys=KEY, ts="ts", cols=["value"], period="month", merge_years=True)


# ---- frequency content ----

@query("E05_top_frequencies", "s:unit,col i:rank,n,bin f4:magnitude",
       f"""WITH {HOURLY}, {GRID}, {INTERP.format(c='value', src='grid')}, x AS (SELECT unit, value, row_number() OVER (PARTITION BY unit ORDER BY ts) - 1 AS t, count(*) OVER (PARTITION BY unit) AS n FROM interp),
       k AS (SELECT unit, n, unnest(range(1, n // 2)) AS bin FROM (SELECT DISTINCT unit, n FROM x)),
       m AS (SELECT unit, n, bin, sqrt(pow(sum(value * cos(2 * pi() * ((bin * t) % n) / n)), 2) + pow(sum(value * sin(2 * pi() * ((bin * t) % n) / n)), 2)) AS magnitude FROM x JOIN k USING (unit, n) GROUP BY 1, 2, 3)
       SELECT unit, 'value' AS col, n, bin, magnitude, rank FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY magnitude DESC, bin) AS rank FROM m) WHERE rank <= 5""")
def e05(spark, d):
    return spectrum.top_frequencies(staged(_filled(spark, d), "filled"), keys=KEY, ts="ts", cols=["value"])


# ---- composite feature sets ----

_CREATED = [f"value_{s}_{w}h" for w in (24, 48, 72) for s in (*_STATS, "diff", "pct_change")]
SLIDE = f"""{INTERP.format(c='value', src='grid')}, slide AS (SELECT unit, ts, value, """ + ", ".join(
    [_roll("value", s, w, f"value_{s}_{w}h", max(1, w // 2)) for w in (24, 48, 72) for s in _STATS]
    + [f"value - lag(value, {w}) OVER w AS value_diff_{w}h, value / nullif(lag(value, {w}) OVER w, 0) - 1 AS value_pct_change_{w}h" for w in (24, 48, 72)]
    + [f"lead(value, {h}) OVER w AS value_target_{h}h" for h in range(1, 25)]) + f" FROM interp {_W})"
COMPLETE = " AND ".join([f"{c} IS NOT NULL" for c in _CREATED] + [f"value_target_{h}h IS NOT NULL" for h in range(1, 25)])


@query("E01_sliding_features", "s:unit t:ts f:value," + ",".join(_CREATED) + "," + ",".join(f"value_target_{h}h" for h in range(1, 25)),
       f"WITH {HOURLY}, {GRID}, {SLIDE} SELECT * FROM slide WHERE {COMPLETE}")
def e01(spark, d):
    series = catalog.hourly(spark, d).select("unit", "ts", "value")
    return features.sliding(series, keys=KEY, ts="ts", targets=["value"], null_policy="drop")


@query("E02_null_policy", "s:unit t:ts f:value,value_lag,value_target_1h,value_target_2h",
       f"""WITH {HOURLY}, b AS (SELECT unit, ts, value, lag(value) OVER w AS value_lag, lead(value) OVER w AS value_target_1h, lead(value, 2) OVER w AS value_target_2h FROM hourly {_W}),
       k AS (SELECT * FROM b WHERE value_target_1h IS NOT NULL AND value_target_2h IS NOT NULL)
       SELECT unit, ts, coalesce(value, avg(value) OVER ()) AS value, coalesce(value_lag, avg(value_lag) OVER ()) AS value_lag, value_target_1h, value_target_2h FROM k""")
def e02(spark, d):
    feats = [windows.lag("value", 1, "value_lag"), *[windows.lead("value", h, f"value_target_{h}h") for h in (1, 2)]]
    wide = windows.add(_rows(spark, d), KEY, feats)
    kept = wide.select("unit", "ts", "value", "value_lag", "value_target_1h", "value_target_2h")
    return features.drop_incomplete(kept, ["value_lag", "value_target_1h", "value_target_2h"], "fill")


_SPAN, _AHEAD = (4, 8, 12), 4  # orders a customer looks back on, and ahead to
DAYS = "days AS (SELECT o_custkey AS custkey, o_orderdate AS day, sum(CAST(o_totalprice AS DOUBLE)) AS value FROM orders GROUP BY 1, 2)"
FRAMES = """frames AS (SELECT custkey, n, CASE WHEN n >= 16 THEN NULL WHEN n >= 8 THEN 4 WHEN n >= 6 THEN 2 ELSE 1 END AS frame_window,
       CASE WHEN n >= 5 THEN 4 ELSE n - 1 END AS frame_horizon FROM (SELECT custkey, count(*) AS n FROM days GROUP BY 1))"""


def _order_days(spark, d):
    """A customer's order value by day: many series of few rows."""
    return catalog.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey"), F.col("o_orderdate").cast("timestamp_ntz").alias("day")).agg(F.sum(F.col("o_totalprice").cast("double")).alias("value"))


@query("E03_window_shrink", "i:custkey,rows_,window,horizon",
       f'WITH {DAYS}, {FRAMES} SELECT custkey, n AS rows_, coalesce(frame_window, 12) AS "window", frame_horizon AS horizon FROM frames')
def e03(spark, d):
    n = F.col("n")
    window, horizon = features.frame(n, _SPAN, _AHEAD)
    counts = _order_days(spark, d).groupBy("custkey").agg(F.count("*").alias("n"))
    return counts.select("custkey", n.alias("rows_"), F.coalesce(window, F.lit(max(_SPAN))).alias("window"), horizon.alias("horizon"))


_SIZES = (1, 2, 4, 8, 12)
_ORDERED = "OVER (PARTITION BY custkey ORDER BY day)"
_OF_SIZE = {f"value_{k}_{w}h": w for w in _SIZES for k in (*_STATS, "diff", "pct_change")}
_IN_FRAME = {c: f"(frame_window IS NOT DISTINCT FROM {w}{' OR frame_window IS NULL' if w in _SPAN else ''})" for c, w in _OF_SIZE.items()}


def _by_customer(w: int) -> list[str]:
    """The columns of one window, for SQL."""
    rolled = [_roll("value", k, w, f"value_{k}_{w}h", max(1, w // 2)).replace("PARTITION BY unit ORDER BY ts", "PARTITION BY custkey ORDER BY day") for k in _STATS]
    return [*rolled, f"value - lag(value, {w}) {_ORDERED} AS value_diff_{w}h", f"value / nullif(lag(value, {w}) {_ORDERED}, 0) - 1 AS value_pct_change_{w}h"]


@query("E03_sliding_by_length", "i:custkey t:day f2:value i:frame_window,frame_horizon f2:" + ",".join([*_OF_SIZE, *[f"value_target_{h}h" for h in range(1, _AHEAD + 1)]]),
       f"""WITH {DAYS}, {FRAMES}, wide AS (SELECT custkey, day, value, """ + ", ".join([*[c for w in _SIZES for c in _by_customer(w)], *[f"lead(value, {h}) {_ORDERED} AS value_target_{h}h" for h in range(1, _AHEAD + 1)]])
       + " FROM days) SELECT custkey, CAST(day AS TIMESTAMP) AS day, value, frame_window, frame_horizon, "
       + ", ".join([*[f"CASE WHEN {test} THEN {c} END AS {c}" for c, test in _IN_FRAME.items()], *[f"CASE WHEN frame_horizon >= {h} THEN value_target_{h}h END AS value_target_{h}h" for h in range(1, _AHEAD + 1)]])
       + " FROM wide JOIN frames USING (custkey) WHERE frame_horizon > 0 AND "
       + " AND ".join([*[f"({c} IS NOT NULL OR NOT {test})" for c, test in _IN_FRAME.items()], *[f"(frame_horizon < {h} OR value_target_{h}h IS NOT NULL)" for h in range(1, _AHEAD + 1)]]))
def e03_sliding(spark, d):
    placed = blocks.row_position(staged(_order_days(spark, d), "days"), ["custkey"], "day", 86400)
    return features.sliding_by_length(placed, keys=["custkey"], targets=["value"], windows_=_SPAN, horizon=_AHEAD, null_policy="drop")


@query("E06_time_features", "s:unit t:ts i:hour,dayofweek,month,quarter,year,dayofyear,is_weekend f:hour_sin,hour_cos,month_cos",
       f"WITH {HOURLY} SELECT unit, ts, hour(ts) AS hour, isodow(ts) - 1 AS dayofweek, month(ts) AS month, quarter(ts) AS quarter, year(ts) AS year, dayofyear(ts) AS dayofyear, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos, cos(2 * pi() * month(ts) / 12) AS month_cos FROM hourly")
def e06(spark, d):
    return calendar.add(catalog.hourly(spark, d), "ts", "B")


def _weather(rows):
    """Environment columns derived from a series: temperature, humidity, wind speed, pressure."""
    return rows.withColumns({"temperature": F.col("value") / 10 - 10, "humidity": F.col("load"), "wind_speed": F.col("n") + 1, "pressure": 1000 + F.col("load") / 10})


_ENV = "SELECT unit, ts, value / 10 - 10 AS t, load AS h, n + 1 AS v, 1000 + load / 10 AS p FROM hourly"


@query("E09_environment", "s:unit t:ts f:temp_humid_interaction,discomfort_index,wind_chill,pressure_change",
       f"""WITH {HOURLY}, e AS ({_ENV}) SELECT unit, ts, t * h AS temp_humid_interaction, 0.81 * t + 0.01 * h * (0.99 * t - 14.3) + 46.3 AS discomfort_index,
       13.12 + 0.6215 * t - 11.37 * pow(v, 0.16) + 0.3965 * t * pow(v, 0.16) AS wind_chill, coalesce(p - lag(p) OVER w, 0) AS pressure_change FROM e {_W}""")
def e09(spark, d):
    return features.environment(_weather(_rows(spark, d)), keys=KEY)


_LOAD = f"""lev AS (SELECT unit, ts, {_LEVEL} AS load_level FROM (SELECT unit, ts, row_number() OVER (PARTITION BY unit ORDER BY load, ts) AS r, count(*) OVER (PARTITION BY unit) AS size FROM hourly)),
  ema AS (SELECT a.unit, a.ts, sum(b.load * pow(0.7, a.pos - b.pos)) / sum(pow(0.7, a.pos - b.pos)) AS load_ema FROM rows_ a JOIN rows_ b ON a.unit = b.unit AND b.pos <= a.pos GROUP BY 1, 2),
  grad AS (SELECT unit, ts, load * load AS load_squared, coalesce(load - lag(load) OVER w, 0) AS load_gradient FROM hourly {_W})"""


@query("E10_load_features", "s:unit t:ts f:load_gradient,load_squared,load_ema i:load_level", f"WITH {HOURLY}, {ROWS}, {_LOAD} SELECT * FROM grad JOIN ema USING (unit, ts) JOIN lev USING (unit, ts)")
def e10(spark, d):
    return features.load(staged(_rows(spark, d), "rows"), keys=KEY, ts="ts")


@query("F07_load_expressions", "s:unit t:ts f:load_squared,load_gradient,pressure_change",
       f"WITH {HOURLY} SELECT unit, ts, load * load AS load_squared, coalesce(load - lag(load) OVER w, 0) AS load_gradient, coalesce(load / 10 - lag(load / 10) OVER w, 0) AS pressure_change FROM hourly {_W}")
def f07(spark, d):
    rows = _rows(spark, d).withColumns({"load_squared": F.col("load") * F.col("load"), "pressure": F.col("load") / 10})
    step = windows.Feature("load_gradient", lambda w: F.coalesce(F.col("load") - F.lag("load").over(w), F.lit(0.0)), before=1)
    return windows.add(features.environment(rows, keys=KEY), KEY, [step])


_HIST = ", ".join([_roll("value", s, w, f"value_{s}_{w}h", shift=1) for w in _BACK for s in ("avg", "max", "min", "std")])
_HIST_NAMES = ",".join(f"value_{s}_{w}h" for w in _BACK for s in ("avg", "max", "min", "std"))
_HISTORY = f"""flag_ AS (SELECT unit, ts, value, load, n, CASE WHEN value > 300 THEN 1 ELSE 0 END AS value_over_limit FROM hourly),
  hist AS (SELECT unit, ts, value, value_over_limit, {_HIST}, lag(value, 24) OVER w AS value_24h_ago, value - lag(value) OVER w AS value_trend_1h, value - lag(value, 3) OVER w AS value_trend_3h,
  {_roll('value_over_limit', 'sum', 24, 'value_over_limit_24h', shift=1)} FROM flag_ {_W})"""
_HIST_SPEC = f"s:unit t:ts f:{_HIST_NAMES},value_24h_ago,value_trend_1h,value_trend_3h,value_over_limit_24h"


@query("E11_history_features", _HIST_SPEC, f"WITH {HOURLY}, {_HISTORY} SELECT * FROM hist")
def e11(spark, d):
    return features.history(_rows(spark, d).withColumn("value_limit", F.lit(300.0)), keys=KEY, targets=["value"])


_FILLED = ("value_avg_24h", "value_24h_ago", "value_trend_3h", "value_over_limit_24h", "value_std_6h")


@query("E11_history_leaking_fill", "s:unit t:ts f:" + ",".join(_FILLED), f"WITH {HOURLY}, {_HISTORY} SELECT unit, ts, " + ", ".join(
    f"coalesce(first_value({c} IGNORE NULLS) OVER (PARTITION BY unit ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value({c} IGNORE NULLS) OVER (PARTITION BY unit ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS {c}" for c in _FILLED) + " FROM hist")
def e11_fill(spark, d):
    return features.history(_rows(spark, d).withColumn("value_limit", F.lit(300.0)), keys=KEY, targets=["value"], fill="bfill_ffill")


@query("E12_all_features", _HIST_SPEC + ",load_ema,discomfort_index,pressure_change,dow_sin i:load_level,season",
       f"""WITH {HOURLY}, {ROWS}, {_HISTORY}, {_LOAD}, e AS ({_ENV}), env AS (SELECT unit, ts, 0.81 * t + 0.01 * h * (0.99 * t - 14.3) + 46.3 AS discomfort_index, coalesce(p - lag(p) OVER w, 0) AS pressure_change,
       sin(2 * pi() * (isodow(ts) - 1) / 7) AS dow_sin, CASE WHEN month(ts) BETWEEN 3 AND 5 THEN 1 WHEN month(ts) BETWEEN 6 AND 8 THEN 2 WHEN month(ts) BETWEEN 9 AND 11 THEN 3 ELSE 4 END AS season FROM e {_W})
       SELECT * FROM hist JOIN ema USING (unit, ts) JOIN lev USING (unit, ts) JOIN env USING (unit, ts)""")
def e12(spark, d):
    rows = _weather(catalog.hourly(spark, d)).withColumn("value_limit", F.lit(300.0))
    return features.all_features(rows, keys=KEY, ts="ts", targets=["value"])


@query("E16_sensors_wide", "i:plant_id t:ts f:view,click,signup",
       """SELECT user_id % 7 AS plant_id, date_trunc('hour', ts) AS ts, avg(value) FILTER (WHERE event_type = 'view') AS view, avg(value) FILTER (WHERE event_type = 'click') AS click, avg(value) FILTER (WHERE event_type = 'signup') AS signup
       FROM events WHERE event_type IN ('view', 'click', 'signup') GROUP BY 1, 2""")
def e16(spark, d):
    ev = catalog.table(spark, d, "events").select(
        (F.col("user_id") % 7).alias("plant_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.upper("event_type").alias("tag"), "value")
    tags = spark.createDataFrame([("VIEW", "view"), ("CLICK", "click"), ("SIGNUP", "signup")], "tag string, name string")
    return features.widen_sensors(ev, tags, ts="ts", names=["view", "click", "signup"])
