"""Block-wise windows against pandas on whole series, with blocks far shorter than the series."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantlens.operators import blocks, features, quality, windows
from tests.helpers import close, pdf, series

RNG = np.random.default_rng(5)
KEY = ["unit"]


def _values(n, holes=0.2):
    v = RNG.normal(50, 20, n).round(3).tolist()
    return [None if RNG.random() < holes else x for x in v]


def _two(spark, a, b):
    return series(spark, a).unionByName(series(spark, b, unit="b"))


def test_positions_are_exact_for_gappy_series(spark):
    values = [1.0 if i % 3 else ... for i in range(60)]
    out = pdf(blocks.row_position(_two(spark, values, values[:7]), KEY, "ts"), "unit", "ts")
    for _, g in out.groupby("unit"):
        assert g["_pos"].tolist() == list(range(len(g)))


@pytest.mark.parametrize("stat", ["mean", "std", "min", "max", "sum"])
@pytest.mark.parametrize("window,shift,need", [(3, 0, 1), (5, 1, None), (20, 1, None), (1, 1, None)])
def test_rolling_equals_pandas(spark, stat, window, shift, need):
    a, b = _values(45), _values(17)
    df = blocks.row_position(_two(spark, a, b), KEY, "ts")
    out = pdf(windows.add(df, KEY, [windows.rolling("value", stat, window, "r", min_periods=need, shift=shift)]), "unit", "ts")
    for unit, v in (("a", a), ("b", b)):
        want = getattr(pd.Series(v, dtype=float).rolling(window, min_periods=need), stat)().shift(shift)
        close(out[out.unit == unit]["r"], want)


def test_lag_lead_diff_cross_blocks(spark):
    v = _values(40, holes=0)
    df = blocks.slot_position(series(spark, v), "ts")
    feats = [windows.lag("value", 11, "lag"), windows.lead("value", 13, "lead"), windows.diff("value", 1, "diff")]
    out, s = pdf(windows.add(df, KEY, feats), "ts"), pd.Series(v)
    close(out["lag"], s.shift(11))
    close(out["lead"], s.shift(-13))
    close(out["diff"], s.diff())


def test_fills_and_interpolation_equal_pandas(spark):
    v = [None, None, 3.0] + [None] * 20 + [9.0, None, 1.0] + [None] * 12
    df = blocks.slot_position(series(spark, v), "ts")
    s = pd.Series(v, dtype=float)
    close(pdf(windows.ffill(df, KEY, ["value"]), "ts")["value"], s.ffill())
    close(pdf(windows.bfill(df, KEY, ["value"]), "ts")["value"], s.bfill())
    once = windows.ffill(df, KEY, ["value"])
    close(pdf(windows.ffill(once, KEY, ["value"]), "ts")["value"], s.ffill())
    timed = pd.Series(v, index=pd.date_range("2024-01-01", periods=len(v), freq="h"), dtype=float)
    close(pdf(windows.interpolate(df, KEY, "ts", ["value"]), "ts")["value"], timed.interpolate(method="time"))


def test_all_null_column_stays_null(spark):
    df = blocks.slot_position(series(spark, [None] * 20), "ts")
    assert pdf(windows.interpolate(df, KEY, "ts", ["value"]))["value"].isna().all()
    assert pdf(windows.ffill(df, KEY, ["value"]))["value"].isna().all()


def test_empty_series(spark):
    df = blocks.row_position(series(spark, []), KEY, "ts")
    assert windows.add(df, KEY, [windows.lag("value", 1, "l")]).count() == 0
    assert quality.regular_grid(series(spark, []), KEY, "ts").count() == 0


def test_weighted_mean_equals_pandas(spark):
    v = _values(300)
    df = blocks.slot_position(series(spark, v), "ts")
    out = pdf(windows.add(df, KEY, [windows.ewm_mean("value", 0.3, "e")]), "ts")
    close(out["e"], pd.Series(v, dtype=float).ewm(alpha=0.3).mean())


def test_quartile_levels_equal_qcut_with_ties(spark):
    v = [5.0] * 20 + RNG.integers(0, 6, 37).astype(float).tolist()
    out = pdf(windows.quartile_level(series(spark, v), KEY, "value", "ts", "level"), "ts")
    want = pd.qcut(pd.Series(v).rank(method="first"), 4, labels=[0, 1, 2, 3]).astype(int)
    assert out["level"].tolist() == want.tolist()


def test_quartile_level_single_row(spark):
    assert pdf(windows.quartile_level(series(spark, [4.0]), KEY, "value", "ts", "level"))["level"].tolist() == [0]


def test_gap_profile(spark):
    v = [1.0, 1.0, ..., 1.0, 1.0, 1.0] + [...] * 30 + [1.0]
    df = blocks.slot_position(series(spark, v), "ts")
    row = windows.gap_profile(df, KEY, "ts").first()
    assert (row["distinct_gaps"], row["modal_gap"]) == (3, 3600)


def test_latest_per_key_takes_first_on_ties(spark):
    rows = [("a", 1, 10), ("a", 2, 11), ("a", 2, 9), ("b", 1, 5)]
    df = spark.createDataFrame(rows, "unit string, t long, id long")
    got = {r["unit"]: r["id"] for r in windows.latest_per_key(df, ["unit"], "t", tie="id").collect()}
    assert got == {"a": 9, "b": 5}


def test_history_fill_reproduces_bfill_then_ffill(spark):
    v = _values(30)
    df = blocks.row_position(series(spark, v), KEY, "ts")
    out = pdf(features.history(df, keys=KEY, targets=["value"], lookbacks=(3,), fill="bfill_ffill"), "ts")
    s = pd.Series(v, dtype=float)
    close(out["value_avg_3h"], s.rolling(3).mean().shift(1).bfill().ffill())
    close(out["value_24h_ago"], s.shift(24).bfill().ffill())


def _framed(values, windows_, horizon):
    """The frame of one series by plain pandas: its complete rows under the shrunken windows."""
    n = len(values)
    own, ahead = features.shrink(n, windows_, horizon)
    s, cols = pd.Series(values, dtype=float), {}
    for w in own:
        roll = s.rolling(w, min_periods=max(1, w // 2))
        cols |= {f"value_mean_{w}h": roll.mean(), f"value_std_{w}h": roll.std(), f"value_min_{w}h": roll.min(), f"value_max_{w}h": roll.max(),
                 f"value_diff_{w}h": s.diff(w), f"value_pct_change_{w}h": s.pct_change(w, fill_method=None)}
    cols |= {f"value_target_{h}h": s.shift(-h) for h in range(1, ahead + 1)}
    wide = pd.DataFrame({"value": s, **cols})
    complete = wide.dropna() if ahead > 0 else wide.iloc[:0]
    if len(complete) < 5 and n > 5:
        complete = wide.dropna(subset=[c for c in wide if "target" in c])
        complete = complete.fillna(complete.mean())
    return complete


def test_sliding_by_length_equals_each_series_on_its_own(spark):
    rng = np.random.default_rng(5)
    lengths = {f"u{n}": n for n in (1, 2, 3, 4, 5, 6, 7, 9, 11, 14, 15, 16, 17, 30, 41)}
    lengths[None] = 12
    values = {u: rng.uniform(1, 9, n).round(3).tolist() for u, n in lengths.items()}
    rows = [(u, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), v, "x") for u, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "unit string, ts timestamp_ntz, value double, frame string")
    got = features.sliding(df, keys=["unit"], ts="ts", targets=["value"], windows_=(6, 9, 12), horizon=3, repair=False, by_length=True).toPandas()
    assert [c for c in got if c.startswith("value_mean")] == [f"value_mean_{w}h" for w in (6, 9, 12, 3, 1)]
    for u, vs in values.items():
        mine = got[got.unit.isna() if u is None else got.unit == u].sort_values("ts")
        want = _framed(vs, (6, 9, 12), 3)
        assert len(mine) == len(want), u
        for c in mine:
            if c in want:
                close(mine[c], want[c])
            elif c.startswith("value_"):
                assert mine[c].isna().all(), (u, c)
    dropped = features.sliding(df, keys=["unit"], ts="ts", targets=["value"], windows_=(6, 9, 12), horizon=3, repair=False, by_length=True, null_policy="drop")
    plain = features.sliding(df.where("unit = 'u41'"), keys=["unit"], ts="ts", targets=["value"], windows_=(6, 9, 12), horizon=3, repair=False, null_policy="drop")
    assert dropped.where("unit = 'u41'").count() == plain.count() > 0
    kept = features.sliding(df, keys=["unit"], ts="ts", targets=["value"], windows_=(6, 9, 12), horizon=3, repair=False, by_length=True, null_policy="keep")
    assert kept.count() == len(rows)
    assert features.sliding(df.limit(0), keys=["unit"], ts="ts", targets=["value"], repair=False, by_length=True).count() == 0


def test_frame_columns_follow_the_formula(spark):
    w, h = features.frame(F.col("id"), (24, 48, 72), 24)
    for r in spark.range(140).select("id", w.alias("w"), h.alias("h")).collect():
        own, ahead = features.shrink(r["id"], (24, 48, 72), 24)
        assert ([r["w"]] if r["w"] else [24, 48, 72], r["h"]) == (own, max(0, ahead))


def test_shrink_formula():
    assert features.shrink(200, (24, 48, 72), 24) == ([24, 48, 72], 24)
    assert features.shrink(60, (24, 48, 72), 24) == ([24], 24)
    assert features.shrink(30, (24, 48, 72), 24) == ([6], 24)
    assert features.shrink(10, (24, 48, 72), 24) == ([1], 9)


def test_null_policy_fills_when_too_few_complete_rows(spark):
    df = spark.createDataFrame([(float(i), None if i % 2 else 1.0, float(i)) for i in range(8)], "x double, y double, x_target_1h double")
    df = df.withColumn("y", F.when(F.col("x") > 1, None).otherwise(F.col("y")))
    out = features.drop_incomplete(df, ["y", "x_target_1h"])
    assert out.count() == 8 and out.filter("y is null").count() == 0
    assert features.drop_incomplete(df, ["y"], policy="drop").count() == 1


def test_null_entity_keys_are_an_entity_of_their_own(spark):
    v = [1.0, None, ..., 4.0, None, None, 7.0] * 4
    df = series(spark, v).unionByName(series(spark, v, unit=None))
    out = pdf(blocks.row_position(df, KEY, "ts"), "ts")
    assert len(out) == 48 and sorted(out[out.unit.isna()]["_pos"]) == list(range(24))
    filled = pdf(windows.ffill(blocks.row_position(df, KEY, "ts"), KEY, ["value"]), "ts")
    close(filled[filled.unit.isna()]["value"], filled[filled.unit == "a"]["value"])
    grid = quality.regular_grid(df, KEY, "ts")
    assert grid.where("unit is null and value is not null").count() == grid.where("unit = 'a' and value is not null").count() == 12


def test_nan_counts_as_missing_in_bounds_and_quantiles(spark):
    from plantlens.operators import quantiles

    with_nan, without = [1.0, 2.0, float("nan"), 3.0, 90.0] * 5, [1.0, 2.0, None, 3.0, 90.0] * 5
    one, two = series(spark, with_nan), series(spark, without)
    close(pdf(quality.clip_sigma(one, ["value"], KEY), "ts")["value"], pdf(quality.clip_sigma(two, ["value"], KEY), "ts")["value"])
    assert quantiles.exact(one, KEY, ["value"], [0.25, 0.5]).collect() == quantiles.exact(two, KEY, ["value"], [0.25, 0.5]).collect()


def test_order_by_stamp_below_the_step(spark):
    """Ten-minute rows share an hour's position; gaps and interpolation follow the stamps."""
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=10 * i), None if i % 5 == 2 else float(i)) for i in range(300)]
    random.Random(3).shuffle(rows)
    df = blocks.slot_position(spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double").repartition(5), "ts")
    assert [tuple(r) for r in windows.gap_profile(df, ["k"], "ts").collect()] == [("a", 1, 600)]
    got = windows.interpolate(df, ["k"], "ts", ["v"]).orderBy("ts").collect()
    assert [r["v"] for r in got] == pytest.approx([float(i) for i in range(300)])


def test_sliding_at_the_series_own_step(spark):
    """Rows every two hours and every ten minutes in one table, each at its own step."""
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m * i), float(i + 1)) for k, m in (("slow", 120), ("fast", 10)) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    got = features.sliding(df, keys=["k"], ts="ts", targets=["v"], windows_=(4, 8), horizon=3, null_policy="drop").orderBy("k", "ts").collect()
    assert [(r["k"], r["v"]) for r in got] == [(k, float(i + 1)) for k in ("fast", "slow") for i in range(8, 117)]
    for r in got:
        assert r["v_mean_8h"] == r["v"] - 3.5 and r["v_diff_4h"] == 4 and r["v_target_3h"] == r["v"] + 3
