"""Cleaning, gridding and scaling, including the edge cases."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantlens.operators import quality, quantiles, stats
from plantlens.sources import readers, schemas, writers
from tests.helpers import START, close, pdf, series

KEY = ["unit"]
RAW = """RECTIME,SO2,NOx
数据描述,二氧化硫,氮氧化物
2023/01/01 00:00,45.2,120.5
2023/01/01 01:00,-,118.0
2023/01/01 02:00,40.0,121.5
"""


def test_grid_keeps_offset_drops_off_grid_and_opens_gaps(spark):
    t = datetime(2024, 1, 1, 0, 10)
    rows = [("a", t, 1.0), ("a", t + timedelta(minutes=60), 2.0), ("a", t + timedelta(minutes=95), 9.0), ("a", t + timedelta(minutes=180), 4.0)]
    out = pdf(quality.regular_grid(spark.createDataFrame(rows, "unit string, ts timestamp_ntz, value double"), KEY, "ts"), "ts")
    assert out["ts"].dt.minute.tolist() == [10] * 4
    close(out["value"], [1.0, 2.0, np.nan, 4.0])


def test_grid_crosses_block_borders(spark):
    out = quality.regular_grid(series(spark, [1.0] + [...] * 98 + [2.0]), KEY, "ts")
    assert out.count() == 100 and out.select("ts").distinct().count() == 100


def _clean_pandas(v):
    s = pd.Series(v, dtype=float)
    if s.isna().mean() < 0.30:
        s = s.ffill().bfill()
    return s.clip(s.mean() - 3 * s.std(), s.mean() + 3 * s.std()) if s.count() > 1 else s


@pytest.mark.parametrize("values", [
    [None, 1.0, 2.0, None, 3.0, 2.0, 1.0, 500.0] + [2.0] * 20,
    [None] * 3 + [float(i) for i in range(7)],
    [7.0] * 12,
    [5.0],
    [None] * 6,
], ids=["outlier", "exactly 30 percent", "constant", "single", "all null"])
def test_clean_series_equals_pandas(spark, values):
    out = pdf(quality.clean_series(series(spark, values), keys=KEY, ts="ts", cols=["value"]), "ts")
    close(out["value"], _clean_pandas(values))


def test_clean_table_fills_median_and_smallest_mode(spark):
    df = spark.createDataFrame([(1.0, "b"), (3.0, "a"), (None, None), (10.0, "b"), (4.0, "a")], "x double, s string")
    out = quality.clean_table(df)
    rows = [tuple(r) for r in out.collect()]
    assert (3.5, "a") in rows


@pytest.mark.parametrize("n", [1, 2, 3, 50, 2500])
def test_exact_quantiles_equal_numpy(spark, n):
    v = np.random.default_rng(n).exponential(10, n).round(2)
    df = spark.createDataFrame([(float(x), i % 2) for i, x in enumerate(v)], "x double, g int")
    got = {(r["g"], r["p"]): r["value"] for r in quantiles.exact(df, ["g"], ["x"], [0.25, 0.5, 0.75]).collect()}
    for g in {i % 2 for i in range(n)}:
        part = v[np.arange(n) % 2 == g]
        for p in (0.25, 0.5, 0.75):
            assert abs(got[(g, p)] - np.quantile(part, p)) < 1e-9


def test_exact_quantiles_of_a_large_group_use_brackets(spark):
    n = 300_000
    df = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("x"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") / 11.0).alias("tied"))
    sample = df.toPandas()
    got = {(r["col"], r["p"]): r["value"] for r in quantiles.exact(df, [], ["x", "tied"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for c in ("x", "tied"):
        for p in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert abs(got[(c, p)] - np.quantile(sample[c], p)) < 1e-6


def test_ungrouped_quantiles_do_not_shuffle_rows_by_column(spark):
    df = spark.range(5000).select((F.col("id") * 0.5).alias("x"), (F.col("id") % 7).alias("y"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = quantiles.exact(df, [], ["x", "y"], [0.5])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert {r["col"]: r["value"] for r in found.collect()} == {"x": 1249.75, "y": 3.0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_scalers_round_trip_and_constant_columns(spark):
    df = series(spark, [1.0, 2.0, 6.0]).unionByName(series(spark, [4.0, 4.0], unit="b"))
    scaler = quality.fit_scaler(df, ["value"], "standard", KEY)
    z = quality.apply_scaler(df, scaler, ["value"], KEY)
    assert set(r["value"] for r in z.filter("unit = 'b'").collect()) == {0.0}
    close(pdf(quality.invert_scaler(z, scaler, ["value"], KEY), "unit", "ts")["value"], [1.0, 2.0, 6.0, 4.0, 4.0])
    flat = quality.apply_scaler(df, quality.fit_scaler(df.filter("unit = 'b'"), ["value"], "minmax"), ["value"])
    assert set(r["value"] for r in flat.filter("unit = 'b'").collect()) == {0.0}


def test_statistics_match_pandas(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, 60).tolist() + [2.0] * 12
    df = series(spark, v)
    s = pd.Series(v, index=pd.date_range("2024-01-01", periods=len(v), freq="h"))
    out = pdf(stats.by_period(df, keys=KEY, ts="ts", cols=["value"], period="day"), "day")
    groups = [g for _, g in s.groupby(s.index.date)]
    for name, fn in (("mean", "mean"), ("std", "std"), ("median", "median"), ("skew", "skew"), ("kurt", "kurt")):
        close(out[f"value_{name}"], [getattr(g, fn)() for g in groups], 1e-8)
    merged = pdf(stats.by_period(df, keys=KEY, ts="ts", cols=["value"], period="month", merge_years=True))
    close(merged["value_q25"], [s.quantile(0.25)])


def test_constant_group_has_zero_skew_and_kurtosis(spark):
    row = stats.by_period(series(spark, [3.0] * 6), keys=KEY, ts="ts", cols=["value"], period="day").first()
    assert (row["value_skew"], row["value_kurt"]) == (0.0, 0.0)


def test_description_row_in_each_file(spark, tmp_path):
    for n in ("one.csv", "two.csv"):
        (tmp_path / n).write_text(RAW, encoding="utf-8")
    rows, rejects = readers.read_emissions_csv(spark, str(tmp_path), ("SO2", "NOx"))
    assert rows.count() == 6 and rows.filter("SO2 is null").count() == 2
    assert {r["file"]: r["rejected"] for r in rejects.collect()} == {"one.csv": 1, "two.csv": 1}


def test_bad_stamp_is_flagged(spark, tmp_path):
    (tmp_path / "s.txt").write_text("time\ta\tb\n2023/01/01 00:00\t1\t-\nnonsense\t2\t3\n", encoding="utf-8")
    rows = pdf(readers.read_series_tsv(spark, str(tmp_path), ["a", "b"]), "a")
    assert rows[readers.REJECT].tolist() == [False, True] and pd.isna(rows["b"][0])


def test_cleaned_and_scaled_file_equals_population_scaling(spark, tmp_path):
    rng = np.random.default_rng(11)
    table = pd.DataFrame({c: rng.normal(50, 9, 24).round(1) for c in schemas.EMISSION_METRICS})
    stamps = pd.date_range("2023-01-01", periods=24, freq="h").strftime("%Y/%m/%d %H:%M")
    lines = [",".join(["RECTIME", *table.columns]), ",".join(["数据描述"] * 9)]
    lines += [",".join([t, *map(str, r)]) for t, r in zip(stamps, table.to_numpy())]
    (tmp_path / "e.csv").write_text("\n".join(lines), encoding="utf-8")
    rows, rejects = readers.read_emissions_csv(spark, str(tmp_path))
    assert rejects.first()["rejected"] == 1
    cols = list(table.columns)
    clean = quality.clean_table(rows.drop("file"), numeric=cols, strings=[])
    got = pdf(quality.apply_scaler(clean, quality.fit_scaler(clean, cols), cols), "ts")
    clipped = table.clip(table.mean() - 3 * table.std(), table.mean() + 3 * table.std(), axis=1)
    for c in cols:
        close(got[c], (clipped[c] - clipped[c].mean()) / clipped[c].std(ddof=0))


def test_upsert_last_writer_wins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "new"), (3, "z")], "k int, v string")
    assert {tuple(r) for r in writers.upsert(a, b, ["k"]).collect()} == {(1, "x"), (2, "new"), (3, "z")}


def test_key_checks(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, None)], "k int, ref int")
    assert [r["k"] for r in quality.duplicate_keys(df, ["k"]).collect()] == [1]
    parent = spark.createDataFrame([(5,)], "id int")
    assert [r["ref"] for r in quality.orphans(df, parent, "ref", "id").collect()] == [6]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert quality.nan_to_null(df).agg(F.avg("x")).first()[0] == 1.0


def test_missing_profile_of_empty_frame(spark):
    assert quality.missing_profile(series(spark, []), ["value"]).first()["missing_pct"] == 0.0
    assert START.year == 2024
