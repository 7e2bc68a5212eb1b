from datetime import datetime, timedelta

import pandas as pd

START = datetime(2024, 1, 1)


def series(spark, values, unit="a", start=START, step=3600, column="value"):
    """(unit, ts, value) rows; a value of '...' leaves the stamp out."""
    rows = [(unit, start + timedelta(seconds=i * step), v) for i, v in enumerate(values) if v is not ...]
    return spark.createDataFrame(rows, f"unit string, ts timestamp_ntz, {column} double")


def pdf(df, *order):
    return df.toPandas().sort_values(list(order) or list(df.columns)).reset_index(drop=True)


def close(a, b, tol=1e-9):
    a, b = pd.Series(list(a), dtype=float), pd.Series(list(b), dtype=float)
    assert len(a) == len(b)
    assert (a.isna() == b.isna()).all(), (a.tolist(), b.tolist())
    assert ((a - b).abs().fillna(0) <= tol * (1 + b.abs().fillna(0))).all(), (a.tolist(), b.tolist())
