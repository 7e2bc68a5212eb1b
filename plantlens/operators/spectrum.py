"""Frequency content of gap-free series, as a transform split into two short stages.

A series of n = P x Q rows is cut into P interleaved parts of Q rows. Each part is transformed on its own,
turned by its phase, regrouped by output offset and transformed across the parts. No task ever holds more
than Q values of one series (about sqrt(n) when n has a divisor near its root).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.operators import blocks


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _part_transform(values: pd.Series, part: pd.Series, n: pd.Series) -> pd.Series:
    """Transform of one interleaved part with its phase turn, as re, im, re, im, ..."""
    out = []
    for v, a, size in zip(values, part, n):
        y = np.fft.fft(np.asarray(v, dtype=float))
        y = y * np.exp(-2j * np.pi * a * np.arange(len(y)) / size)
        out.append(np.column_stack([y.real, y.imag]).ravel())
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _across_parts(re: pd.Series, im: pd.Series) -> pd.Series:
    return pd.Series([np.abs(np.fft.fft(np.asarray(r) + 1j * np.asarray(i))) for r, i in zip(re, im)])


def magnitudes(df: DataFrame, *, keys: Sequence[str], ts: str, cols: Sequence[str], step_seconds: int = 3600) -> DataFrame:
    """keys, col, n, bin, magnitude for bins 1 .. n//2 - 1. The series must be on its grid without gaps."""
    keys = list(keys)
    series = [*keys, "col"]
    placed = blocks.slot_position(df.select(*keys, ts, *cols), ts, step_seconds)
    span = placed.groupBy(*keys).agg(F.min(blocks.POS).alias("_first"), F.count("*").alias("n"))
    span = span.withColumn("parts", F.array_max(F.filter(
        F.sequence(F.lit(1), F.floor(F.sqrt(F.col("n"))).cast("int")), lambda d: F.col("n") % d == 0)))
    long = blocks.attach(placed, span, keys).select(
        *keys, "n", "parts", (F.col(blocks.POS) - F.col("_first")).alias("t"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("x")) for c in cols])).alias("s"),
    ).select(*keys, "n", "parts", "t", "s.*")
    first = (
        long.groupBy(*series, "n", "parts", (F.col("t") % F.col("parts")).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("t", F.coalesce("x", F.lit(float("nan"))).alias("x")))).alias("rows"))
        .select(*series, "n", "parts", "part", _part_transform(F.col("rows.x"), F.col("part"), F.col("n")).alias("y"))
    )
    spread = first.select(
        *series, "n", "parts", "part", "y", F.explode(F.sequence(F.lit(0), (F.size("y") / 2).cast("int") - 1)).alias("offset")
    ).select(
        *series, "n", "parts", "part", "offset",
        F.get("y", F.col("offset") * 2).alias("re"), F.get("y", F.col("offset") * 2 + 1).alias("im"),
    )
    second = (
        spread.groupBy(*series, "n", "parts", "offset")
        .agg(F.array_sort(F.collect_list(F.struct("part", "re", "im"))).alias("rows"))
        .select(*series, "n", "parts", "offset", _across_parts(F.col("rows.re"), F.col("rows.im")).alias("m"))
    )
    stride = (F.col("n") / F.col("parts")).cast("long")
    return (
        second.select(*series, "n", "parts", "offset", F.posexplode("m").alias("c", "magnitude"))
        .select(*series, "n", (stride * F.col("c") + F.col("offset")).alias("bin"), "magnitude")
        .filter((F.col("bin") >= 1) & (F.col("bin") < F.floor(F.col("n") / 2)))
    )


def top_frequencies(
    df: DataFrame, *, keys: Sequence[str], ts: str, cols: Sequence[str], top_k: int = 5, step_seconds: int = 3600
) -> DataFrame:
    """The ``top_k`` strongest bins per entity and column, strongest first."""
    mags = magnitudes(df, keys=keys, ts=ts, cols=cols, step_seconds=step_seconds)
    w = Window.partitionBy(*keys, "col").orderBy(F.col("magnitude").desc(), "bin")
    return mags.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
