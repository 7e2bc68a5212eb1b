"""End-to-end data set builds: series to features, splits and stored outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions import text as tf
from plantlens.operators import features, quality, reduce, spectrum, split, stats, text, vectors, windows
from plantlens.operators.blocks import POS, slot_position
from plantlens.sources import writers

OUTPUTS = ("window", "statistics", "frequency", "components", "model_input")


def process_series(
    series: DataFrame, out: str, *, keys: Sequence[str], ts: str, targets: Sequence[str], windows_: Sequence[int] = (24, 48, 72),
    horizon: int = 24, variance: float = 0.95,
) -> dict[str, str]:
    """Window features, daily statistics, frequencies, components and a split model input, each as Parquet.

    The window table is written once and read back by the later steps, so nothing upstream is recomputed.
    """
    spark, keys = series.sparkSession, list(keys)
    paths = {name: f"{out}/{name}" for name in OUTPUTS}
    features.sliding(series, keys=keys, ts=ts, targets=targets, windows_=windows_, horizon=horizon, null_policy="drop").write.parquet(paths["window"])
    rows = spark.read.parquet(paths["window"])
    stats.by_period(series, keys=keys, ts=ts, cols=targets, period="day").write.parquet(paths["statistics"])
    grid = windows.interpolate(slot_position(quality.regular_grid(series, keys, ts), ts), keys, ts, targets).drop(POS)
    spectrum.top_frequencies(grid, keys=keys, ts=ts, cols=targets).write.parquet(paths["frequency"])
    target_cols = features.target_columns(rows)
    inputs = quality.numeric_columns(rows, [*keys, ts, *target_cols])
    components, _ = reduce.pca(rows, inputs, keep=[*keys, ts, *target_cols], variance=variance)
    components.write.parquet(paths["components"])
    keyed = rows.withColumn("row_key", F.concat_ws("|", *keys, F.col(ts).cast("string")))
    writers.write_dataset(split.random(keyed, key="row_key", targets=target_cols, features=inputs), paths["model_input"])
    return paths


def process_texts(df: DataFrame, *, id_col: str, text_col: str, size: int = 64, k: int = 5) -> DataFrame:
    """Normalised text, embedding, keywords and sentiment of every text."""
    clean = df.withColumn("processed_text", tf.normalise(F.col(text_col)))
    out = text.keywords(text.sentiment(clean, "processed_text"), id_col=id_col, text="processed_text", k=k)
    return out.join(vectors.embed(clean, id_col=id_col, text="processed_text", dims=size), id_col)
