"""Forecast metrics, comparison, ensembles and monitoring over prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.operators.blocks import attach
from plantlens.operators.stats import histogram


def metrics(pred: DataFrame, *, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    """mse, rmse, mae and r2 per group from one aggregation (total variation is n x population variance)."""
    e = F.col(y) - F.col(yhat)
    sums = pred.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("_var")
    )
    r2 = F.when(F.col("_var") > 0, 1 - F.col("mse") / F.col("_var")).when(F.col("mse") == 0, 1.0).otherwise(0.0)
    return sums.select(*by, "n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))


def overall(per_target: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over targets of mse, mae and r2; rmse is the root of the mean mse."""
    out = per_target.groupBy(*by).agg(F.avg("mse").alias("mse"), F.avg("mae").alias("mae"), F.avg("r2").alias("r2"))
    return out.select(*by, "mse", F.sqrt("mse").alias("rmse"), "mae", "r2")


def best(results: DataFrame, by: str = "model") -> DataFrame:
    return results.orderBy("rmse", by).limit(1)


def ensemble(pred: DataFrame, *, keys: Sequence[str], weights: DataFrame | None = None, model: str = "model",
             yhat: str = "yhat") -> DataFrame:
    """Weighted mean of the models' predictions per row; equal weights when none are given.

    There is one weight per model, a handful of rows, so the predictions are not shuffled by model.
    """
    w = F.col("weight") if weights is not None else F.lit(1.0)
    rows = attach(pred, weights.select(model, "weight"), [model]) if weights is not None else pred
    return rows.groupBy(*keys).agg((F.sum(w * F.col(yhat)) / F.sum(w)).alias(yhat))


def r2_weights(results: DataFrame, model: str = "model") -> DataFrame:
    """Weights proportional to R2; equal when the R2 sum is not positive. One row per model."""
    every = Window.partitionBy()
    total, n = F.sum("r2").over(every), F.count("*").over(every)
    return results.select(model, F.when(total > 0, F.col("r2") / total).otherwise(1 / n).alias("weight"))


def drift(current: DataFrame, history: DataFrame, *, by: Sequence[str] = ("model",), threshold: float = 0.2) -> DataFrame:
    """(rmse - best) / best against the best rmse on record; retrain above the threshold."""
    record = history.groupBy(*by).agg(F.min("rmse").alias("best_rmse"))
    change = F.when(F.col("best_rmse") > 0, (F.col("rmse") - F.col("best_rmse")) / F.col("best_rmse"))
    return (
        current.join(record, list(by), "left").withColumn("change", change)
        .withColumn("retrain", F.coalesce(F.col("change") > threshold, F.lit(False)))
    )


def ab_score(pred: DataFrame, *, y: str, yhat: str, model: str = "model", day: str = "day",
             weights: tuple[float, float, float] = (0.1, 0.6, 0.3)) -> DataFrame:
    """Score per model: daily metrics averaged over the days, then w0 r2 - w1 rmse - w2 mae."""
    daily = metrics(pred, y=y, yhat=yhat, by=[model, day])
    avg = daily.groupBy(model).agg(*[F.avg(c).alias(c) for c in ("rmse", "mae", "r2")])
    a, b, c = weights
    return avg.withColumn("score", F.col("r2") * a - F.col("rmse") * b - F.col("mae") * c)


def improvement(before: DataFrame, after: DataFrame, on: Sequence[str]) -> DataFrame:
    """Percentage change of each metric; positive is better (r2 grows, errors shrink)."""
    a, b = before.alias("a"), after.alias("b")
    joined = a.join(b, list(on))

    def pct(num, den):
        return F.when(den != 0, num / F.abs(den) * 100)

    return joined.select(
        *on,
        *[pct(F.col(f"a.{m}") - F.col(f"b.{m}"), F.col(f"a.{m}")).alias(f"{m}_improvement") for m in ("rmse", "mae")],
        pct(F.col("b.r2") - F.col("a.r2"), F.col("a.r2")).alias("r2_improvement"),
    )


def residual_histogram(pred: DataFrame, *, y: str, yhat: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Histogram of y - yhat, in the same layout as ``stats.histogram``."""
    return histogram(pred.select(*by, (F.col(y) - F.col(yhat)).alias("residual")), "residual", bins, by)
