"""Dimension reduction: principal components and univariate selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pca(df: DataFrame, cols: Sequence[str], *, keep: Sequence[str] = (), variance: float = 0.95) -> tuple[DataFrame, list[float]]:
    """Components explaining more than ``variance`` of the total, beside the ``keep`` columns.

    Spark's projection is not centred, so the input is. Only a d x d matrix reaches the driver.
    """
    packed = VectorAssembler(inputCols=list(cols), outputCol="_raw").transform(df.dropna("any", subset=list(cols)))
    centre = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=False).fit(packed)
    model = PCA(k=len(cols), inputCol="_x", outputCol="_pc").fit(centre.transform(packed))
    ratios = [float(v) for v in model.explainedVariance.toArray()]
    total, k = 0.0, 0
    while k < len(ratios) and total <= variance:
        total += ratios[k]
        k += 1
    parts = vector_to_array("_pc")
    out = model.transform(centre.transform(packed)).select(*keep, *[parts[i].alias(f"PC{i + 1}") for i in range(k)])
    return out, ratios[:k]


def f_scores(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """F = r^2 / (1 - r^2) x (n - 2) of every feature against the target, from one aggregation."""
    row = df.agg(F.count("*").alias("_n"), *[F.corr(c, target).alias(c) for c in features])
    cells = []
    for c in features:
        r2 = F.col(c) * F.col(c)
        cells.append(F.struct(F.lit(c).alias("feature"), F.col(c).alias("r"),
                              F.when(r2 < 1, r2 / (1 - r2) * (F.col("_n") - 2)).otherwise(F.lit(float("inf"))).alias("f")))
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def select_k_best(df: DataFrame, features: Sequence[str], targets: Sequence[str], k: int) -> tuple[DataFrame, list[str]]:
    """The k features with the highest score against the first target, in their original order."""
    top = {r["feature"] for r in f_scores(df, features, targets[0]).orderBy(F.desc("f"), "feature").limit(k).collect()}
    chosen = [c for c in features if c in top]
    return df.select(*chosen, *targets), chosen
