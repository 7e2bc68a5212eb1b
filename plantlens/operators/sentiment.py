"""Sentiment as a classifier: hashed words, a linear model of all labelled rows, two cuts calibrated on all of them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions import text as tf
from plantlens.session import staged

FOLDS = 5  # parts of the labelled rows, by text; for the cuts each is scored by a model of the others
DIMS = 1 << 14
PRECISION = 0.9  # wanted of either outer label on the calibration part
POSITIVE, NEUTRAL, NEGATIVE = "正面", "中性", "负面"
STEPS = 1000  # scores are told apart to this fraction when the cuts are set


@dataclass
class Sentiment:
    """A fitted model; scores of ``high`` or more are positive, of ``low`` or less negative, what lies between neutral."""

    model: PipelineModel
    low: float
    high: float


def _features(df: DataFrame, text: str) -> DataFrame:
    """Words and pairs of neighbours, once each."""
    words = F.col("__list")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    both = F.array_distinct(F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))))
    return df.withColumn("__list", tf.tokens(F.col(text))).withColumn("__words", both).drop("__list")  # cut once, used often


def _scored(model: PipelineModel, df: DataFrame, text: str, out: str) -> DataFrame:
    found = model.transform(_features(df, text)).withColumn(out, F.when(F.size("__words") > 0, vector_to_array("__probability")[1]))
    return found.drop("__words", "__tf", "__raw", "__probability", "__prediction")


def _held_out(rows: DataFrame, models: dict[int, LogisticRegressionModel]) -> DataFrame:
    """(label, score) of every row, scored by the model that is given for its fold."""
    parts = [m.transform(rows.where(F.col("fold") == k)).select("label", vector_to_array("__probability")[1].alias("score")) for k, m in models.items()]
    return reduce(DataFrame.union, parts)


def fit(df: DataFrame, *, text: str, label: str, precision: float = PRECISION, seed: int = 42) -> Sentiment:
    """A model from labelled texts: ``label`` is 1 for positive, 0 for negative, null rows are left out.

    All rows fit the model. All rows calibrate too, each scored by a model of the folds that do not hold its text:
    ``high`` is the least score above which the wanted share is positive, ``low`` the greatest below which it is negative;
    where no score reaches it, the outermost score seen stands in. One class alone gives a model that knows just that class.
    """
    known = df.where(F.col(label).isNotNull() & tf.not_blank(F.col(text))).select(F.col(text).alias("text"), F.col(label).cast("double").alias("label"))
    known = known.withColumn("fold", F.pmod(F.xxhash64(F.xxhash64(F.lit(seed), "text")), F.lit(FOLDS)))
    hashed = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=DIMS, binary=True)
    line = LogisticRegression(featuresCol="__tf", labelCol="label", probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction", regParam=0.01, maxIter=30)
    rows = staged(hashed.transform(_features(known, "text")).select("label", "fold", "__tf", (F.size("__words") > 0).alias("worded")), "labelled")
    folds = sorted(r["fold"] for r in rows.select("fold").distinct().collect())  # FOLDS rows at most
    if not folds:
        raise ValueError("there are no labelled texts")
    whole = line.fit(rows)
    counted = _held_out(rows.where("worded"), {k: line.fit(rows.where(F.col("fold") != k)) if len(folds) > 1 else whole for k in folds})
    counted = counted.groupBy(F.floor(F.col("score") * STEPS).alias("step")).agg(F.sum("label").alias("good"), F.count("*").alias("n"))
    bins = sorted((r["step"], r["good"], r["n"]) for r in counted.collect())  # STEPS + 1 rows at most

    def cut(order: list[tuple], good) -> float | None:
        seen = right = 0
        best = None
        for step, pos, m in order:
            seen, right = seen + m, right + good(pos, m)
            if right >= precision * seen:
                best = step
        return best

    high, low = cut(bins[::-1], lambda pos, m: pos), cut(bins, lambda pos, m: m - pos)
    high = (bins[-1][0] if bins else STEPS) if high is None else high
    low = (bins[0][0] if bins else 0) if low is None else low
    if low >= high:  # both precisions hold in between, so the middle parts them
        low = high = (low + high) / 2
    return Sentiment(PipelineModel([hashed, whole]), (low + 1) / STEPS if low < high else low / STEPS, high / STEPS)


def classify(df: DataFrame, fitted: Sentiment, *, text: str, out: str = "sentiment", score: str = "score") -> DataFrame:
    """``df`` with the score and the label of every row; blank and null texts have no score and are neutral."""
    found = _scored(fitted.model, df, text, score)
    label = F.when(F.col(score) >= fitted.high, POSITIVE).when(F.col(score) < fitted.low, NEGATIVE).otherwise(NEUTRAL)
    return found.withColumn(out, label)
