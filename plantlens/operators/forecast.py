"""Forecasters as Spark ML pipelines: one model per target, three families."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.operators import evaluate, split
from plantlens.session import staged

FAMILIES = ("linear", "forest", "boosted")


def estimator(family: str, target: str, **params):
    common = dict(featuresCol="_features", labelCol=target, predictionCol=f"{target}_pred")
    if family == "linear":
        return LinearRegression(**common, **params)
    if family == "forest":
        return RandomForestRegressor(**common, **{"seed": 42, "numTrees": 20, **params})
    if family == "boosted":
        return GBTRegressor(**common, **{"seed": 42, "maxIter": 20, **params})
    raise ValueError(f"unknown family {family!r}")


def fit(df: DataFrame, *, features: Sequence[str], targets: Sequence[str], family: str = "linear", **params) -> PipelineModel:
    """One pipeline predicting every target from the same feature vector."""
    pack = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip")
    return Pipeline(stages=[pack, *[estimator(family, t, **params) for t in targets]]).fit(df)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Every row of ``df`` with its predictions; null where a feature is null or NaN."""
    pack = model.stages[0]
    whole = F.lit(True)
    for c in pack.getInputCols():
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    kept = PipelineModel([pack.copy().setHandleInvalid("keep"), *model.stages[1:]])
    names = [m.getPredictionCol() for m in model.stages[1:]]
    return kept.transform(df).withColumns({p: F.when(whole, F.col(p)) for p in names}).drop("_features")


def long_predictions(pred: DataFrame, targets: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """keep, target, y, yhat: the input layout of ``evaluate.metrics``."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y"), F.col(f"{t}_pred").alias("yhat")) for t in targets
    ])).alias("p")
    return pred.select(*keep, rows).select(*keep, "p.*")


def save(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def tune(
    df: DataFrame, *, features: Sequence[str], target: str, family: str = "forest", grid: dict[str, Sequence], parallelism: int = 4,
    train_ratio: float = 0.8,
):
    """Grid search on one train/validation split; returns (best model, results as a frame).

    Trainers pass over their input many times, so the columns in use are written once and read back.
    """
    df = staged(df.select(*features, target), "tune")
    est = estimator(family, target)
    pack = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip")
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(est, name), list(values))
    maps = builder.build()
    search = TrainValidationSplit(
        estimator=Pipeline(stages=[pack, est]), estimatorParamMaps=maps, trainRatio=train_ratio, parallelism=parallelism, seed=42,
        evaluator=RegressionEvaluator(labelCol=target, predictionCol=f"{target}_pred", metricName="rmse"),
    ).fit(df)
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda x: x[0].name)), float(r))
        for m, r in zip(maps, search.validationMetrics)
    ]
    return search.bestModel, df.sparkSession.createDataFrame(rows, "params string, rmse double")


def time_folds(df: DataFrame, ts: str, folds: int = 3) -> list:
    """``folds`` + 2 stamps that cut the rows into ``folds`` + 1 parts of about equal size, oldest first."""
    shares = [i / (folds + 1) for i in range(folds + 2)]
    return df.agg(F.percentile_approx(F.col(ts).cast("timestamp_ntz").cast("timestamp").cast("double"), shares, 100_000).alias("p")).first()["p"] or []


def halving(
    df: DataFrame, *, features: Sequence[str], target: str, ts: str, family: str = "forest", grid: dict[str, Sequence], folds: int = 3,
    factor: int = 3, parallelism: int = 4,
) -> tuple[PipelineModel, DataFrame]:
    """Search of the full grid by successive halving on expanding time-ordered folds; returns (best model, every trial).

    Fold i fits on all rows up to the i-th cut in time and validates on those after it up to the next. The first rung
    tries every combination on the first fold; each rung keeps the best 1 / ``factor`` of them, at least one, and
    adds the next, longer fold, so most fits see the shortest history. A combination is judged by its mean error over
    the folds it was tried on, ties by its place in the grid; the best is refitted on all rows. Trials:
    (rung, fold, params, rmse, kept). Rows with a null among the inputs are left out.
    """
    rows = df.select(*features, target, F.col(ts).cast("timestamp_ntz").cast("timestamp").cast("double").alias("_at")).dropna("any")
    rows = staged(rows, "halving")
    cuts = time_folds(rows.withColumn("_ts", F.timestamp_seconds("_at")), "_ts", folds)
    if not cuts:
        raise ValueError("there are no complete rows")
    pack = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip")
    names = sorted(grid)
    combos = [dict(zip(names, values)) for values in product(*(grid[n] for n in names))]
    judge = RegressionEvaluator(labelCol=target, predictionCol=f"{target}_pred", metricName="rmse")
    alive, errors, trials = list(range(len(combos))), {i: [] for i in range(len(combos))}, []

    def trial(i: int, train: DataFrame, valid: DataFrame) -> float:
        found = estimator(family, target, **combos[i]).fit(train)
        return float(judge.evaluate(found.transform(valid)))

    for rung in range(folds):
        packed = pack.transform(rows.where(F.col("_at") <= cuts[rung + 2])).select("_features", target, "_at")
        train = packed.where(F.col("_at") <= cuts[rung + 1]).persist()
        valid = packed.where(F.col("_at") > cuts[rung + 1]).persist()
        try:
            if not (train.isEmpty() or valid.isEmpty()):
                with ThreadPoolExecutor(parallelism) as pool:
                    for i, rmse in zip(alive, pool.map(lambda i: trial(i, train, valid), alive)):
                        errors[i].append(rmse)
        finally:
            train.unpersist()
            valid.unpersist()
        order = sorted(alive, key=lambda i: (sum(errors[i]) / len(errors[i]) if errors[i] else 0.0, i))
        kept = order[: max(1, -(-len(alive) // factor))] if rung < folds - 1 else order[:1]
        trials += [(rung, rung, ", ".join(f"{n}={combos[i][n]}" for n in names), errors[i][-1] if errors[i] else None, i in kept) for i in alive]
        alive = kept
    best = Pipeline(stages=[pack, estimator(family, target, **combos[alive[0]])]).fit(rows)
    return best, df.sparkSession.createDataFrame(trials, "rung int, fold int, params string, rmse double, kept boolean")


def compare(
    df: DataFrame, *, keys: Sequence[str], ts: str, features: Sequence[str], targets: Sequence[str],
    families: Sequence[str] = FAMILIES,
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Chronological split, fit each family on the oldest part, score on the newest."""
    parts = staged(split.chronological(df, keys=keys, ts=ts).select(*keys, ts, *features, *targets, "split"), "compare")
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    models, tables = {}, []
    for fam in families:
        models[fam] = fit(train, features=features, targets=targets, family=fam)
        pred = long_predictions(predict(models[fam], test), targets)
        per_target = evaluate.metrics(pred, y="y", yhat="yhat", by=["target"])
        tables.append(evaluate.overall(per_target).withColumn("model", F.lit(fam)))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return models, out


def update_job(
    current: PipelineModel, new_data: DataFrame, history: DataFrame, *, features: Sequence[str], target: str, ts: str,
    keys: Sequence[str], family: str = "linear", threshold: float = 0.2,
) -> tuple[PipelineModel, DataFrame]:
    """Score the current model, refit when it drifted, compare on daily scores, promote the better one.

    Returns (promoted model, one registry row).
    """
    parts = staged(split.chronological(new_data, keys=keys, ts=ts).select(*keys, ts, *features, target, "split"), "update")
    recent = parts.filter("split = 'test'")

    def scored(model, name):
        p = long_predictions(predict(model, recent), [target], keep=[ts])
        return p.withColumns({"model": F.lit(name), "day": F.to_date(ts)})

    now = evaluate.metrics(scored(current, "current"), y="y", yhat="yhat", by=["model"])
    check = evaluate.drift(now, history, threshold=threshold).first()
    promoted, version, scores = current, "current", {}
    if check["retrain"]:
        candidate = fit(parts.filter("split <> 'test'"), features=features, targets=[target], family=family)
        both = scored(current, "current").unionByName(scored(candidate, "candidate"))
        scores = {r["model"]: r["score"] for r in evaluate.ab_score(both, y="y", yhat="yhat").collect()}
        if scores["candidate"] > scores["current"]:
            promoted, version = candidate, "candidate"
    row = (version, float(check["rmse"]), bool(check["retrain"]), scores.get("current"), scores.get("candidate"))
    registry = new_data.sparkSession.createDataFrame(
        [row], "promoted string, current_rmse double, retrained boolean, current_score double, candidate_score double"
    )
    return promoted, registry
