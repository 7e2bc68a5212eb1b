"""Successive halving against an exhaustive search, and the sentiment model against the word list."""

import itertools
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from plantlens.operators import forecast, sentiment, text


@pytest.fixture(scope="module")
def series(spark):
    r = np.random.default_rng(2)
    a, b = r.normal(size=240), r.normal(size=240)
    y = 3 * a - b + 0.1 * r.normal(size=240)
    rows = [(datetime(2024, 1, 1) + timedelta(hours=i), float(a[i]), float(b[i]), float(y[i])) for i in range(240)]
    return spark.createDataFrame([*rows, (datetime(2024, 3, 1), None, 1.0, 2.0)], "ts timestamp_ntz, a double, b double, y double").repartition(3)


GRID = {"regParam": [5.0, 0.0, 0.5], "elasticNetParam": [0.0, 1.0]}


def test_halving_picks_what_an_exhaustive_search_picks(series):
    model, trials = forecast.halving(series, features=["a", "b"], target="y", ts="ts", family="linear", grid=GRID)
    rows = trials.collect()
    assert [sum(r["rung"] == i for r in rows) for i in range(3)] == [6, 2, 1]
    assert [sum(r["kept"] and r["rung"] == i for r in rows) for i in range(3)] == [2, 1, 1]
    data = sorted(tuple(r) for r in series.dropna().collect())
    cuts = forecast.time_folds(series.dropna(), "ts")
    assert len(cuts) == 5 and cuts == sorted(cuts)
    pack = VectorAssembler(inputCols=["a", "b"], outputCol="_features")
    full = pack.transform(series.dropna().withColumn("at", F.col("ts").cast("timestamp").cast("double")))
    scores = {}
    for e, reg in itertools.product(GRID["elasticNetParam"], GRID["regParam"]):
        errors = []
        for i in range(3):
            train, valid = full.where(F.col("at") <= cuts[i + 1]), full.where((F.col("at") > cuts[i + 1]) & (F.col("at") <= cuts[i + 2]))
            assert train.agg(F.max("at")).first()[0] < valid.agg(F.min("at")).first()[0] and valid.count() >= len(data) // 5
            found = forecast.estimator("linear", "y", regParam=reg, elasticNetParam=e).fit(train).transform(valid)
            errors.append(found.select(F.sqrt(F.avg((F.col("y") - F.col("y_pred")) ** 2))).first()[0])
        scores[f"elasticNetParam={e}, regParam={reg}"] = errors
    first = [r for r in rows if r["rung"] == 0]
    assert all(abs(r["rmse"] - scores[r["params"]][0]) < 1e-6 for r in first)
    winner = next(r["params"] for r in rows if r["rung"] == 2)
    least = min(sum(s) for s in scores.values())
    assert sum(scores[winner]) <= least + 1e-9
    assert model.stages[1].getRegParam() == 0.0


def test_halving_wants_rows(series):
    with pytest.raises(ValueError):
        forecast.halving(series.where("false"), features=["a"], target="y", ts="ts", family="linear", grid={"regParam": [0.0]})


GOOD = "emissions fell and the unit runs clean within limits great steady output".split()
BAD = "alarm leak breach again the filter is broken and fines follow worse each day".split()


@pytest.fixture(scope="module")
def reviews(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(600):
        label = int(i % 2)
        own, other = (GOOD, BAD) if label else (BAD, GOOD)
        rows.append((i, " ".join([*r.choice(own, 6), *r.choice(other, 2), *[f"n{x}" for x in r.integers(0, 50, 4)]]), label))
    rows += [(700, None, 1), (701, "", 0), (702, "only unknown words here perhaps", None)]
    return spark.createDataFrame(rows, "id long, text string, label int").repartition(4)


def test_sentiment_model_beats_the_word_list(reviews):
    held = reviews.where("id % 4 >= 2 and id < 600")
    fitted = sentiment.fit(reviews.where("id % 4 < 2 or id >= 600"), text="text", label="label")
    assert 0 <= fitted.low <= fitted.high <= 1

    def right(df):
        return df.agg(F.avg(F.when(F.col("label") == 1, F.col("sentiment") == "正面").otherwise(F.col("sentiment") == "负面").cast("double"))).first()[0]

    model = sentiment.classify(held, fitted, text="text")
    assert right(model) >= 0.9 and right(model) > right(text.sentiment(held, "text"))
    rest = {r["id"]: (r["score"], r["sentiment"]) for r in sentiment.classify(reviews.where("id in (700, 701)"), fitted, text="text").collect()}
    assert rest == {700: (None, "中性"), 701: (None, "中性")}
    assert sentiment.classify(reviews.where("false"), fitted, text="text").count() == 0


def test_sentiment_needs_labels(reviews):
    with pytest.raises(ValueError):
        sentiment.fit(reviews.where("id = 702"), text="text", label="label")


def test_every_labelled_row_counts(spark, monkeypatch):
    """A word of one row alone has a weight, however many rows there are, and all rows set the cuts."""
    marks = [f"m{i}" for i in range(60)]
    df = spark.range(24_000).select(F.when(F.col("id") < 60, F.concat(F.lit("m"), "id")).when(F.col("id") % 2 == 0, "good").otherwise("bad").alias("text"))
    df = df.withColumn("label", (F.col("text") != "bad").cast("int")).repartition(4).union(spark.createDataFrame([("\t", 1), ("good", None)], "text string, label int"))
    held = []
    if hasattr(sentiment, "_held_out"):
        whole = sentiment._held_out
        monkeypatch.setattr(sentiment, "_held_out", lambda rows, models: held.append(whole(rows, models)) or held[-1])
    fitted = sentiment.fit(df, text="text", label="label")
    hashed, line = fitted.model.stages
    assert all(line.coefficients[hashed.indexOf(m)] > 0 for m in marks)
    assert held[0].count() == 24_000
    assert line.coefficients[hashed.indexOf("good")] > 0 > line.coefficients[hashed.indexOf("bad")]


def test_labelled_documents(spark):
    """On the rows of ``labels`` that the model has not seen it beats the lexicon."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("doc_id", "text", F.col("quality").alias("label"))
    held = docs.where("doc_id % 4 = 0")
    fitted = sentiment.fit(docs.where("doc_id % 4 <> 0"), text="text", label="label")
    ok = F.avg(F.when(F.col("label") == 1, F.col("sentiment") == "正面").otherwise(F.col("sentiment") == "负面").cast("double"))
    mine, listed = (x.agg(ok).first()[0] for x in (sentiment.classify(held, fitted, text="text"), text.sentiment(held, "text")))
    assert mine > listed, (mine, listed)


def test_features_cut_a_text_once(spark):
    df = spark.createDataFrame([("Good  Good day",), ("one",), (" ",), (None,)], "text string")
    found = sentiment._features(df, "text")
    assert [sorted(r["__words"]) for r in found.collect()] == [["day", "good", "good day", "good good"], ["one"], [], []]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 2
