"""Splits, reduction, forecasting and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.functions import domain
from plantlens.operators import blocks, evaluate, forecast, reduce, split, windows
from plantlens.plans import catalog
from plantlens.plans.queries.base import HOURLY, ROWS, query
from plantlens.plans.queries.series import KEY
from plantlens.session import staged

_HASH = "('0x' || substr(md5({key} || '|42'), 1, 15))::BIGINT"


@query("M01_random_split", "i:event_id s:split",
       f"""WITH k AS (SELECT event_id, row_number() OVER (ORDER BY {_HASH.format(key='event_id')}, event_id) AS r, count(*) OVER () AS n FROM events)
       SELECT event_id, CASE WHEN r <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM k""")
def m01(spark, d):
    rows = catalog.table(spark, d, "events").select("event_id", "value")
    return split.random(rows, key="event_id", targets=["value"], features=[])


@query("M02_chronological_split", "s:unit t:ts s:split",
       f"""WITH {HOURLY}, {ROWS}, t AS (SELECT *, floor(size * 0.8::DOUBLE) AS train FROM rows_) SELECT unit, ts, CASE WHEN pos >= train THEN 'test' WHEN pos >= train - floor(train * 0.125::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM t""")
def m02(spark, d):
    return split.chronological(catalog.hourly(spark, d), keys=KEY, ts="ts")


@query("M03_principal_components", "i:n f4:ratio,variance",
       f"""WITH {HOURLY}, c AS (SELECT count(*) AS n, var_samp(value) AS a, var_samp(load) AS b, covar_samp(value, load) AS ab FROM hourly),
       e AS (SELECT n, (a + b) / 2 + sqrt(pow((a - b) / 2, 2) + ab * ab) AS top, a + b AS total FROM c) SELECT n, top / total AS ratio, top AS variance FROM e""")
def m03(spark, d):
    out, ratios = reduce.pca(catalog.hourly(spark, d), ["value", "load"], keep=["unit", "ts"], variance=0.1)
    return out.agg(F.count("*").alias("n"), F.var_samp("PC1").alias("variance")).withColumn("ratio", F.lit(ratios[0]))


_FEATURES = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


@query("M04_select_k_best", "s:feature f:r f2:f i:chosen",
       "WITH s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS r, count(*) AS n FROM lineitem" for c in _FEATURES)
       + "), f AS (SELECT feature, r, r * r / (1 - r * r) * (n - 2) AS f FROM s) SELECT *, CASE WHEN row_number() OVER (ORDER BY f DESC, feature) <= 2 THEN 1 ELSE 0 END AS chosen FROM f")
def m04(spark, d):
    rows = catalog.table(spark, d, "lineitem")
    _, chosen = reduce.select_k_best(rows, _FEATURES, ["l_extendedprice"], 2)
    return reduce.f_scores(rows, _FEATURES, "l_extendedprice").withColumn("chosen", F.col("feature").isin(*chosen).cast("int"))


@query("M05_linear_forecaster", "f2:slope,intercept,rmse,mae f4:r2",
       """WITH c AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept FROM lineitem),
       e AS (SELECT l_extendedprice AS y, l_extendedprice - (slope * l_quantity + intercept) AS e FROM lineitem, c)
       SELECT any_value(slope) AS slope, any_value(intercept) AS intercept, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 1 - avg(e * e) / var_pop(y) AS r2 FROM e, c""")
def m05(spark, d):
    rows = catalog.table(spark, d, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("price"))
    model = forecast.fit(rows, features=["l_quantity"], targets=["price"])
    line = model.stages[-1]
    pred = forecast.long_predictions(forecast.predict(model, rows), ["price"])
    return evaluate.metrics(pred, y="y", yhat="yhat").withColumns({"slope": F.lit(float(line.coefficients[0])), "intercept": F.lit(float(line.intercept))})


def _lagged(spark, d):
    """Hourly series with recent values as features and the next hour as target."""
    rows = blocks.row_position(catalog.hourly(spark, d), KEY, "ts")
    feats = [windows.lag("value", 1, "lag_1"), windows.lag("value", 24, "lag_24"), windows.rolling("value", "mean", 24, "mean_24"), windows.lead("value", 1, "next")]
    wide = windows.add(rows, KEY, feats).dropna("any").select("unit", "ts", "value", "load", "lag_1", "lag_24", "mean_24", "next")
    return staged(wide, "lagged")


_INPUTS = ["value", "load", "lag_1", "lag_24", "mean_24"]


@query("M05_families_compared", "s:model f4:rmse,mae,r2")
def m05_families(spark, d):
    """All three families on a chronological split, with the last-value forecast as the bar to clear."""
    rows = _lagged(spark, d)
    _, table = forecast.compare(rows, keys=KEY, ts="ts", features=_INPUTS, targets=["next"])
    test = split.chronological(rows, keys=KEY, ts="ts").filter("split = 'test'")
    naive = evaluate.metrics(test, y="next", yhat="value").withColumn("model", F.lit("last_value"))
    return table.select("model", "rmse", "mae", "r2").unionByName(naive.select("model", "rmse", "mae", "r2"))


@query("M06_grid_search", "s:params f4:rmse")
def m06(spark, d):
    _, table = forecast.tune(_lagged(spark, d), features=_INPUTS, target="next", grid={"maxDepth": [2, 4], "numTrees": [5, 10]})
    return table


@query("M06_successive_halving", "i:rung,fold s:params f4:rmse")
def m06_halving(spark, d):
    """54 combinations of a linear forecaster, tried by successive halving on expanding folds in time."""
    grid = {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0], "maxIter": [5, 20, 50], "fitIntercept": [True, False]}
    _, trials = forecast.halving(_lagged(spark, d), features=_INPUTS, target="next", ts="ts", family="linear", grid=grid)
    return trials.where("kept").drop("kept")


_PRED = """pred AS (SELECT o_orderkey, o_orderdate AS ts, o_orderpriority AS target, o_totalprice / 1000 AS y, o_totalprice / 1000 * 0.9::DOUBLE + 20 AS a,
  o_totalprice / 1000 + o_custkey % 41 - 20 AS b, 250.0::DOUBLE AS c FROM orders),
  long_pred AS (SELECT o_orderkey, ts, target, y, 'a' AS model, a AS yhat FROM pred UNION ALL SELECT o_orderkey, ts, target, y, 'b', b FROM pred UNION ALL SELECT o_orderkey, ts, target, y, 'c', c FROM pred)"""
_METRICS = "count(*) AS n, avg((y - yhat) * (y - yhat)) AS mse, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat)) AS mae, 1 - avg((y - yhat) * (y - yhat)) / var_pop(y) AS r2"


def _predictions(spark, d):
    """Three deterministic prediction sets of the scaled order price, in long form."""
    o = catalog.table(spark, d, "orders")
    y = F.col("o_totalprice") / 1000
    sets = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), v.alias("yhat"))
        for m, v in (("a", y * F.lit(0.9) + 20), ("b", y + F.col("o_custkey") % 41 - 20), ("c", F.lit(250.0)))])).alias("m")
    return o.select("o_orderkey", F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("target"), y.alias("y"), sets).select(
        "o_orderkey", "ts", "target", "y", "m.model", "m.yhat")


@query("M07_metrics", "s:model,target i:n f4:mse,rmse,mae,r2", f"WITH {_PRED} SELECT model, target, {_METRICS} FROM long_pred GROUP BY 1, 2")
def m07(spark, d):
    return evaluate.metrics(_predictions(spark, d), y="y", yhat="yhat", by=["model", "target"])


_OVERALL = f"per AS (SELECT model, target, {_METRICS} FROM long_pred GROUP BY 1, 2), overall AS (SELECT model, avg(mse) AS mse, sqrt(avg(mse)) AS rmse, avg(mae) AS mae, avg(r2) AS r2 FROM per GROUP BY 1)"


def _overall(spark, d):
    return evaluate.overall(evaluate.metrics(_predictions(spark, d), y="y", yhat="yhat", by=["model", "target"]), by=["model"])


@query("M07_overall_metrics", "s:model f4:mse,rmse,mae,r2", f"WITH {_PRED}, {_OVERALL} SELECT * FROM overall")
def m07_overall(spark, d):
    return _overall(spark, d)


@query("M08_best_model", "s:model f4:rmse,r2", f"WITH {_PRED}, {_OVERALL} SELECT * FROM overall ORDER BY rmse, model LIMIT 1")
def m08(spark, d):
    return evaluate.best(_overall(spark, d))


@query("M09_ensemble", "i:o_orderkey f4:yhat",
       f"WITH {_PRED}, {_OVERALL}, w AS (SELECT model, CASE WHEN sum(r2) OVER () > 0 THEN r2 / sum(r2) OVER () ELSE 1.0 / count(*) OVER () END AS w FROM overall) SELECT o_orderkey, sum(w * yhat) / sum(w) AS yhat FROM long_pred JOIN w USING (model) GROUP BY 1")
def m09(spark, d):
    return evaluate.ensemble(_predictions(spark, d), keys=["o_orderkey"], weights=evaluate.r2_weights(_overall(spark, d)))


@query("M10_drift", "s:model i:year f4:rmse,best_rmse,change b:retrain",
       f"""WITH {_PRED}, y AS (SELECT model, year(ts) AS year, {_METRICS} FROM long_pred GROUP BY 1, 2), m AS (SELECT max(year) AS last FROM y), b AS (SELECT model, min(rmse) AS best_rmse FROM y, m WHERE year < last GROUP BY 1)
       SELECT model, year, rmse, best_rmse, (rmse - best_rmse) / best_rmse AS change, (rmse - best_rmse) / best_rmse > 0.2 AS retrain FROM y JOIN b USING (model), m WHERE year = last""")
def m10(spark, d):
    yearly = evaluate.metrics(_predictions(spark, d).withColumn("year", F.year("ts")), y="y", yhat="yhat", by=["model", "year"])
    last = catalog.latest(catalog.table(spark, d, "orders"), "o_orderdate").year
    return evaluate.drift(yearly.filter(F.col("year") == last), yearly.filter(F.col("year") < last))


@query("M11_ab_score", "s:model f4:rmse,mae,r2,score",
       f"""WITH {_PRED}, d AS (SELECT model, CAST(ts AS DATE) AS day, avg((y - yhat) * (y - yhat)) AS mse, avg(abs(y - yhat)) AS mae, var_pop(y) AS v FROM long_pred GROUP BY 1, 2),
       s AS (SELECT model, sqrt(mse) AS rmse, mae, CASE WHEN v > 0 THEN 1 - mse / v WHEN mse = 0 THEN 1 ELSE 0 END AS r2 FROM d), a AS (SELECT model, avg(rmse) AS rmse, avg(mae) AS mae, avg(r2) AS r2 FROM s GROUP BY 1)
       SELECT *, r2 * 0.1 - rmse * 0.6 - mae * 0.3 AS score FROM a""")
def m11(spark, d):
    return evaluate.ab_score(_predictions(spark, d).withColumn("day", F.to_date("ts")), y="y", yhat="yhat")


@query("M12_improvement", "s:target f4:rmse_improvement,mae_improvement,r2_improvement",
       f"""WITH {_PRED}, per AS (SELECT model, target, {_METRICS} FROM long_pred GROUP BY 1, 2)
       SELECT target, (x.rmse - z.rmse) / abs(x.rmse) * 100 AS rmse_improvement, (x.mae - z.mae) / abs(x.mae) * 100 AS mae_improvement, (z.r2 - x.r2) / abs(x.r2) * 100 AS r2_improvement
       FROM per x JOIN per z USING (target) WHERE x.model = 'a' AND z.model = 'b'""")
def m12(spark, d):
    per = evaluate.metrics(_predictions(spark, d), y="y", yhat="yhat", by=["model", "target"])
    return evaluate.improvement(per.filter("model = 'a'"), per.filter("model = 'b'"), ["target"])


@query("M13_update_job", "s:promoted f4:current_rmse b:retrained f4:current_score,candidate_score")
def m13(spark, d):
    """A model fitted on shuffled targets is scored, found drifted, refitted and replaced."""
    rows = _lagged(spark, d)
    stale = forecast.fit(rows.withColumn("next", F.col("load")), features=_INPUTS, targets=["next"])
    history = evaluate.metrics(rows, y="next", yhat="value").select(F.lit("current").alias("model"), (F.col("rmse") / 2).alias("rmse"))
    return forecast.update_job(stale, rows, history, features=_INPUTS, target="next", ts="ts", keys=KEY)[1]


@query("M14_residual_histogram", "s:model i:bin,n f4:low,high",
       f"""WITH {_PRED}, r AS (SELECT model, y - yhat AS e FROM long_pred), s AS (SELECT model, min(e) AS a, max(e) AS b FROM r GROUP BY 1),
       t AS (SELECT model, a, b, least(29, floor((e - a) / ((b - a) / 30)))::INT AS bin FROM r JOIN s USING (model)) SELECT model, bin, count(*) AS n, a + (b - a) / 30 * bin AS low, a + (b - a) / 30 * (bin + 1) AS high FROM t GROUP BY model, a, b, bin""")
def m14(spark, d):
    return evaluate.residual_histogram(_predictions(spark, d), y="y", yhat="yhat", by=["model"])


def _clamp(p: str) -> str:
    (k0, ka, kb, kc), (lo, hi) = domain.SCORE[p]
    return f"greatest({lo}, least({hi}, {k0} + {ka} * (embedding[1] * 100) + {kb} * (embedding[2] * 100) + {kc} * (embedding[3] * 100)))"


@query("M15_batch_scoring", "i:vec_id b:accepted f4:so2,nox,dust",
       "SELECT vec_id, true AS accepted, " + ", ".join(f"{_clamp(p)} AS {p}" for p in domain.SCORE) + " FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings) WHERE len(embedding) >= 10")
def m15(spark, d):
    rows = catalog.table(spark, d, "embeddings")
    a, b, c = (F.col("embedding")[i].cast("double") * 100 for i in range(3))
    scored = rows.withColumn("accepted", F.size("embedding") >= 10).filter("accepted")
    return scored.select("vec_id", "accepted", *[domain.linear_score(p, a, b, c).alias(p) for p in domain.SCORE])
