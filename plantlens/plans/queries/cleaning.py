"""Cleaning, gridding, scaling, external data and data set builds."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.operators import external, features, quality
from plantlens.plans import catalog, datasets
from plantlens.plans.queries.base import FACT, GRID, HOURLY, query
from plantlens.plans.queries.series import COMPLETE, INTERP, KEY, SLIDE
from plantlens.session import scratch_path
from plantlens.sources import readers

_GAPPY = f"""WITH {HOURLY}, raw AS (SELECT unit, ts, CASE WHEN n > 1 THEN value END AS value, CASE WHEN load <= 50 THEN load END AS load FROM hourly)"""


def _gappy(spark, d):
    """Hourly series with some missing values and a load that is mostly above the fill threshold."""
    return catalog.hourly(spark, d).select(
        "unit", "ts", F.when(F.col("n") > 1, F.col("value")).alias("value"), F.when(F.col("load") <= 50, F.col("load")).alias("load"))


def _fill(c: str) -> str:
    back = "OVER (PARTITION BY unit ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    ahead = "OVER (PARTITION BY unit ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"CASE WHEN m_{c} < 0.3::DOUBLE THEN coalesce({c}, last_value({c} IGNORE NULLS) {back}, first_value({c} IGNORE NULLS) {ahead}) ELSE {c} END AS {c}"


def _clip(c: str) -> str:
    return f"CASE WHEN {c} < lo_{c} THEN lo_{c} WHEN {c} > hi_{c} THEN hi_{c} ELSE {c} END AS {c}"


def _bounds(cols) -> str:
    return ", ".join(f"avg({c}) - 3 * stddev_samp({c}) AS lo_{c}, avg({c}) + 3 * stddev_samp({c}) AS hi_{c}" for c in cols)


@query("D01_clean_series", "s:unit t:ts f:value,load",
       f"""{_GAPPY}, m AS (SELECT unit, avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS m_value, avg(CASE WHEN load IS NULL THEN 1 ELSE 0 END) AS m_load FROM raw GROUP BY 1),
       filled AS (SELECT unit, ts, {_fill('value')}, {_fill('load')} FROM raw JOIN m USING (unit)), b AS (SELECT unit, {_bounds(['value', 'load'])} FROM filled GROUP BY 1),
       clean AS (SELECT unit, ts, {_clip('value')}, {_clip('load')} FROM filled JOIN b USING (unit)), s AS (SELECT unit, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM raw GROUP BY 1)
       SELECT s.unit, s.ts, value, load FROM s LEFT JOIN clean c ON c.unit = s.unit AND c.ts = s.ts""")
def d01(spark, d):
    return quality.clean_series(_gappy(spark, d), keys=KEY, ts="ts", cols=["value", "load"])


@query("D02_clean_table", "i:l_orderkey,l_linenumber f:quantity,price s:flag",
       f"""WITH raw AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_tax > 0.01::DOUBLE THEN l_quantity * l_quantity * l_quantity END AS quantity, l_extendedprice AS price, nullif(l_returnflag, 'N') AS flag FROM lineitem),
       md AS (SELECT median(quantity) AS mq, median(price) AS mp FROM raw), mo AS (SELECT flag AS mf FROM raw WHERE flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, flag LIMIT 1),
       filled AS (SELECT l_orderkey, l_linenumber, coalesce(quantity, mq) AS quantity, coalesce(price, mp) AS price, coalesce(flag, mf) AS flag FROM raw, md, mo), b AS (SELECT {_bounds(['quantity', 'price'])} FROM filled)
       SELECT l_orderkey, l_linenumber, {_clip('quantity')}, {_clip('price')}, flag FROM filled, b""")
def d02(spark, d):
    raw = catalog.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_tax") > 0.01, F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity")).alias("quantity"),
        F.col("l_extendedprice").alias("price"), F.nullif("l_returnflag", F.lit("N")).alias("flag"))
    return quality.clean_table(raw, numeric=["quantity", "price"], strings=["flag"])


@query("D03_promote_columns", "i:event_id f:number s:mixed", "SELECT event_id, value AS number, CASE WHEN event_type = 'signup' THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS mixed FROM events")
def d03(spark, d):
    text = catalog.table(spark, d, "events").select(
        "event_id", F.col("value").cast("string").alias("number"), F.when(F.col("event_type") == "signup", "x").otherwise(F.col("user_id").cast("string")).alias("mixed"))
    return readers.promote(text, ["number", "mixed"], "double")


@query("D04_clip_three_sigma", "i:event_id f:value",
       f"WITH r AS (SELECT event_id, event_type AS unit, value FROM events), b AS (SELECT unit, {_bounds(['value'])} FROM r GROUP BY 1) SELECT event_id, {_clip('value')} FROM r JOIN b USING (unit)")
def d04(spark, d):
    rows = catalog.table(spark, d, "events").select("event_id", F.col("event_type").alias("unit"), "value")
    return quality.clip_sigma(rows, ["value"], KEY)


@query("D05_hourly_grid", "s:unit t:ts f:value,load", f"WITH {HOURLY}, {GRID} SELECT unit, ts, value, load FROM grid")
def d05(spark, d):
    return quality.regular_grid(catalog.hourly(spark, d).select("unit", "ts", "value", "load"), KEY, "ts")


@query("D06_hourly_mean", "s:unit t:ts f:value", "SELECT event_type AS unit, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1, 2")
def d06(spark, d):
    return quality.hourly_mean(catalog.table(spark, d, "events").withColumnRenamed("event_type", "unit"), KEY, "ts", ["value"])


@query("D07_repair_irregular", "s:unit t:ts f:value", f"WITH {HOURLY}, {GRID}, {INTERP.format(c='value', src='grid')} SELECT unit, ts, value FROM interp")
def d07(spark, d):
    return quality.repair_irregular(catalog.hourly(spark, d).select("unit", "ts", "value"), KEY, "ts", ["value"])


@query("D10_standard_scaling", "s:unit t:ts f:value,load",
       f"WITH {HOURLY}, s AS (SELECT unit, avg(value) AS a, stddev_pop(value) AS b, avg(load) AS c, stddev_pop(load) AS e FROM hourly GROUP BY 1) SELECT unit, ts, (value - a) / CASE WHEN b = 0 THEN 1 ELSE b END AS value, (load - c) / CASE WHEN e = 0 THEN 1 ELSE e END AS load FROM hourly JOIN s USING (unit)")
def d10(spark, d):
    rows = catalog.hourly(spark, d)
    return quality.apply_scaler(rows, quality.fit_scaler(rows, ["value", "load"], "standard", KEY), ["value", "load"], KEY)


@query("D11_minmax_scaling", "i:l_orderkey,l_linenumber f:quantity,price,constant",
       "WITH s AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS e FROM lineitem) SELECT l_orderkey, l_linenumber, (l_quantity - a) / (b - a) AS quantity, (l_extendedprice - c) / (e - c) AS price, 0.0 AS constant FROM lineitem, s")
def d11(spark, d):
    rows = catalog.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.lit(7.0).alias("constant"))
    cols = ["quantity", "price", "constant"]
    return quality.apply_scaler(rows, quality.fit_scaler(rows, cols, "minmax"), cols)


@query("D12_inverse_scaling", "s:unit t:ts f:value", f"WITH {HOURLY} SELECT unit, ts, value FROM hourly")
def d12(spark, d):
    rows = catalog.hourly(spark, d)
    scaler = quality.fit_scaler(rows, ["value"], "standard", KEY)
    return quality.invert_scaler(quality.apply_scaler(rows, scaler, ["value"], KEY), scaler, ["value"], KEY)


@query("D13_stored_scaler", "s:unit,column f:centre,scale",
       f"WITH {HOURLY} SELECT unit, 'value' AS \"column\", avg(value) AS centre, stddev_pop(value) AS scale FROM hourly GROUP BY 1 UNION ALL SELECT unit, 'load', avg(load), stddev_pop(load) FROM hourly GROUP BY 1")
def d13(spark, d):
    path = scratch_path(spark, "scaler")
    quality.fit_scaler(catalog.hourly(spark, d), ["value", "load"], "standard", KEY).write.parquet(path)
    return spark.read.parquet(path)


# ---- external data ----

_CITIES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
_METRICS = ("temperature", "humidity", "wind_speed")
_WEATHER = """weather AS (SELECT CAST(o_orderdate AS DATE) AS date, r_name AS city, avg(round(c_acctbal * 100)) / 10000 AS temperature, avg(round(o_totalprice * 100)) / 100000 AS humidity, count(*)::DOUBLE AS wind_speed
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"""


def _external(spark, d):
    orders, customer = catalog.table(spark, d, "orders"), catalog.table(spark, d, "customer")
    place = catalog.table(spark, d, "nation").join(catalog.table(spark, d, "region"), F.expr("n_regionkey = r_regionkey")).select("n_nationkey", F.col("r_name").alias("city"))
    day = F.to_date("o_orderdate").alias("date")
    home = customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal")
    weather = orders.join(home, "o_custkey").join(place, F.expr("c_nationkey = n_nationkey")).groupBy(day, "city").agg(
        (F.avg(F.round(F.col("c_acctbal") * 100)) / 10000).alias("temperature"), (F.avg(F.round(F.col("o_totalprice") * 100)) / 100000).alias("humidity"),
        F.count("*").cast("double").alias("wind_speed"))
    policy = orders.filter("o_orderstatus = 'P'").select(day)
    events = orders.select(day, F.col("o_orderpriority").alias("impact_level"))
    capacity = orders.filter("o_orderstatus IN ('F', 'O')").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("date"), F.col("o_orderstatus").alias("province")).agg(
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100.0).alias("total_renewable"))
    return external.merge_by_date(weather, policy, events, capacity, cities=_CITIES, metrics=_METRICS, provinces=["F", "O"], high="1-URGENT")


_MERGED = f"""{_WEATHER}, pol AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS policy_count FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
  evt AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS event_count, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS high_impact_event_count FROM orders GROUP BY 1),
  cap AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / 100 AS f, sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (WHERE o_orderstatus = 'O')::DOUBLE / 100 AS o FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1),
  spine AS (SELECT date FROM weather UNION SELECT date FROM pol UNION SELECT date FROM evt UNION SELECT date FROM cap),
  wide AS (SELECT date, {', '.join(f"max({m}) FILTER (WHERE city = '{c}') AS " + chr(34) + f"{c}_{m}" + chr(34) for c in _CITIES for m in _METRICS)} FROM weather GROUP BY 1),
  merged AS (SELECT *, coalesce(policy_count, 0) AS policies, CASE WHEN policy_count > 0 THEN 1 ELSE 0 END AS policy_impact, coalesce(event_count, 0) AS happenings, coalesce(high_impact_event_count, 0) AS high_impact,
    last_value(f IGNORE NULLS) OVER w AS "F_renewable_capacity", last_value(o IGNORE NULLS) OVER w AS "O_renewable_capacity", year(date) AS year, month(date) AS month, isodow(date) - 1 AS dayofweek
    FROM spine LEFT JOIN wide USING (date) LEFT JOIN pol USING (date) LEFT JOIN evt USING (date) LEFT JOIN cap USING (date) WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING))"""
_QUOTED = ",".join(f"{c}_{m}" for c in _CITIES if " " not in c for m in _METRICS)


@query("E08_merge_by_date", f"d:date i:policies,policy_impact,happenings,high_impact,year,month,dayofweek f:{_QUOTED} f2:F_renewable_capacity,O_renewable_capacity", f"WITH {_MERGED} SELECT * FROM merged")
def e08(spark, d):
    return _external(spark, d).withColumnsRenamed({"policy_count": "policies", "event_count": "happenings", "high_impact_event_count": "high_impact"})


@query("E07_join_external", "i:unit_id t:ts f:so2,ASIA_temperature i:policy_count",
       f"""WITH {FACT}, {_MERGED} SELECT unit_id, ts, so2, "ASIA_temperature", policies AS policy_count FROM fact LEFT JOIN merged ON CAST(ts AS DATE) = date""")
def e07(spark, d):
    ext = _external(spark, d).select("date", "ASIA_temperature", "policy_count")
    return external.join_daily(catalog.readings(spark, d), ext, ts="ts")


_DAILY = "daily AS (SELECT CAST(ts AS DATE) AS date, count(*) AS purchases FROM events WHERE event_type = 'purchase' GROUP BY 1)"


@query("E15_training_set", "s:unit t:ts f:value,value_mean_24h,value_target_24h i:purchases",
       f"WITH {HOURLY}, {GRID}, {SLIDE}, {_DAILY} SELECT unit, ts, value, value_mean_24h, value_target_24h, purchases FROM slide LEFT JOIN daily ON CAST(ts AS DATE) = date WHERE {COMPLETE}")
def e15(spark, d):
    ext = catalog.table(spark, d, "events").filter("event_type = 'purchase'").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("purchases"))
    series = catalog.hourly(spark, d).select("unit", "ts", "value")
    return features.build_training_set(series, ext, keys=KEY, ts="ts", targets=["value"], null_policy="drop")


@query("E13_process_series", "s:output i:n,train_n,test_n",
       f"""WITH {HOURLY}, {GRID}, {SLIDE}, w AS (SELECT count(*) AS n FROM slide WHERE {COMPLETE}), s AS (SELECT count(*) AS n FROM (SELECT DISTINCT unit, CAST(ts AS DATE) FROM hourly)), f AS (SELECT 5 * count(DISTINCT unit) AS n FROM hourly)
       SELECT 'window' AS output, n, CAST(NULL AS BIGINT) AS train_n, CAST(NULL AS BIGINT) AS test_n FROM w UNION ALL SELECT 'statistics', n, NULL, NULL FROM s UNION ALL SELECT 'frequency', n, NULL, NULL FROM f
       UNION ALL SELECT 'components', n, NULL, NULL FROM w UNION ALL SELECT 'model_input', n, n - CAST(ceil(n * 0.2) AS BIGINT), CAST(ceil(n * 0.2) AS BIGINT) FROM w""")
def e13(spark, d):
    series = catalog.hourly(spark, d).select("unit", "ts", "value")
    paths = datasets.process_series(series, scratch_path(spark, "series"), keys=KEY, ts="ts", targets=["value"])
    out = None
    for name, path in paths.items():
        rows, none = spark.read.parquet(path), F.lit(None).cast("long")
        train, test = (F.count_if(F.col("split") == s) if name == "model_input" else F.max(none) for s in ("train", "test"))
        part = rows.agg(F.count("*").alias("n"), train.alias("train_n"), test.alias("test_n")).withColumn("output", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
