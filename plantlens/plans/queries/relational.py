"""Projections, predicates, joins, aggregates, ordering, sets and scalar functions over the star."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plantlens.functions import calendar, domain, weather
from plantlens.functions import text as tf
from plantlens.operators import external, features, oplogs, quality, quantiles, stats, windows
from plantlens.operators.text import TRAINING_TEMPLATE
from plantlens.plans import business, catalog
from plantlens.plans.queries.base import AREA, FACT, LONG, NOW, OVER, PLANT, STAR, STATUS, UNIT, norm, query

YEAR = 1998


def _facts(spark, d, **kw):
    return catalog.so2_facts(spark, d, **kw), catalog.nox_facts(spark, d, **kw), catalog.soot_facts(spark, d, **kw)


# ---- projections and predicates ----

@query("P01_projection", "s:plant,unit f2:capacity", f"WITH {UNIT}, {PLANT} SELECT plant_name AS plant, unit_name AS unit, rating AS capacity FROM unit JOIN plant USING (plant_id)")
def p01(spark, d):
    return catalog.units(spark, d).join(catalog.plants(spark, d), "plant_id").select(
        F.col("plant_name").alias("plant"), F.col("unit_name").alias("unit"), F.col("rating").alias("capacity"))


@query("P02_status_case", "i:unit_id t:ts s:unit_type,status", f"WITH {UNIT}, {FACT} SELECT unit_id, ts, unit_type, {STATUS} AS status FROM fact JOIN unit USING (unit_id)")
def p02(spark, d):
    return business.with_unit(catalog.readings(spark, d), catalog.units(spark, d)).select(
        "unit_id", "ts", "unit_type", domain.emission_status().alias("status"))


@query("P03_exceedance_predicate", "i:unit_id t:ts f:so2,nox,soot",
       f"WITH {UNIT}, {FACT} SELECT unit_id, ts, so2, nox, soot FROM fact JOIN unit USING (unit_id) WHERE unit_type IN ('燃煤机', '燃气机') AND {OVER}")
def p03(spark, d):
    return business.with_unit(catalog.readings(spark, d), catalog.units(spark, d)).filter(domain.exceeds())


@query("P04_relative_window", "i:unit_id t:ts f:so2", f"WITH {FACT}, {NOW} SELECT unit_id, ts, so2 FROM fact, now_ WHERE ts >= t - INTERVAL 24 HOUR")
def p04(spark, d):
    now = catalog.fact_now(spark, d)
    return catalog.readings(spark, d, since=now - timedelta(hours=24))


@query("P05_year_month", "i:unit_id t:ts f:so2", f"WITH {FACT} SELECT unit_id, ts, so2 FROM fact WHERE year(ts) = {YEAR} AND month(ts) = 12")
def p05(spark, d):
    since, until = business.month_range(YEAR, 12)
    return catalog.readings(spark, d, since=since, until=until)


@query("P06_in_list", "i:unit_id s:unit_type", f"WITH {UNIT} SELECT unit_id, unit_type FROM unit WHERE unit_type IN ('燃煤机', '风电')")
def p06(spark, d):
    return catalog.units(spark, d).filter(F.col("unit_type").isin(domain.COAL, domain.WIND))


@query("P07_guarded_division", "i:unit_id f:ratio",
       f"WITH {FACT} SELECT unit_id, CASE WHEN sum(CASE WHEN soot > 4 THEN kwh ELSE 0 END) > 0 THEN sum(so2) / sum(CASE WHEN soot > 4 THEN kwh ELSE 0 END) ELSE 0 END AS ratio FROM fact GROUP BY 1")
def p07(spark, d):
    kwh = F.sum(F.when(F.col("soot") > 4, F.col("kwh")).otherwise(0.0))
    return catalog.readings(spark, d).groupBy("unit_id").agg(domain.guarded_ratio(F.sum("so2"), kwh).alias("ratio"))


@query("P08_api_filter", "i:unit_id t:ts f:nox",
       f"WITH {FACT} SELECT unit_id, ts, nox FROM fact WHERE unit_id = 7 AND ts >= TIMESTAMP '1997-01-01 00:00:00' AND ts <= TIMESTAMP '1997-12-31 23:59:59'")
def p08(spark, d):
    return catalog.readings(spark, d, since=datetime(1997, 1, 1), until=datetime(1998, 1, 1)).filter("unit_id = 7").select("unit_id", "ts", "nox")


@query("P09_blank_filter", "i:doc_id,chars", f"SELECT doc_id, length({norm('text')}) AS chars FROM documents WHERE length(trim(coalesce(text, ''))) > 0")
def p09(spark, d):
    docs = catalog.table(spark, d, "documents")
    return docs.filter(tf.not_blank(F.col("text"))).select("doc_id", F.length(tf.normalise(F.col("text"))).alias("chars"))


@query("P10_column_selection", "s:name i:n f2:total",
       f"WITH {FACT} SELECT 'so2' AS name, count(so2) AS n, sum(so2) AS total FROM fact UNION ALL SELECT 'nox', count(nox), sum(nox) FROM fact UNION ALL SELECT 'soot', count(soot), sum(soot) FROM fact")
def p10(spark, d):
    facts = catalog.readings(spark, d)
    chosen = features.choose_targets(facts, skip=["unit_id", "ts"])
    row = facts.agg(*[x for c in chosen for x in (F.count(c).alias(f"n_{c}"), F.sum(c).alias(f"s_{c}"))])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(f"n_{c}").alias("n"), F.col(f"s_{c}").alias("total")) for c in chosen])).alias("x")).select("x.*")


def _grade(v: str, limit: str, danger: str, warn: str) -> str:
    return f"CASE WHEN {v} > {danger}::DOUBLE * {limit} THEN 2 WHEN {v} > {warn}::DOUBLE * {limit} THEN 1 ELSE 0 END"


_WORST = f"greatest({_grade('so2', '35', '1.2', '1.0')}, {_grade('nox', '50', '1.2', '1.0')}, {_grade('soot', '5', '1.2', '1.0')})"


@query("P11_top_line_status", "i:unit_id t:ts i:so2_code,nox_code,soot_code,worst",
       f"WITH {FACT} SELECT unit_id, ts, {_grade('so2', '35', '1.2', '1.0')} AS so2_code, {_grade('nox', '50', '1.2', '1.0')} AS nox_code, {_grade('soot', '5', '1.2', '1.0')} AS soot_code, {_WORST} AS worst FROM fact")
def p11(spark, d):
    codes = {f"{m}_code": domain.top_line(F.col(m), v) for m, v in domain.LIMITS.items()}
    return catalog.readings(spark, d).select("unit_id", "ts", *[c.alias(n) for n, c in codes.items()], F.greatest(*codes.values()).alias("worst"))


@query("P12_early_warning_status", "i:unit_id t:ts s:status",
       f"WITH {FACT} SELECT unit_id, ts, CASE {_grade('nox', '50', '1.0', '0.8')} WHEN 2 THEN 'danger' WHEN 1 THEN 'warning' ELSE 'normal' END AS status FROM fact")
def p12(spark, d):
    code = domain.early_warning(F.col("nox"), domain.LIMITS["nox"])
    return catalog.readings(spark, d).select("unit_id", "ts", domain.severity_label(code).alias("status"))


@query("P13_arity_check", "s:verdict i:n", "SELECT CASE WHEN len(string_split(trim(text), ' ')) >= 10 THEN 'accepted' ELSE 'rejected' END AS verdict, count(*) AS n FROM conversations GROUP BY 1")
def p13(spark, d):
    size = F.size(F.split(F.trim("text"), " "))
    return catalog.table(spark, d, "conversations").groupBy(F.when(size >= 10, "accepted").otherwise("rejected").alias("verdict")).agg(F.count("*").alias("n"))


# ---- joins ----

@query("J01_plant_unit_fact", "s:plant_name,unit_name t:ts f:so2", f"WITH {STAR} SELECT plant_name, unit_name, ts, so2 FROM plant JOIN unit USING (plant_id) JOIN fact USING (unit_id)")
def j01(spark, d):
    return business.with_unit(catalog.so2_facts(spark, d), catalog.units(spark, d), catalog.plants(spark, d))


@query("J02_fact_to_fact", "i:unit_id t:ts f:so2,nox,soot", f"WITH {FACT} SELECT a.unit_id, a.ts, a.so2, b.nox, c.soot FROM fact a JOIN fact b ON a.unit_id = b.unit_id AND a.ts = b.ts JOIN fact c ON a.unit_id = c.unit_id AND a.ts = c.ts")
def j02(spark, d):
    return business.join_facts(*[f.drop("time_2to30", "time_30to50") for f in _facts(spark, d)])


@query("J03_area_hierarchy", "s:area_name,plant_name,unit_name", f"WITH {UNIT}, {PLANT}, {AREA} SELECT area_name, plant_name, unit_name FROM unit JOIN plant USING (plant_id) JOIN area USING (area_code) WHERE parent_code = 'R1'")
def j03(spark, d):
    return business.units_of_area(catalog.units(spark, d), catalog.plants(spark, d), catalog.areas(spark, d), parent="R1")


@query("J04_left_join_on_dates", "i:unit_id,n f:so2", f"WITH {UNIT}, {FACT} SELECT unit_id, count(so2) AS n, avg(so2) AS so2 FROM unit LEFT JOIN (SELECT * FROM fact WHERE year(ts) = {YEAR} AND month(ts) = 2 AND day(ts) <= 7) f USING (unit_id) GROUP BY 1")
def j04(spark, d):
    facts = catalog.so2_facts(spark, d, since=datetime(YEAR, 2, 1), until=datetime(YEAR, 2, 8))
    sums = facts.groupBy("unit_id").agg(F.count("*").alias("n"), F.avg("so2").alias("so2"))
    return catalog.units(spark, d).join(sums, "unit_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


_DAYS = "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1"


@query("J05_join_on_day", "i:unit_id t:ts f:so2 i:orders", f"WITH {FACT}, ext AS ({_DAYS}) SELECT unit_id, ts, so2, orders FROM fact LEFT JOIN ext ON CAST(ts AS DATE) = day")
def j05(spark, d):
    ext = catalog.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("orders"))
    return external.join_daily(catalog.readings(spark, d), ext, ts="ts", date="day")


@query("J06_date_spine_joins", "d:day i:urgent,low f2:price",
       """WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
       b AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS low FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1),
       c AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS price FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
       spine AS (SELECT day FROM a UNION SELECT day FROM b UNION SELECT day FROM c)
       SELECT day, coalesce(urgent, 0) AS urgent, coalesce(low, 0) AS low, price FROM spine LEFT JOIN a USING (day) LEFT JOIN b USING (day) LEFT JOIN c USING (day)""")
def j06(spark, d):
    orders = catalog.table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    a = orders.filter("o_orderpriority = '1-URGENT'").groupBy("day").agg(F.count("*").alias("urgent"))
    b = orders.filter("o_orderpriority = '5-LOW'").groupBy("day").agg(F.count("*").alias("low"))
    c = orders.filter("o_orderstatus = 'F'").groupBy("day").agg(F.sum("o_totalprice").alias("price"))
    return external.date_spine([a, b, c], "day").join(a, "day", "left").join(b, "day", "left").join(c, "day", "left").fillna(0, ["urgent", "low"])


@query("J07_concat_by_index", "i:unit_id t:ts f:total,so2", f"WITH {FACT} SELECT unit_id, ts, so2 + nox + soot AS total, so2 FROM fact")
def j07(spark, d):
    return catalog.readings(spark, d).withColumn("total", F.col("so2") + F.col("nox") + F.col("soot"))


@query("J08_capacity_as_of", "d:day f2:north_renewable_capacity",
       """WITH cap AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS day, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / 100 AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
       spine AS (SELECT day FROM cap UNION SELECT CAST(o_orderdate AS DATE) FROM orders)
       SELECT day, last_value(v IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS north_renewable_capacity FROM spine LEFT JOIN cap USING (day)""")
def j08(spark, d):
    orders = catalog.table(spark, d, "orders")
    cap = orders.filter("o_orderstatus = 'F'").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("day")).agg(
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100.0).alias("total_renewable")).withColumn("province", F.lit("north"))
    spine = external.date_spine([cap, orders.select(F.col("o_orderdate").alias("day"))], "day")
    return external.carry_capacity(spine, cap, ["north"], "day")


# ---- aggregates ----

@query("A01_sum_avg_by_unit", "s:plant_name,unit_name f2:kwh f:so2",
       f"WITH {STAR} SELECT plant_name, unit_name, sum(kwh) AS kwh, avg(so2) AS so2 FROM fact JOIN unit USING (unit_id) JOIN plant USING (plant_id) GROUP BY 1, 2")
def a01(spark, d):
    sums = catalog.readings(spark, d).groupBy("unit_id").agg(F.sum("kwh").alias("kwh"), F.avg("so2").alias("so2"))
    return business.with_unit(sums, catalog.units(spark, d), catalog.plants(spark, d))


@query("A02_monthly_average", "i:month f:so2,nox,soot", f"WITH {FACT} SELECT month(ts) AS month, avg(so2) AS so2, avg(nox) AS nox, avg(soot) AS soot FROM fact WHERE year(ts) = {YEAR} GROUP BY 1")
def a02(spark, d):
    since, until = business.month_range(YEAR)
    return catalog.readings(spark, d, since, until).groupBy(F.month("ts").alias("month")).agg(*[F.avg(m).alias(m) for m in business.MEASURES])


@query("A03_distinct_counts", "i:plants,coal_units,reporting",
       f"WITH {UNIT}, {FACT} SELECT count(DISTINCT plant_id) AS plants, count(DISTINCT CASE WHEN unit_type = '燃煤机' THEN unit_id END) AS coal_units, count(DISTINCT CASE WHEN so2 > 35 THEN unit_id END) AS reporting FROM unit LEFT JOIN fact USING (unit_id)")
def a03(spark, d):
    rows = catalog.units(spark, d).join(catalog.readings(spark, d), "unit_id", "left")
    return rows.agg(F.count_distinct("plant_id").alias("plants"),
                    F.count_distinct(F.when(F.col("unit_type") == domain.COAL, F.col("unit_id"))).alias("coal_units"),
                    F.count_distinct(F.when(F.col("so2") > 35, F.col("unit_id"))).alias("reporting"))


@query("A04_global_aggregate", "f:so2,rating i:n", f"WITH {UNIT}, {FACT} SELECT avg(so2) AS so2, avg(rating) AS rating, count(*) AS n FROM unit LEFT JOIN (SELECT * FROM fact WHERE year(ts) = {YEAR}) f USING (unit_id)")
def a04(spark, d):
    since, until = business.month_range(YEAR)
    return catalog.units(spark, d).join(catalog.so2_facts(spark, d, since, until), "unit_id", "left").agg(
        F.avg("so2").alias("so2"), F.avg("rating").alias("rating"), F.count("*").alias("n"))


@query("A05_pivot_max_case", "d:day f2:coal,gas,wind,solar",
       f"""WITH {UNIT}, {FACT}, t AS (SELECT CAST(ts AS DATE) AS day, unit_type, max(kwh) AS v FROM fact JOIN unit USING (unit_id) WHERE year(ts) = {YEAR} GROUP BY 1, 2)
       SELECT day, max(CASE WHEN unit_type = '燃煤机' THEN v ELSE 0 END) AS coal, max(CASE WHEN unit_type = '燃气机' THEN v ELSE 0 END) AS gas,
       max(CASE WHEN unit_type = '风电' THEN v ELSE 0 END) AS wind, max(CASE WHEN unit_type = '光电' THEN v ELSE 0 END) AS solar FROM t GROUP BY 1""")
def a05(spark, d):
    since, until = business.month_range(YEAR)
    types = {domain.COAL: "coal", domain.GAS: "gas", domain.WIND: "wind", domain.SOLAR: "solar"}
    rows = catalog.readings(spark, d, since, until).join(catalog.units(spark, d).select("unit_id", "unit_type"), "unit_id")
    wide = rows.groupBy(F.to_date("ts").alias("day")).pivot("unit_type", list(types)).agg(F.max("kwh")).fillna(0.0)
    return wide.withColumnsRenamed(types)


@query("A06_day_type_average", "d:day s:unit_type f:rating", f"WITH {UNIT}, {FACT} SELECT CAST(ts AS DATE) AS day, unit_type, avg(rating) AS rating FROM fact JOIN unit USING (unit_id) GROUP BY 1, 2")
def a06(spark, d):
    return catalog.readings(spark, d).join(catalog.units(spark, d), "unit_id").groupBy(F.to_date("ts").alias("day"), "unit_type").agg(F.avg("rating").alias("rating"))


@query("A07_counts_per_day", "d:day i:event_count,high_impact_event_count",
       "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS event_count, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS high_impact_event_count FROM orders GROUP BY 1")
def a07(spark, d):
    cal = catalog.table(spark, d, "orders").select(F.col("o_orderdate").alias("day"), F.col("o_orderpriority").alias("impact_level"))
    return external.event_counts(cal, "day", high="1-URGENT")


@query("A09_missing_profile", "s:column i:missing f:missing_pct",
       "WITH t AS (SELECT nullif(l_returnflag, 'N') AS flag, CASE WHEN l_quantity > 25 THEN l_quantity END AS quantity, l_tax AS tax FROM lineitem) SELECT 'flag' AS \"column\", count(*) - count(flag) AS missing, (count(*) - count(flag)) * 100.0::DOUBLE / count(*) AS missing_pct FROM t UNION ALL SELECT 'quantity', count(*) - count(quantity), (count(*) - count(quantity)) * 100.0::DOUBLE / count(*) FROM t UNION ALL SELECT 'tax', count(*) - count(tax), (count(*) - count(tax)) * 100.0::DOUBLE / count(*) FROM t")
def a09(spark, d):
    t = catalog.table(spark, d, "lineitem").select(
        F.nullif("l_returnflag", F.lit("N")).alias("flag"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("quantity"), F.col("l_tax").alias("tax"))
    return quality.missing_profile(t, ["flag", "quantity", "tax"])


@query("A10_sigma_bounds", "s:unit f:value_lo,value_hi", "SELECT event_type AS unit, avg(value) - 3 * stddev_samp(value) AS value_lo, avg(value) + 3 * stddev_samp(value) AS value_hi FROM events GROUP BY 1")
def a10(spark, d):
    return quality.sigma_bounds(catalog.table(spark, d, "events").withColumnRenamed("event_type", "unit"), ["value"], ["unit"])


@query("A11_median_and_mode", "s:unit f:value_median s:k_mode",
       """WITH t AS (SELECT event_type AS unit, value, json_extract_string(props, '$.k') AS k FROM events),
       c AS (SELECT unit, k, count(*) AS n FROM t GROUP BY 1, 2), m AS (SELECT unit, k, row_number() OVER (PARTITION BY unit ORDER BY n DESC, k) AS r FROM c),
       q AS (SELECT unit, median(value) AS value_median FROM t GROUP BY 1) SELECT unit, value_median, k AS k_mode FROM q JOIN m USING (unit) WHERE r = 1""")
def a11(spark, d):
    t = catalog.table(spark, d, "events").select(F.col("event_type").alias("unit"), "value", F.get_json_object("props", "$.k").alias("k"))
    return quantiles.exact_wide(t, ["unit"], ["value"], {"median": 0.5}).join(quantiles.mode_value(t, ["unit"], "k"), "unit")


_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("A12_correlation_matrix", "s:c1,c2 f:r", " UNION ALL ".join(
    f"SELECT '{a}' AS c1, '{b}' AS c2, {f'corr({a}, {b}) AS r FROM lineitem' if a != b else '1.0 AS r'}" for a in _COLS for b in _COLS))
def a12(spark, d):
    return stats.correlations(catalog.table(spark, d, "lineitem"), _COLS)


@query("A13_box_summary", "s:col f:q1,median,q3,whisker_low,whisker_high i:outliers", """
  WITH t AS (SELECT 'price' AS col, o_totalprice AS v FROM orders UNION ALL SELECT 'k', json_extract(props, '$.k')::DOUBLE ** 3 FROM events UNION ALL SELECT 'value', value FROM events),
  q AS (SELECT col, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM t GROUP BY 1)
  SELECT col, q1, median, q3, min(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (WHERE v NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM t JOIN q USING (col) GROUP BY 1, 2, 3, 4""")
def a13(spark, d):
    ev = catalog.table(spark, d, "events").select(F.pow(F.get_json_object("props", "$.k").cast("double"), F.lit(3.0)).alias("k"), "value")
    price = catalog.table(spark, d, "orders").select(F.col("o_totalprice").alias("price"))
    return stats.box_summary(ev, ["k", "value"]).unionByName(stats.box_summary(price, ["price"]))


@query("A14_histogram", "s:unit i:bin,n f:low,high", """
  WITH s AS (SELECT event_type AS unit, min(value) AS a, max(value) AS b FROM events GROUP BY 1),
  t AS (SELECT event_type AS unit, a, b, least(29, floor((value - a) / ((b - a) / 30)))::INT AS bin FROM events JOIN s ON s.unit = event_type)
  SELECT unit, bin, count(*) AS n, a + (b - a) / 30 * bin AS low, a + (b - a) / 30 * (bin + 1) AS high FROM t GROUP BY unit, a, b, bin""")
def a14(spark, d):
    return stats.histogram(catalog.table(spark, d, "events").withColumnRenamed("event_type", "unit"), "value", 30, ["unit"])


@query("A15_average_per_pollutant", "f2:so2,nox,soot", f"WITH {FACT} SELECT avg(so2) AS so2, avg(nox) AS nox, avg(soot) AS soot FROM fact")
def a15(spark, d):
    return catalog.readings(spark, d).agg(*[F.avg(m).alias(m) for m in business.MEASURES])


@query("A16_corpus_ratio", "f:ratio i:n", "SELECT avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0.0 END) AS ratio, count(*) AS n FROM labels")
def a16(spark, d):
    ok = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return catalog.table(spark, d, "labels").agg(F.avg(ok.cast("int")).alias("ratio"), F.count("*").alias("n"))


_ERR = """err AS (SELECT event_id AS error_id, ts, CASE (json_extract(props, '$.k')::BIGINT) % 4 WHEN 0 THEN 'ValidationAPIError' WHEN 1 THEN 'DatabaseAPIError'
  WHEN 2 THEN 'RateLimitAPIError' ELSE 'UnknownError' END AS error_type, props, value, user_id FROM events WHERE event_type = 'error')"""


@query("A17_error_counts", "s:error_type i:errors t:newest i:kept",
       f"WITH {_ERR} SELECT error_type, count(*) AS errors, max(ts) AS newest, least(count(*), 100) AS kept FROM err GROUP BY 1")
def a17(spark, d):
    return oplogs.error_stats(catalog.errors(spark, d), error_type="error_type", ts="ts", error_id="error_id").select(
        "error_type", "errors", F.col("recent")[0].alias("newest"), F.size("recent").alias("kept"))


_REQ = """req AS (SELECT CASE WHEN (json_extract(props, '$.k')::BIGINT) % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, '/' || event_type AS endpoint,
  round(value * 100) / 10000 AS latency, (json_extract(props, '$.k')::BIGINT) % 10 = 0 AS failed FROM events)"""


@query("A18_request_statistics", "s:method,endpoint i:requests,errors f:mean_latency,peak_latency i:le_0_1,le_1_0",
       f"WITH {_REQ} SELECT method, endpoint, count(*) AS requests, count(*) FILTER (WHERE failed) AS errors, avg(latency) AS mean_latency, max(latency) AS peak_latency, count(*) FILTER (WHERE latency <= 0.1::DOUBLE) AS le_0_1, count(*) FILTER (WHERE latency <= 1.0::DOUBLE) AS le_1_0 FROM req GROUP BY 1, 2")
def a18(spark, d):
    return oplogs.request_stats(catalog.requests(spark, d), failed=F.col("failed"))


# ---- ordering, top-k, paging ----

@query("L01_order_by", "i:unit_id t:ts f:so2", f"WITH {FACT} SELECT unit_id, ts, so2 FROM fact WHERE so2 > 45 ORDER BY ts DESC, unit_id")
def l01(spark, d):
    return catalog.so2_facts(spark, d).filter("so2 > 45").orderBy(F.desc("ts"), "unit_id")


@query("L02_top_three", "i:unit_id f:so2", f"WITH {FACT} SELECT unit_id, avg(so2) AS so2 FROM fact GROUP BY 1 ORDER BY round(avg(so2), 9), unit_id LIMIT 3")
def l02(spark, d):
    return catalog.so2_facts(spark, d).groupBy("unit_id").agg(F.avg("so2").alias("so2")).orderBy(F.round("so2", 9), "unit_id").limit(3)


@query("L03_sort_two_keys", "d:day s:status i:n", "SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY 1, 2")
def l03(spark, d):
    return catalog.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("n")).orderBy("day", "status")


@query("L04_page", "i:unit_id t:ts i:page,total,total_pages b:has_next,has_prev",
       f"WITH {FACT}, c AS (SELECT count(*) AS total FROM fact) SELECT unit_id, ts, 3 AS page, total, CAST(ceil(total / 10.0) AS BIGINT) AS total_pages, 3 < ceil(total / 10.0) AS has_next, true AS has_prev FROM fact, c ORDER BY ts, unit_id LIMIT 10 OFFSET 20")
def l04(spark, d):
    return business.list_emissions(catalog.readings(spark, d), page=3, page_size=10)


@query("L05_last_errors", "i:error_id t:ts", f"WITH {_ERR} SELECT error_id, ts FROM err ORDER BY ts DESC, error_id LIMIT 20")
def l05(spark, d):
    return oplogs.recent_errors(catalog.errors(spark, d), ts="ts", error_id="error_id", n=20)


@query("L07_latest_reading", "i:event_id t:ts f:value", "SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id LIMIT 1")
def l07(spark, d):
    return catalog.table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(1)


@query("L08_first_samples", "i:item_id s:text", "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 5")
def l08(spark, d):
    return catalog.table(spark, d, "benchmark").orderBy("item_id").limit(5)


@query("U01_union_distinct_dates", "d:day", "SELECT CAST(o_orderdate AS DATE) AS day FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem UNION SELECT CAST(ts AS DATE) FROM events ORDER BY 1")
def u01(spark, d):
    frames = [catalog.table(spark, d, t).select(F.col(c).alias("day")) for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))]
    return external.date_spine(frames, "day").orderBy("day")


@query("U02_append_rows", "s:source i:id", "SELECT 'benchmark' AS source, item_id AS id FROM benchmark UNION ALL SELECT 'documents', doc_id FROM documents UNION ALL SELECT 'labels', doc_id FROM labels")
def u02(spark, d):
    a = catalog.table(spark, d, "benchmark").select(F.lit("benchmark").alias("source"), F.col("item_id").alias("id"))
    b = catalog.table(spark, d, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"))
    c = catalog.table(spark, d, "labels").select(F.lit("labels").alias("source"), F.col("doc_id").alias("id"))
    return a.unionByName(b).unionByName(c)


# ---- scalar functions ----

_SEASON = "CASE WHEN month(ts) IN (3, 4, 5) THEN 1 WHEN month(ts) IN (6, 7, 8) THEN 2 WHEN month(ts) IN (9, 10, 11) THEN 3 ELSE 4 END AS season"


def _cyc(name: str, value: str, period: str) -> str:
    return f"sin(2 * pi() * {value} / {period}) AS {name}_sin, cos(2 * pi() * {value} / {period}) AS {name}_cos"


_HOUR = "hour(ts) AS hour, day(ts) AS day, month(ts) AS month, year(ts) AS year, isodow(ts) - 1 AS dayofweek, quarter(ts) AS quarter"


@query("F01_calendar_a", "i:event_id,hour,day,month,year,dayofweek,quarter,season b:is_weekend f:hour_sin,hour_cos,day_sin,day_cos",
       f"SELECT event_id, {_HOUR}, isodow(ts) >= 6 AS is_weekend, {_SEASON}, {_cyc('hour', 'hour(ts)', '24')}, {_cyc('day', 'day(ts)', 'day(last_day(ts))')} FROM events")
def f01(spark, d):
    return calendar.add(catalog.table(spark, d, "events"), "ts", "A")


@query("F02_calendar_b", "i:unit_id,hour,dayofweek,month,quarter,year,dayofyear,is_weekend b:is_month_start,is_month_end f:hour_sin,dayofweek_sin,dayofweek_cos,month_sin,month_cos",
       f"SELECT l_suppkey AS unit_id, hour(ts) AS hour, isodow(ts) - 1 AS dayofweek, month(ts) AS month, quarter(ts) AS quarter, year(ts) AS year, dayofyear(ts) AS dayofyear, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, day(ts) = 1 AS is_month_start, CAST(ts AS DATE) = last_day(ts) AS is_month_end, {_cyc('hour', 'hour(ts)', '24')}, {_cyc('dayofweek', '(isodow(ts) - 1)', '7')}, {_cyc('month', 'month(ts)', '12')} FROM (SELECT l_suppkey, l_shipdate AS ts FROM lineitem)")
def f02(spark, d):
    rows = catalog.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit_id"), F.col("l_shipdate").alias("ts"))
    return calendar.add(rows, "ts", "B")


@query("F03_calendar_c", "i:event_id,hour,day,month,day_of_week,is_weekend,season f:day_sin,day_cos,dow_sin,dow_cos,month_sin,month_cos",
       f"SELECT event_id, hour(ts) AS hour, day(ts) AS day, month(ts) AS month, isodow(ts) - 1 AS day_of_week, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, {_SEASON}, {_cyc('day', 'day(ts)', '31')}, {_cyc('dow', '(isodow(ts) - 1)', '7')}, {_cyc('month', 'month(ts)', '12')} FROM events")
def f03(spark, d):
    return calendar.add(catalog.table(spark, d, "events"), "ts", "C")


@query("F04_calendar_d", "i:o_orderkey,year,month,day,dayofweek,season b:is_weekend",
       f"SELECT o_orderkey, {_HOUR}, isodow(ts) >= 6 AS is_weekend, {_SEASON} FROM (SELECT o_orderkey, o_orderdate AS ts FROM orders)")
def f04(spark, d):
    return calendar.add(catalog.table(spark, d, "orders").withColumnRenamed("o_orderdate", "ts"), "ts", "D")


_T, _H, _V = "(l_quantity - 10)", "(l_tax * 1000 + 20)", "(l_discount * 100 + 1)"


@query("F05_discomfort_index", "i:l_orderkey,l_linenumber f:di,th", f"SELECT l_orderkey, l_linenumber, 0.81 * {_T} + 0.01 * {_H} * (0.99 * {_T} - 14.3) + 46.3 AS di, {_T} * {_H} AS th FROM lineitem")
def f05(spark, d):
    t, h = F.col("l_quantity") - 10, F.col("l_tax") * 1000 + 20
    return catalog.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", weather.discomfort_index(t, h).alias("di"), (t * h).alias("th"))


@query("F06_wind_chill", "i:l_orderkey,l_linenumber f:chill", f"SELECT l_orderkey, l_linenumber, 13.12 + 0.6215 * {_T} - 11.37 * pow({_V}, 0.16) + 0.3965 * {_T} * pow({_V}, 0.16) AS chill FROM lineitem")
def f06(spark, d):
    return catalog.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", weather.wind_chill(F.col("l_quantity") - 10, F.col("l_discount") * 100 + 1).alias("chill"))


@query("F08_over_multiple", "i:unit_id t:ts f:multiple s:band",
       f"WITH {FACT} SELECT unit_id, ts, CASE WHEN so2 / 35 - 1 > 0 THEN so2 / 35 - 1 END AS multiple, CASE WHEN so2 / 35 - 1 > 0 THEN CASE WHEN so2 / 35 - 1 < 0.3::DOUBLE THEN '2to30' ELSE '30to50' END END AS band FROM fact")
def f08(spark, d):
    m = domain.over_multiple(F.col("so2"), domain.LIMITS["so2"])
    return catalog.readings(spark, d).select("unit_id", "ts", m.alias("multiple"), domain.severity_band(m).alias("band"))


@query("F09_emission_mass", "i:unit_id t:ts f:flow,so2_t,soot_t",
       f"WITH {UNIT}, {FACT} SELECT unit_id, ts, kwh * f AS flow, so2 * (kwh * f) * 0.01::DOUBLE AS so2_t, soot * (kwh * f) * 0.001::DOUBLE AS soot_t FROM (SELECT *, CASE WHEN unit_type = '燃煤机' THEN 12 ELSE 8 END AS f FROM fact JOIN unit USING (unit_id))")
def f09(spark, d):
    rows = business.with_unit(catalog.readings(spark, d), catalog.units(spark, d))
    flow = domain.flue_gas_flow(F.col("kwh"), F.col("unit_type"))
    return rows.select("unit_id", "ts", flow.alias("flow"), domain.emission_mass(F.col("so2"), flow, "so2").alias("so2_t"),
                       domain.emission_mass(F.col("soot"), flow, "soot").alias("soot_t"))


@query("F10_exceedance_rate", "i:unit_id t:ts s:pollutant f:value,rate", f'WITH {FACT}, {LONG} SELECT unit_id, ts, pollutant, value, (value - "limit") / "limit" * 100 AS rate FROM long_ WHERE value > "limit"')
def f10(spark, d):
    return business.exceedances(catalog.readings(spark, d))


_CLAMP = "greatest({lo}, least({hi}, {k0} + {ka} * l_quantity + {kb} * l_extendedprice / 100 + {kc} * l_linenumber))"


@query("F11_linear_score", "i:l_orderkey,l_linenumber f:so2,nox,dust",
       "SELECT l_orderkey, l_linenumber, " + _CLAMP.format(lo="5.0", hi="50.0", k0="20.0", ka="0.1", kb="0.05", kc="-0.03") + " AS so2, "
       + _CLAMP.format(lo="10.0", hi="70.0", k0="40.0", ka="0.15", kb="0.08", kc="-0.05") + " AS nox, "
       + _CLAMP.format(lo="2.0", hi="15.0", k0="8.0", ka="0.05", kb="0.02", kc="-0.01") + " AS dust FROM lineitem")
def f11(spark, d):
    a, b, c = F.col("l_quantity"), F.col("l_extendedprice") / 100, F.col("l_linenumber").cast("double")
    return catalog.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[domain.linear_score(p, a, b, c).alias(p) for p in domain.SCORE])


@query("F12_normalise_whitespace", "i:doc_id s:clean", f"SELECT doc_id, md5({norm('text')}) AS clean FROM documents")
def f12(spark, d):
    return catalog.table(spark, d, "documents").select("doc_id", F.md5(tf.normalise(F.col("text"))).alias("clean"))


@query("F13_template", "i:conv_id,turn s:text", "SELECT conv_id, turn, '指令: ' || role || chr(10) || chr(10) || '回答: ' || text AS text FROM conversations")
def f13(spark, d):
    return catalog.table(spark, d, "conversations").select(
        "conv_id", "turn", tf.fill_template(TRAINING_TEMPLATE, instruction=F.col("role"), response=F.col("text")).alias("text"))


_ANSWER = """CASE conv_id % 3 WHEN 0 THEN 'Answer:' || chr(10) || '```sql' || chr(10) || 'SELECT * FROM t WHERE k = ' || turn || chr(10) || '```' || text
  WHEN 1 THEN 'Try select a from t' || turn || '; done' ELSE 'no statement in turn ' || turn END"""


@query("F14_extract_sql", "i:conv_id,turn s:sql",
       "SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'SELECT * FROM t WHERE k = ' || turn WHEN 1 THEN 'select a from t' || turn || ';' ELSE 'no statement in turn ' || turn END AS sql FROM conversations")
def f14(spark, d):
    answer = F.expr(_ANSWER.replace("chr(10)", "'\\n'"))
    return catalog.table(spark, d, "conversations").select("conv_id", "turn", tf.extract_sql(answer).alias("sql"))


@query("F15_after_marker", "i:conv_id,turn s:tail", f"SELECT conv_id, turn, trim(CASE WHEN strpos(t, '回答: ') > 0 THEN substr(t, strpos(t, '回答: ') + 4) ELSE t END) AS tail FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role || ' 回答: ' || role || '-' || turn ELSE role END AS t FROM conversations)")
def f15(spark, d):
    t = F.when(F.col("turn") % 2 == 0, F.concat("role", F.lit(" 回答: "), "role", F.lit("-"), "turn")).otherwise(F.col("role"))
    return catalog.table(spark, d, "conversations").select("conv_id", "turn", tf.after_marker(t, "回答: ").alias("tail"))


@query("F16_keyword_split", "i:item_id s:keywords", "SELECT item_id, array_to_string(list_transform(string_split(text, ',')[1:3], lambda x: trim(x)), '|') AS keywords FROM benchmark")
def f16(spark, d):
    return catalog.table(spark, d, "benchmark").select("item_id", F.array_join(tf.first_keywords(F.col("text"), 3), "|").alias("keywords"))


_MOOD = "CASE doc_id % 3 WHEN 0 THEN '这是正面的' WHEN 1 THEN '结果：负面' ELSE lang END"


@query("F17_label_normalise", "i:doc_id s:label", f"SELECT doc_id, CASE WHEN contains(m, '正面') THEN '正面' WHEN contains(m, '负面') THEN '负面' ELSE '中性' END AS label FROM (SELECT doc_id, {_MOOD} AS m FROM documents)")
def f17(spark, d):
    return catalog.table(spark, d, "documents").select("doc_id", tf.sentiment_label(F.expr(_MOOD)).alias("label"))


_ASK = """CASE s_suppkey % 6 WHEN 0 THEN 'SO2平均排放' WHEN 1 THEN '#' || s_suppkey || '号机组排放情况' WHEN 2 THEN '近期超标次数'
  WHEN 3 THEN '哪台机组NOx最低' WHEN 4 THEN '过去24小时烟尘趋势' ELSE s_suppkey || '号机组状态' END"""


@query("F18_intent_routing", "i:unit_id s:intent,pollutant i:unit_no",
       """SELECT s_suppkey AS unit_id, CASE s_suppkey % 6 WHEN 0 THEN 'average' WHEN 1 THEN 'unit_emissions' WHEN 2 THEN 'exceedance_count' WHEN 3 THEN 'ranking_lowest' WHEN 4 THEN 'trend' ELSE 'unit_status' END AS intent,
       CASE s_suppkey % 6 WHEN 0 THEN 'so2' WHEN 3 THEN 'nox' WHEN 4 THEN 'dust' END AS pollutant, CASE WHEN s_suppkey % 6 IN (1, 5) THEN s_suppkey END AS unit_no FROM supplier""")
def f18(spark, d):
    routed = tf.intent(F.expr(_ASK))
    return catalog.table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit_id"), *[c.alias(n) for n, c in routed.items()])


@query("F19_formatting", "i:o_orderkey s:price,day", "SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS price, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS day FROM orders")
def f19(spark, d):
    return catalog.table(spark, d, "orders").select("o_orderkey", F.format_number("o_totalprice", 2).alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("day"))


@query("F20_cosine", "i:vec_id f:similarity,blank", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
  SELECT vec_id, list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[]))) AS similarity, 0.0 AS blank FROM embeddings, q""")
def f20(spark, d):
    emb = catalog.table(spark, d, "embeddings")
    first = emb.filter("vec_id = 0").first()["embedding"]
    q = F.array(*[F.lit(float(x)) for x in first])
    zero = F.transform(F.col("embedding"), lambda x: F.lit(0.0))
    return emb.select("vec_id", tf.cosine(F.col("embedding"), q).alias("similarity"), tf.cosine(F.col("embedding"), zero).alias("blank"))


_FRIEND = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in oplogs.FRIENDLY.items())


@query("F21_friendly_message", "i:error_id s:message", f"WITH {_ERR} SELECT error_id, CASE error_type {_FRIEND} ELSE '{oplogs.FRIENDLY_DEFAULT}' END AS message FROM err")
def f21(spark, d):
    return catalog.errors(spark, d).select("error_id", oplogs.friendly_message(F.col("error_type")).alias("message"))


@query("F22_nested_json", "i:event_id,k", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def f22(spark, d):
    return catalog.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# ---- operational logs ----

@query("O01_error_statistics", "s:error_type i:errors t:first_seen,last_seen s:recent",
       f"""WITH {_ERR}, r AS (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY ts DESC, error_id) AS rk FROM err)
       SELECT error_type, count(*) AS errors, min(ts) AS first_seen, max(ts) AS last_seen, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S'), '|' ORDER BY rk) FILTER (WHERE rk <= 10) AS recent FROM r GROUP BY 1""")
def o01(spark, d):
    out = oplogs.error_stats(catalog.errors(spark, d), error_type="error_type", ts="ts", error_id="error_id", last=10)
    return out.withColumn("recent", F.array_join(F.transform("recent", lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")), "|"))


@query("O02_recent_errors", "i:error_id t:ts s:error_type", f"WITH {_ERR} SELECT error_id, ts, error_type FROM err ORDER BY ts DESC, error_id LIMIT 10")
def o02(spark, d):
    return oplogs.recent_errors(catalog.errors(spark, d), ts="ts", error_id="error_id")


@query("O03_find_error", "i:error_id t:ts s:error_type", f"WITH {_ERR} SELECT error_id, ts, error_type FROM err WHERE error_id = (SELECT min(event_id) FROM events WHERE event_type = 'error')")
def o03(spark, d):
    log = catalog.errors(spark, d)
    return oplogs.find_error(log, "error_id", log.agg(F.min("error_id")).first()[0])


@query("O04_request_metrics", "s:endpoint i:requests,errors f:mean_latency,peak_latency,error_rate i:le_0_25,le_2_5",
       f"WITH {_REQ} SELECT endpoint, count(*) AS requests, count(*) FILTER (WHERE failed) AS errors, avg(latency) AS mean_latency, max(latency) AS peak_latency, avg(CASE WHEN failed THEN 1.0 ELSE 0.0 END) AS error_rate, count(*) FILTER (WHERE latency <= 0.25::DOUBLE) AS le_0_25, count(*) FILTER (WHERE latency <= 2.5::DOUBLE) AS le_2_5 FROM req GROUP BY 1")
def o04(spark, d):
    return oplogs.request_stats(catalog.requests(spark, d), by=["endpoint"], failed=F.col("failed"))


@query("O05_error_enrichment", "i:error_id s:message,source",
       f"WITH {_ERR} SELECT error_id, CASE error_type {_FRIEND} ELSE '{oplogs.FRIENDLY_DEFAULT}' END AS message, CASE WHEN user_id % 2 = 0 THEN 'client' ELSE 'server' END AS source FROM err")
def o05(spark, d):
    log = catalog.errors(spark, d).withColumn("info", F.when(F.col("user_id") % 2 == 0, '{"source": "client"}').otherwise(F.col("props")))
    return oplogs.enrich(log, error_type="error_type", info="info")


# ---- key checks ----

@query("D08_duplicate_keys", "i:unit_id t:ts i:rows", "SELECT l_suppkey AS unit_id, l_shipdate AS ts, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def d08(spark, d):
    rows = catalog.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit_id"), F.col("l_shipdate").alias("ts"))
    return quality.duplicate_keys(rows, ["unit_id", "ts"])


@query("D09_orphans", "i:o_orderkey,o_custkey", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)")
def d09(spark, d):
    return quality.orphans(catalog.table(spark, d, "orders"), catalog.table(spark, d, "customer").filter("c_nationkey <> 3"), "o_custkey", "c_custkey")


@query("W12_latest_per_unit", "s:unit t:ts f:value i:event_id", "SELECT event_type AS unit, ts, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def w12(spark, d):
    ev = catalog.table(spark, d, "events").select(F.col("event_type").alias("unit"), "ts", "value", "event_id")
    return windows.latest_per_key(ev, ["unit"], "ts", tie="event_id")
