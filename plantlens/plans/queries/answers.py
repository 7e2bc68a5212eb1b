"""The business questions and dashboard answers."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plantlens.functions import domain
from plantlens.plans import business, catalog
from plantlens.plans.queries.base import AREA, FACT, LONG, NOW, OVER, PLANT, STAR, STATUS, UNIT, minutes, query

YEAR = 1998
_LIMITED = f"unit_type IN ('燃煤机', '燃气机') AND {OVER}"


def _three(spark, d, since=None, until=None):
    return (catalog.so2_facts(spark, d, since, until).drop("fgd_efficiency", "kwh"),
            catalog.nox_facts(spark, d, since, until).drop("scr_efficiency"), catalog.soot_facts(spark, d, since, until))


def _last(spark, d, **delta):
    return catalog.fact_now(spark, d) - timedelta(**delta)


def _year(spark, d, year=YEAR):
    return catalog.readings(spark, d, *business.month_range(year))


@query("Q01_units_over_limit_now", "s:plant_name,unit_name t:ts f:so2,nox,soot s:status",
       f"WITH {STAR} SELECT plant_name, unit_name, ts, so2, nox, soot, {STATUS} AS status FROM fact JOIN unit USING (unit_id) JOIN plant USING (plant_id), now_ WHERE ts >= t - INTERVAL 1 HOUR AND {_LIMITED} ORDER BY ts DESC")
def q01(spark, d):
    return business.units_over_limit(*_three(spark, d, _last(spark, d, hours=1)), catalog.units(spark, d), catalog.plants(spark, d))


@query("Q02_units_over_limit_24h", "s:plant_name,unit_name t:ts f:so2,nox,soot s:status i:so2_minutes,nox_minutes,soot_minutes",
       f"""WITH {STAR} SELECT plant_name, unit_name, ts, so2, nox, soot, {STATUS} AS status, {minutes('so2', 35)} AS so2_minutes, {minutes('nox', 50)} AS nox_minutes,
       {minutes('soot', 5)} AS soot_minutes FROM fact JOIN unit USING (unit_id) JOIN plant USING (plant_id), now_ WHERE ts >= t - INTERVAL 24 HOUR AND {_LIMITED} ORDER BY ts DESC""")
def q02(spark, d):
    return business.units_over_limit(*_three(spark, d, _last(spark, d, hours=24)), catalog.units(spark, d), catalog.plants(spark, d), minutes=True)


_INTENSITY = f"""mass AS (SELECT unit_id, sum(kwh) AS k, sum(so2 * (kwh * f) * 0.01::DOUBLE) AS a, sum(nox * (kwh * f) * 0.01::DOUBLE) AS b, sum(soot * (kwh * f) * 0.001::DOUBLE) AS c
  FROM (SELECT *, CASE WHEN unit_type = '燃煤机' THEN 12.0 ELSE 8.0 END AS f FROM {{facts}} JOIN unit USING (unit_id)) GROUP BY 1),
  per AS (SELECT unit_id, k AS kwh, CASE WHEN k > 0 THEN a / k ELSE 0 END AS so2_per_kwh, CASE WHEN k > 0 THEN b / k ELSE 0 END AS nox_per_kwh, CASE WHEN k > 0 THEN c / k ELSE 0 END AS soot_per_kwh FROM mass)"""


@query("Q03_lowest_intensity", "s:plant_name,unit_name f:so2_per_kwh,nox_per_kwh,soot_per_kwh",
       f"""WITH {STAR}, recent AS (SELECT fact.* FROM fact, now_ WHERE ts >= t - INTERVAL 24 HOUR), {_INTENSITY.format(facts='recent')}
       SELECT plant_name, unit_name, so2_per_kwh, nox_per_kwh, soot_per_kwh FROM per JOIN unit USING (unit_id) JOIN plant USING (plant_id) WHERE kwh > 0
       ORDER BY round(so2_per_kwh + nox_per_kwh + soot_per_kwh, 9), unit_id LIMIT 3""")
def q03(spark, d):
    return business.lowest_intensity(catalog.readings(spark, d, _last(spark, d, hours=24)), catalog.units(spark, d), catalog.plants(spark, d))


@query("Q04_monthly_trend_of_coal", "i:month f:so2,nox,soot",
       f"WITH {STAR} SELECT month(ts) AS month, avg(so2) AS so2, avg(nox) AS nox, avg(soot) AS soot FROM fact JOIN unit USING (unit_id) JOIN plant USING (plant_id) JOIN area USING (area_code) WHERE parent_code = 'R1' AND unit_type = '燃煤机' AND year(ts) = {YEAR} GROUP BY 1 ORDER BY 1")
def q04(spark, d):
    units = business.units_of_area(catalog.units(spark, d), catalog.plants(spark, d), catalog.areas(spark, d), parent="R1")
    return business.monthly_trend(_year(spark, d), units.filter(F.col("unit_type") == domain.COAL))


@query("Q05_month_summary", "i:plants,coal_units,gas_units,wind_units f:avg_so2,plain_so2,avg_fgd,avg_nox,plain_nox,avg_scr,avg_soot,avg_rating",
       f"""WITH {STAR}, u AS (SELECT unit.* FROM unit JOIN plant USING (plant_id) JOIN area USING (area_code) WHERE parent_code = 'R1'), w AS (SELECT * FROM fact WHERE year(ts) = {YEAR} AND month(ts) = 12),
       p AS (SELECT sum(so2) / count(*) AS plain_so2, sum(nox) / count(*) AS plain_nox FROM w JOIN u USING (unit_id))
       SELECT count(DISTINCT u.plant_id) AS plants, count(DISTINCT CASE WHEN unit_type = '燃煤机' THEN u.unit_id END) AS coal_units, count(DISTINCT CASE WHEN unit_type = '燃气机' THEN u.unit_id END) AS gas_units,
       count(DISTINCT CASE WHEN unit_type = '风电' THEN u.unit_id END) AS wind_units, avg(a.so2) AS avg_so2, any_value(plain_so2) AS plain_so2, avg(a.fgd_efficiency) AS avg_fgd, avg(b.nox) AS avg_nox, any_value(plain_nox) AS plain_nox,
       avg(b.scr_efficiency) AS avg_scr, avg(c.soot) AS avg_soot, avg(u.rating) AS avg_rating
       FROM u LEFT JOIN w a ON a.unit_id = u.unit_id LEFT JOIN w b ON b.unit_id = u.unit_id LEFT JOIN w c ON c.unit_id = u.unit_id, p""")
def q05(spark, d):
    span = business.month_range(YEAR, 12)
    units = business.units_of_area(catalog.units(spark, d), catalog.plants(spark, d), catalog.areas(spark, d), parent="R1")
    return business.month_summary(catalog.so2_facts(spark, d, *span), catalog.nox_facts(spark, d, *span), catalog.soot_facts(spark, d, *span), units)


@query("Q06_daily_load_by_type", "d:day f:coal,gas,wind,solar",
       f"""WITH {STAR}, t AS (SELECT CAST(ts AS DATE) AS day, unit_type, avg(rating) AS v FROM fact JOIN unit USING (unit_id) JOIN plant USING (plant_id) JOIN area USING (area_code)
       WHERE area_name = 'NATION_4' AND year(ts) = {YEAR} AND month(ts) = 11 GROUP BY 1, 2)
       SELECT day, max(CASE WHEN unit_type = '燃煤机' THEN v ELSE 0 END) AS coal, max(CASE WHEN unit_type = '燃气机' THEN v ELSE 0 END) AS gas, max(CASE WHEN unit_type = '风电' THEN v ELSE 0 END) AS wind,
       max(CASE WHEN unit_type = '光电' THEN v ELSE 0 END) AS solar FROM t GROUP BY 1 ORDER BY 1""")
def q06(spark, d):
    units = business.units_of_area(catalog.units(spark, d), catalog.plants(spark, d), catalog.areas(spark, d), area="NATION_4")
    types = {domain.COAL: "coal", domain.GAS: "gas", domain.WIND: "wind", domain.SOLAR: "solar"}
    return business.daily_load_by_type(catalog.readings(spark, d, *business.month_range(YEAR, 11)), units, types)


@query("Q07_plants_of_area", "i:plant_id s:plant_name", f"WITH {PLANT}, {AREA} SELECT plant_id, plant_name FROM plant JOIN area USING (area_code) WHERE parent_code = 'R2'")
def q07(spark, d):
    return catalog.plants(spark, d).join(catalog.areas(spark, d).filter("parent_code = 'R2'"), "area_code")


@query("Q08_active_units", "s:plant_name,unit_name,unit_type", f"WITH {UNIT}, {PLANT} SELECT plant_name, unit_name, unit_type FROM unit JOIN plant USING (plant_id) WHERE active_flag = 1")
def q08(spark, d):
    return catalog.units(spark, d).filter("active_flag = 1").join(catalog.plants(spark, d), "plant_id")


@query("Q09_average_with_limit_line", "s:pollutant t:bucket f:average,limit i:n",
       f"""WITH {FACT}, {LONG}, {NOW} SELECT pollutant, date_trunc('hour', ts) AS bucket, avg(value) AS average, "limit", count(*) AS n FROM long_, now_ WHERE ts >= t - INTERVAL 24 HOUR GROUP BY 1, 2, 4""")
def q09(spark, d):
    return business.hourly_average(catalog.readings(spark, d, _last(spark, d, hours=24)))


@query("Q10_unit_table", "i:unit_id s:pollutant f:current,average,maximum,limit s:status",
       f"""WITH {FACT}, {LONG}, t AS (SELECT unit_id, pollutant, "limit", arg_max(value, ts) AS current, avg(value) AS average, max(value) AS maximum FROM long_ GROUP BY 1, 2, 3)
       SELECT *, CASE WHEN current > "limit" THEN 'danger' WHEN current > "limit" * 0.8::DOUBLE THEN 'warning' ELSE 'normal' END AS status FROM t""")
def q10(spark, d):
    return business.unit_table(catalog.readings(spark, d))


@query("Q11_state_share", "i:unit_id s:state i:n f:share",
       f"""WITH {UNIT}, {FACT}, s AS (SELECT unit_id, CASE WHEN kwh <= 0 THEN 'stopped' WHEN active_flag = 0 THEN 'maintenance' WHEN kwh / 60000 < 0.5 THEN 'low_load' ELSE 'normal' END AS state FROM fact JOIN unit USING (unit_id))
       SELECT unit_id, state, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY unit_id) AS share FROM s GROUP BY 1, 2""")
def q11(spark, d):
    return business.state_share(catalog.readings(spark, d), catalog.units(spark, d), full_load=60000.0)


@query("Q12_exceedance_counts_30d", "s:pollutant i:n f:worst_rate",
       f"""WITH {FACT}, {LONG}, {NOW} SELECT pollutant, count(*) AS n, max((value - "limit") / "limit" * 100) AS worst_rate FROM long_, now_ WHERE value > "limit" AND ts >= t - INTERVAL 30 DAY GROUP BY 1""")
def q12(spark, d):
    return business.exceedance_counts(catalog.readings(spark, d, _last(spark, d, days=30)))


@query("Q12_exceedance_detail_30d", "i:unit_id t:ts s:pollutant f:value,limit,rate",
       f"""WITH {FACT}, {LONG}, {NOW} SELECT unit_id, ts, pollutant, value, "limit", (value - "limit") / "limit" * 100 AS rate FROM long_, now_ WHERE value > "limit" AND ts >= t - INTERVAL 30 DAY""")
def q12_detail(spark, d):
    return business.exceedances(catalog.readings(spark, d, _last(spark, d, days=30)))


def _rank(order: str) -> str:
    return f"WITH {FACT}, a AS (SELECT unit_id, avg(so2) AS so2, avg(nox) AS nox, avg(soot) AS soot FROM fact GROUP BY 1) SELECT *, round((so2 + nox + soot) / 3, 9) AS score FROM a ORDER BY score {order}, unit_id LIMIT 5"


@query("Q13_lowest_units", "i:unit_id f:so2,nox,soot,score", _rank("ASC"))
def q13(spark, d):
    return business.rank_units(catalog.readings(spark, d), 5)


@query("Q13_highest_units", "i:unit_id f:so2,nox,soot,score", _rank("DESC"))
def q13_highest(spark, d):
    return business.rank_units(catalog.readings(spark, d), 5, lowest=False)


@query("Q14_seven_day_trend", "d:day f:so2,nox,soot", f"WITH {FACT}, {NOW} SELECT CAST(ts AS DATE) AS day, avg(so2) AS so2, avg(nox) AS nox, avg(soot) AS soot FROM fact, now_ WHERE ts >= t - INTERVAL 7 DAY GROUP BY 1")
def q14(spark, d):
    return business.daily_trend(catalog.readings(spark, d, _last(spark, d, days=7)))


def _grade(v: str, limit: int) -> str:
    return f"CASE WHEN {v} > 1.2::DOUBLE * {limit} THEN 2 WHEN {v} > {limit} THEN 1 ELSE 0 END"


def _word(code: str) -> str:
    return f"CASE {code} WHEN 2 THEN 'danger' WHEN 1 THEN 'warning' ELSE 'normal' END"


@query("Q15_status_board", "i:unit_id t:ts f:so2,nox,soot s:so2_status,nox_status,soot_status,status",
       f"""WITH {FACT}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY ts DESC) AS r FROM fact) WHERE r = 1)
       SELECT unit_id, ts, so2, nox, soot, {_word(_grade('so2', 35))} AS so2_status, {_word(_grade('nox', 50))} AS nox_status, {_word(_grade('soot', 5))} AS soot_status,
       {_word(f"greatest({_grade('so2', 35)}, {_grade('nox', 50)}, {_grade('soot', 5)})")} AS status FROM l""")
def q15(spark, d):
    return business.status_board(catalog.readings(spark, d))


@query("Q16_paged_listing", "i:unit_id t:ts f:nox i:page,total,total_pages b:has_next,has_prev",
       f"""WITH {FACT}, f AS (SELECT unit_id, ts, nox FROM fact WHERE unit_id = 11 AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1999-01-01'), c AS (SELECT count(*) AS total FROM f)
       SELECT unit_id, ts, nox, 2 AS page, total, CAST(ceil(total / 10.0) AS BIGINT) AS total_pages, 2 < ceil(total / 10.0) AS has_next, true AS has_prev FROM f, c ORDER BY ts, unit_id LIMIT 10 OFFSET 10""")
def q16(spark, d):
    return business.list_emissions(catalog.readings(spark, d), page=2, unit=11, pollutant="nox", start=datetime(1996, 1, 1), end=datetime(1998, 12, 31))


@query("Q17_quarterly_comparison", "i:year,quarter f:so2,nox,soot,so2_change,nox_change,soot_change",
       f"""WITH {STAR}, q AS (SELECT year(ts) AS year, quarter(ts) AS quarter, avg(so2) AS so2, avg(nox) AS nox, avg(soot) AS soot FROM fact JOIN unit USING (unit_id) JOIN plant USING (plant_id) JOIN area USING (area_code) WHERE area_name = 'NATION_2' GROUP BY 1, 2)
       SELECT *, so2 - lag(so2) OVER w AS so2_change, nox - lag(nox) OVER w AS nox_change, soot - lag(soot) OVER w AS soot_change FROM q WINDOW w AS (ORDER BY year, quarter)""")
def q17(spark, d):
    units = business.units_of_area(catalog.units(spark, d), catalog.plants(spark, d), catalog.areas(spark, d), area="NATION_2")
    return business.quarter_comparison(catalog.readings(spark, d).join(units.select("unit_id"), "unit_id"))


def _generation(by: str, where: str = "true") -> str:
    return f"""WITH {STAR}, g AS (SELECT unit_id, sum(kwh) AS kwh, count(*) AS n FROM fact WHERE {where} GROUP BY 1)
       SELECT {by}, sum(kwh) AS kwh, sum(kwh) / sum(n) AS avg_kwh, count(*) AS units, rank() OVER (ORDER BY round(sum(kwh), 2) DESC) AS rank FROM g JOIN unit USING (unit_id) JOIN plant USING (plant_id) JOIN area USING (area_code) GROUP BY 1"""


@query("Q18_generation_rank_by_area", "s:area_name f2:kwh,avg_kwh i:units,rank", _generation("area_name", f"year(ts) = {YEAR}"))
def q18(spark, d):
    units = business.units_of_area(catalog.units(spark, d), catalog.plants(spark, d), catalog.areas(spark, d))
    return business.generation_by(_year(spark, d), units, "area_name")


@query("Q19_city_so2_half_year", "i:month f:so2",
       f"WITH {STAR} SELECT month(ts) AS month, avg(so2) AS so2 FROM fact JOIN unit USING (unit_id) JOIN plant USING (plant_id) JOIN area USING (area_code) WHERE area_name = 'NATION_7' AND year(ts) = {YEAR} AND month(ts) <= 6 GROUP BY 1 ORDER BY 1")
def q19(spark, d):
    units = business.units_of_area(catalog.units(spark, d), catalog.plants(spark, d), catalog.areas(spark, d), area="NATION_7")
    return business.monthly_trend(catalog.readings(spark, d, datetime(YEAR, 1, 1), datetime(YEAR, 7, 1)), units).select("month", "so2")


@query("Q20_desulphurisation_efficiency", "i:year,month f:average,minimum,maximum",
       f"WITH {UNIT}, {FACT} SELECT year(ts) AS year, month(ts) AS month, avg(fgd_efficiency) AS average, min(fgd_efficiency) AS minimum, max(fgd_efficiency) AS maximum FROM fact JOIN unit USING (unit_id) WHERE plant_id = 5 GROUP BY 1, 2")
def q20(spark, d):
    return business.efficiency_by_month(catalog.so2_facts(spark, d), catalog.units(spark, d).filter("plant_id = 5"))


@query("Q21_generation_by_type", "s:unit_type f2:kwh,avg_kwh i:units,rank", _generation("unit_type"))
def q21(spark, d):
    return business.generation_by(catalog.readings(spark, d), catalog.units(spark, d), "unit_type")


@query("Q22_inside_flagged_periods", "b:inside i:n f:so2,nox,soot",
       f"""WITH {FACT}, flag AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000)
       SELECT CAST(ts AS DATE) IN (SELECT day FROM flag) AS inside, count(*) AS n, avg(so2) AS so2, avg(nox) AS nox, avg(soot) AS soot FROM fact GROUP BY 1""")
def q22(spark, d):
    days = catalog.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' AND o_totalprice > 450000").select(F.col("o_orderdate").alias("day"))
    return business.inside_periods(catalog.readings(spark, d), days)


@query("Q23_intensity_by_unit", "i:unit_id f2:kwh f:so2_per_kwh,nox_per_kwh,soot_per_kwh", f"WITH {UNIT}, {FACT}, {_INTENSITY.format(facts='fact')} SELECT * FROM per")
def q23(spark, d):
    return business.emission_intensity(catalog.readings(spark, d), catalog.units(spark, d))


@query("Q24_coal_against_gas", "f:so2_left,so2_right,so2_difference,nox_left,nox_right,nox_difference,soot_left,soot_right,soot_difference",
       f"WITH {UNIT}, {FACT}, t AS (SELECT * FROM fact JOIN unit USING (unit_id)) SELECT " + ", ".join(
           f"avg({m}) FILTER (WHERE unit_type = '燃煤机') AS {m}_left, avg({m}) FILTER (WHERE unit_type = '燃气机') AS {m}_right, avg({m}) FILTER (WHERE unit_type = '燃煤机') - avg({m}) FILTER (WHERE unit_type = '燃气机') AS {m}_difference"
           for m in business.MEASURES) + " FROM t")
def q24(spark, d):
    return business.type_comparison(catalog.readings(spark, d), catalog.units(spark, d))


@query("Q25_capacity_month_on_month", "i:year,month f2:total,change f4:change_pct",
       """WITH m AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
       SELECT *, total - lag(total) OVER w AS change, (total - lag(total) OVER w) / lag(total) OVER w * 100 AS change_pct FROM m WINDOW w AS (ORDER BY year, month)""")
def q25(spark, d):
    return business.month_on_month(catalog.table(spark, d, "orders"), "o_orderdate", "o_totalprice")


@query("Q26_quarterly_load", "i:year,quarter f2:kwh,avg_kwh,peak_kwh", f"WITH {FACT} SELECT year(ts) AS year, quarter(ts) AS quarter, sum(kwh) AS kwh, avg(kwh) AS avg_kwh, max(kwh) AS peak_kwh FROM fact GROUP BY 1, 2")
def q26(spark, d):
    return business.quarterly_load(catalog.readings(spark, d))


@query("Q27_renewable_share", "f2:renewable_kwh,kwh f:share",
       f"WITH {UNIT}, {FACT}, t AS (SELECT sum(CASE WHEN unit_type IN ('风电', '光电') THEN kwh ELSE 0 END) AS renewable_kwh, sum(kwh) AS kwh FROM fact JOIN unit USING (unit_id)) SELECT *, renewable_kwh / kwh AS share FROM t")
def q27(spark, d):
    return business.renewable_share(catalog.readings(spark, d), catalog.units(spark, d))


@query("Q28_before_after_policy", "f:so2_before,so2_after,so2_difference,nox_before,nox_after,nox_difference,soot_before,soot_after,soot_difference",
       f"WITH {FACT} SELECT " + ", ".join(
           f"avg({m}) FILTER (WHERE ts < TIMESTAMP '1998-06-01') AS {m}_before, avg({m}) FILTER (WHERE ts >= TIMESTAMP '1998-06-01') AS {m}_after, avg({m}) FILTER (WHERE ts >= TIMESTAMP '1998-06-01') - avg({m}) FILTER (WHERE ts < TIMESTAMP '1998-06-01') AS {m}_difference"
           for m in business.MEASURES) + " FROM fact")
def q28(spark, d):
    return business.before_after(catalog.readings(spark, d), datetime(1998, 6, 1))


@query("Q29_exceedances_past_week", "s:pollutant d:day i:n",
       f"""WITH {FACT}, {LONG}, {NOW} SELECT pollutant, CAST(ts AS DATE) AS day, count(*) AS n FROM long_, now_ WHERE value > "limit" AND ts >= t - INTERVAL 7 DAY GROUP BY 1, 2""")
def q29(spark, d):
    rows = catalog.readings(spark, d, _last(spark, d, days=7)).withColumn("day", F.to_date("ts"))
    return business.unpivot(rows, ["unit_id", "day"]).filter(F.col("value") > F.col("limit")).groupBy("pollutant", "day").agg(F.count("*").alias("n"))
