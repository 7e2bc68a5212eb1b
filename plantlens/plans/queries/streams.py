"""Structured Streaming jobs, run over everything available and read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.plans import catalog
from plantlens.plans.queries.base import query
from plantlens.session import scratch_path
from plantlens.streaming import jobs


def _events(spark, d):
    """The events table as a stream of files."""
    schema = catalog.table(spark, d, "events").schema
    return jobs.read_stream(spark, f"{d}/events*.parquet", schema)


def _collected(spark, stream, name):
    path = scratch_path(spark, name)
    jobs.run_available(stream, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("X01_stream_hourly_mean", "s:unit t:hour f:value i:n",
       "WITH h AS (SELECT event_type AS unit, date_trunc('hour', ts) AS hour, avg(value) AS value, count(*) AS n FROM events GROUP BY 1, 2) SELECT * FROM h WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)")
def x01(spark, d):
    stream = jobs.hourly_mean(_events(spark, d).withColumnRenamed("event_type", "unit"), unit="unit", ts="ts", value="value")
    return _collected(spark, stream, "stream-hourly")


_LIMITS = {"click": 100.0, "view": 150.0, "signup": 200.0, "purchase": 120.0}


@query("X02_stream_alerts", "s:unit t:ts f:value,limit s:severity",
       f"""WITH l AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in _LIMITS.items())}) v(unit, "limit"))
       SELECT unit, ts, value, "limit", CASE WHEN value > "limit" * 1.2::DOUBLE THEN 'danger' ELSE 'warning' END AS severity FROM events JOIN l ON unit = event_type WHERE value > "limit" """)
def x02(spark, d):
    limits = F.broadcast(spark.createDataFrame(list(_LIMITS.items()), "unit string, limit double"))
    stream = jobs.exceedance_alerts(_events(spark, d).withColumnRenamed("event_type", "unit"), limits, unit="unit", ts="ts", value="value")
    return _collected(spark, stream, "stream-alerts")


@query("X03_stream_error_counts", "s:error_type t:start,end i:n",
       """WITH e AS (SELECT ts, 'k' || (json_extract(props, '$.k')::BIGINT % 3) AS error_type FROM events WHERE event_type = 'error'),
       w AS (SELECT error_type, ts, time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE * s AS start FROM e, (SELECT unnest([0, 1, 2]) AS s)),
       c AS (SELECT error_type, start, start + INTERVAL 15 MINUTE AS "end", count(*) AS n FROM w GROUP BY 1, 2)
       SELECT * FROM c WHERE "end" <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM e)""")
def x03(spark, d):
    log = _events(spark, d).filter("event_type = 'error'").select("ts", F.concat(F.lit("k"), F.get_json_object("props", "$.k").cast("long") % 3).alias("error_type"))
    return _collected(spark, jobs.error_counts(log, ts="ts", error_type="error_type"), "stream-errors")
