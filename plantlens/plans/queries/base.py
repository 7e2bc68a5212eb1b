"""Registration of queries and the SQL fragments they share.

A query declares its output columns once, as ``kind:name,name kind:name``; both sides are shaped by it:
f doubles rounded to 6 digits (f2, f4: to 2, 4), i integers, b booleans as 0 or 1, s strings,
t timestamps and d dates as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _fields(spec: str) -> list[tuple[str, str]]:
    return [(kind, name) for part in spec.split() for kind, names in [part.split(":")] for name in names.split(",")]


def _digits(kind: str) -> int:
    return int(kind[1:] or 6)


def _nudge(digits: int) -> str:
    """A fixed offset far below the last digit: exact decimal ties then round alike in both engines."""
    return f"3.14159e-{digits + 2:02d}"


def _spark(kind: str, name: str) -> Column:
    c = F.col(name)
    if kind[0] == "f":
        out = F.round(c.cast("double") + F.lit(float(_nudge(_digits(kind)))), _digits(kind))
    elif kind == "i":
        out = c.cast("long")
    elif kind == "b":
        out = c.cast("int").cast("long")
    elif kind == "t":
        out = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif kind == "d":
        out = F.date_format(c, "yyyy-MM-dd")
    else:
        out = c.cast("string")
    return out.alias(name)


def _sql(kind: str, name: str) -> str:
    q = f'"{name}"'
    if kind[0] == "f":
        return f"round(CAST({q} AS DOUBLE) + {_nudge(_digits(kind))}::DOUBLE, {_digits(kind)}) + 0.0 AS {q}"
    if kind in "ib":
        return f"CAST({q} AS BIGINT) AS {q}"
    if kind == "t":
        return f"strftime({q}, '%Y-%m-%d %H:%M:%S') AS {q}"
    if kind == "d":
        return f"strftime({q}, '%Y-%m-%d') AS {q}"
    return f"CAST({q} AS VARCHAR) AS {q}"


def query(name: str, spec: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under ``name`` with its shaped SQL."""
    fields = _fields(spec)

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[_spark(k, n) for k, n in fields])

        shaped.__name__, shaped.__doc__ = fn.__name__, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = shaped
        if sql is not None:
            ORACLES[name] = f"SELECT {', '.join(_sql(k, n) for k, n in fields)} FROM ({sql}) AS q"
        return shaped

    return register


UNIT = """unit AS (SELECT s_suppkey AS unit_id, s_name AS unit_name, s_nationkey::BIGINT AS plant_id, s_acctbal AS rating,
  CASE s_suppkey % 4 WHEN 0 THEN '燃煤机' WHEN 1 THEN '燃气机' WHEN 2 THEN '风电' ELSE '光电' END AS unit_type,
  CASE WHEN s_suppkey % 10 <> 9 THEN 1 ELSE 0 END AS active_flag FROM supplier)"""
PLANT = """plant AS (SELECT n_nationkey::BIGINT AS plant_id, 'Plant ' || n_name AS plant_name, 'N' || n_nationkey AS area_code FROM nation)"""
AREA = """area AS (SELECT 'R' || r_regionkey AS area_code, r_name AS area_name, CAST(NULL AS VARCHAR) AS parent_code FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'R' || n_regionkey FROM nation)"""
FACT = """fact AS (SELECT l_suppkey AS unit_id, l_shipdate AS ts, avg(l_quantity) AS so2, avg(round(l_discount * 1000)) AS nox,
  avg(round(l_tax * 100)) AS soot, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / 100 AS kwh,
  100 - avg(round(l_discount * 100)) AS fgd_efficiency, 100 - avg(round(l_tax * 100)) AS scr_efficiency, count(*) AS n
  FROM lineitem GROUP BY 1, 2)"""
NOW = "now_ AS (SELECT max(l_shipdate) AS t FROM lineitem)"
STAR = ", ".join((UNIT, PLANT, AREA, FACT, NOW))
LONG = """long_ AS (SELECT unit_id, ts, 'so2' AS pollutant, so2 AS value, 35.0::DOUBLE AS "limit" FROM fact
  UNION ALL SELECT unit_id, ts, 'nox', nox, 50.0 FROM fact UNION ALL SELECT unit_id, ts, 'soot', soot, 5.0 FROM fact)"""
HOURLY = """hourly AS (SELECT event_type AS unit, date_trunc('hour', ts) AS ts, avg(round(value * 100)) / 100 AS value,
  avg(json_extract(props, '$.k')::BIGINT) AS load, count(*) AS n FROM events GROUP BY 1, 2)"""
ROWS = "rows_ AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY unit) AS size FROM hourly)"
GRID = """span_ AS (SELECT unit, min(ts) AS a, max(ts) AS b FROM hourly GROUP BY unit),
  stamps AS (SELECT unit, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM span_),
  grid AS (SELECT s.unit, s.ts, h.value, h.load, h.n FROM stamps s LEFT JOIN hourly h ON h.unit = s.unit AND h.ts = s.ts)"""
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def norm(text: str) -> str:
    return f"trim(regexp_replace(coalesce({text}, ''), '{WS}', ' ', 'g'))"


OVER = "(so2 > 35 OR nox > 50 OR soot > 5)"
STATUS = f"CASE WHEN unit_type IN ('燃煤机', '燃气机') THEN CASE WHEN {OVER} THEN '超标' ELSE '正常' END ELSE '未知' END"


def minutes(value: str, limit: float) -> str:
    m = f"({value} / {limit} - 1)"
    return f"CASE WHEN {m} > 0 AND {m} < 0.3::DOUBLE THEN n * 10 ELSE 0 END + CASE WHEN {m} >= 0.3::DOUBLE THEN n * 5 ELSE 0 END"
