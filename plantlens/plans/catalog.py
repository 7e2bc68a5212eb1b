"""Domain roles over the generic star tables: areas, plants, units, hourly facts, series, logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.functions import domain

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A text table for work that is heavy per row.

    A table of fewer files than there are cores is spread over all of them; a large one is left as the
    scan splits it.
    """
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as provinces and nations as their child areas."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = r.select(F.concat(F.lit("R"), "r_regionkey").alias("area_code"), F.col("r_name").alias("area_name"),
                   F.lit(None).cast("string").alias("parent_code"))
    child = n.select(F.concat(F.lit("N"), "n_nationkey").alias("area_code"), F.col("n_name").alias("area_name"),
                     F.concat(F.lit("R"), "n_regionkey").alias("parent_code"))
    return top.unionByName(child)


def plants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("plant_id"), F.concat(F.lit("Plant "), "n_name").alias("plant_name"),
        F.concat(F.lit("N"), "n_nationkey").alias("area_code"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("s_suppkey") % 4
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("unit_id"), F.col("s_name").alias("unit_name"), F.col("s_nationkey").cast("long").alias("plant_id"),
        F.col("s_acctbal").alias("rating"),
        F.when(kind == 0, domain.COAL).when(kind == 1, domain.GAS).when(kind == 2, domain.WIND).otherwise(domain.SOLAR).alias("unit_type"),
        (F.col("s_suppkey") % 10 != 9).cast("int").alias("active_flag"))


def _measures() -> dict[str, Column]:
    """Fact columns; whole-number sums keep averages independent of row order."""
    def whole(name: str, scale: int) -> Column:
        return F.avg(F.round(F.col(name) * scale))

    return {
        "so2": F.avg("l_quantity"), "nox": whole("l_discount", 1000), "soot": whole("l_tax", 100),
        "kwh": F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100.0,
        "fgd_efficiency": 100 - whole("l_discount", 100), "scr_efficiency": 100 - whole("l_tax", 100),
    }


def _raw_facts(spark: SparkSession, sf_dir: str, since: datetime | None, until: datetime | None) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    if since is not None:
        li = li.filter(F.col("l_shipdate") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        li = li.filter(F.col("l_shipdate") < F.lit(until).cast("timestamp_ntz"))
    return li.withColumnsRenamed({"l_suppkey": "unit_id", "l_shipdate": "ts"})


def _facts(spark, sf_dir, since, until, pollutant: str, *others: str) -> DataFrame:
    m = _measures()
    over = domain.over_multiple(m[pollutant], domain.LIMITS[pollutant])
    return _raw_facts(spark, sf_dir, since, until).groupBy("unit_id", "ts").agg(
        *[m[c].alias(c) for c in (pollutant, *others)],
        F.when(over < 0.3, F.count("*") * 10).otherwise(0).alias("time_2to30"),
        F.when(over >= 0.3, F.count("*") * 5).otherwise(0).alias("time_30to50"),
    )


def so2_facts(spark, sf_dir, since=None, until=None) -> DataFrame:
    return _facts(spark, sf_dir, since, until, "so2", "fgd_efficiency", "kwh")


def nox_facts(spark, sf_dir, since=None, until=None) -> DataFrame:
    return _facts(spark, sf_dir, since, until, "nox", "scr_efficiency")


def soot_facts(spark, sf_dir, since=None, until=None) -> DataFrame:
    return _facts(spark, sf_dir, since, until, "soot")


def readings(spark, sf_dir, since=None, until=None) -> DataFrame:
    """All pollutants and generation per unit and stamp from one aggregation."""
    m = _measures()
    return _raw_facts(spark, sf_dir, since, until).groupBy("unit_id", "ts").agg(*[m[c].alias(c) for c in ("so2", "nox", "soot", "kwh")])


def latest(df: DataFrame, ts: str) -> datetime:
    """Newest stamp of a table: the default 'now' of relative windows, read from one column."""
    return df.agg(F.max(ts).alias("t")).first()["t"]


def fact_now(spark: SparkSession, sf_dir: str) -> datetime:
    return latest(table(spark, sf_dir, "lineitem"), "l_shipdate")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event type and hour that has readings: value (mean), load (mean of the k property), n."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return ev.groupBy(F.col("event_type").alias("unit"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        (F.avg(F.round(F.col("value") * 100)) / 100).alias("value"), F.avg(k).alias("load"), F.count("*").alias("n"))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error log: type by the k property, record text in props."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    k = F.get_json_object("props", "$.k").cast("long")
    names = ["ValidationAPIError", "DatabaseAPIError", "RateLimitAPIError", "UnknownError"]
    kind = F.element_at(F.array(*[F.lit(x) for x in names]), (k % 4 + 1).cast("int"))
    return ev.select(F.col("event_id").alias("error_id"), "ts", kind.alias("error_type"), "props", "value", "user_id")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log: event type as endpoint, method by the k property, latency in seconds."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return ev.select(
        "event_id", "ts", F.when(k % 3 == 0, "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/"), "event_type").alias("endpoint"), (F.round(F.col("value") * 100) / 10000).alias("latency"),
        (k % 10 == 0).alias("failed"))
