"""Round trips through every reader and sink. Files are written by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantlens.functions import text as tf
from plantlens.plans import catalog
from plantlens.plans.queries.base import AREA, FACT, HOURLY, PLANT, UNIT, norm, query
from plantlens.session import scratch_path
from plantlens.sources import readers, schemas, writers


def _dash(c, test):
    return F.when(test, F.lit("-")).otherwise(c.cast("string"))


def _series_files(spark, d, name, **options):
    """Hourly series of every event type as tab-separated text, one folder per series, '-' for missing."""
    path = scratch_path(spark, name)
    rows = catalog.hourly(spark, d).select(
        "unit", F.date_format("ts", "yyyy/MM/dd HH:mm").alias("time"), _dash(F.col("value"), F.col("n") == 1).alias("value"),
        _dash(F.col("load"), F.col("load") > 90).alias("load"))
    rows.write.partitionBy("unit").option("sep", "\t").option("header", True).csv(path)
    return path


_FOLDER = "unit=([^/]+)"


@query("S01_series_text", "s:unit t:ts f:value,load", f"WITH {HOURLY} SELECT unit, ts, CASE WHEN n > 1 THEN value END AS value, CASE WHEN load <= 90 THEN load END AS load FROM hourly")
def s01(spark, d):
    unit = F.regexp_extract(F.col("_metadata.file_path"), _FOLDER, 1)
    rows = readers.read_series_tsv(spark, _series_files(spark, d, "series"), ["value", "load"], entity=unit)
    return rows.filter(~F.col(readers.REJECT)).withColumnRenamed("file", "unit")


def _with_description(batches):
    """Header line, description line, then the data lines of one file."""
    import pandas as pd

    first = True
    for pdf in batches:
        head = ["RECTIME,SO2,NOx", "数据描述,二氧化硫,氮氧化物"] if first else []
        first = False
        yield pd.DataFrame({"line": head + pdf["line"].tolist()})


@query("S02_emission_csv", "i:n,with_one_reject f2:so2,nox",
       f"WITH {FACT} SELECT count(*) AS n, 1 AS with_one_reject, sum(so2) AS so2, sum(nox) AS nox FROM fact")
def s02(spark, d):
    path = scratch_path(spark, "emission")
    lines = catalog.readings(spark, d).select(F.concat_ws(",", F.date_format("ts", "yyyy/MM/dd HH:mm"), F.col("so2").cast("string"), F.col("nox").cast("string")).alias("line"))
    lines.mapInPandas(_with_description, "line string").write.text(path)
    rows, rejects = readers.read_emissions_csv(spark, path, ("SO2", "NOx"))
    exact = rejects.agg(F.min(F.col("rejected") == 1).cast("int").alias("ok")).first()["ok"]
    return rows.agg(F.count("*").alias("n"), F.sum("SO2").alias("so2"), F.sum("NOx").alias("nox")).withColumn("with_one_reject", F.lit(exact))


@query("S03_processed_csv", "i:o_orderkey t:order_date s:update_time f:price",
       "SELECT o_orderkey, o_orderdate AS order_date, CASE WHEN o_orderkey % 2 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS update_time, o_totalprice AS price FROM orders")
def s03(spark, d):
    path = scratch_path(spark, "processed")
    rows = catalog.table(spark, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("order_date"),
        F.when(F.col("o_orderkey") % 2 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("update_time"), F.col("o_totalprice").alias("price"))
    writers.write_csv(rows, path)
    return readers.read_processed_csv(spark, path, ["o_orderkey", "order_date", "update_time", "price"])


@query("S04_text_formats", "s:kind i:n,chars",
       f"""WITH t AS (SELECT {norm('text')} AS x FROM documents WHERE length({norm('text')}) > 0), s AS (SELECT count(*) AS n, sum(length(x)) AS chars FROM t)
       SELECT unnest(['txt', 'csv', 'jsonl']) AS kind, n, chars FROM s""")
def s04(spark, d):
    texts = catalog.table(spark, d, "documents").select(tf.normalise(F.col("text")).alias("text")).filter(F.length("text") > 0)
    out = None
    for kind in ("txt", "csv", "jsonl"):
        path = scratch_path(spark, f"texts-{kind}")
        {"txt": lambda: texts.write.text(path), "csv": lambda: writers.write_csv(texts, path), "jsonl": lambda: writers.write_json(texts, path)}[kind]()
        part = readers.read_texts(spark, path, kind).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("S05_pair_formats", "s:kind i:n,chars",
       "WITH s AS (SELECT count(*) AS n, sum(length(role) + length(text)) AS chars FROM conversations) SELECT unnest(['csv', 'jsonl']) AS kind, n, chars FROM s")
def s05(spark, d):
    pairs = catalog.table(spark, d, "conversations").select(F.col("role").alias("instruction"), F.col("text").alias("response"))
    out = None
    for kind in ("csv", "jsonl"):
        path = scratch_path(spark, f"pairs-{kind}")
        writers.write_csv(pairs, path) if kind == "csv" else writers.write_json(pairs, path)
        rows = readers.read_pairs(spark, path, kind)
        part = rows.agg(F.count("*").alias("n"), F.sum(F.length("instruction") + F.length("response")).alias("chars")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("S06_directory_batch", "s:unit i:rows,missing_value,missing_load f:mean_value,mean_load",
       f"WITH {HOURLY} SELECT unit, count(*) AS rows, count(*) FILTER (WHERE n = 1) AS missing_value, count(*) FILTER (WHERE load > 90) AS missing_load, avg(value) FILTER (WHERE n > 1) AS mean_value, avg(load) FILTER (WHERE load <= 90) AS mean_load FROM hourly GROUP BY 1")
def s06(spark, d):
    unit = F.regexp_extract(F.col("_metadata.file_path"), _FOLDER, 1)
    rows = readers.read_series_tsv(spark, _series_files(spark, d, "batch"), ["value", "load"], entity=unit)
    return rows.groupBy(F.col("file").alias("unit")).agg(
        F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("missing_value"), F.count_if(F.col("load").isNull()).alias("missing_load"),
        F.avg("value").alias("mean_value"), F.avg("load").alias("mean_load"))


@query("S07_csv_sink", "i:doc_id s:digest", "SELECT doc_id, md5(text) AS digest FROM documents")
def s07(spark, d):
    path = scratch_path(spark, "csv-sink")
    writers.write_csv(catalog.table(spark, d, "documents").select("doc_id", "text"), path)
    return readers.read_texts(spark, path, "csv").select("doc_id", F.md5("text").alias("digest"))


@query("S08_dataset_sink", "s:split i:n f2:value",
       "SELECT CASE WHEN event_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, sum(value) AS value FROM events GROUP BY 1")
def s08(spark, d):
    path = scratch_path(spark, "dataset")
    rows = catalog.table(spark, d, "events").select("event_id", "value", F.when(F.col("event_id") % 5 == 0, "test").otherwise("train").alias("split"))
    writers.write_dataset(rows, path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


@query("S09_json_sink", "i:conv_id,turn s:role,text", "SELECT conv_id, turn, role, text FROM conversations")
def s09(spark, d):
    path = scratch_path(spark, "json-sink")
    writers.write_json(catalog.table(spark, d, "conversations"), path)
    return spark.read.schema("conv_id long, turn long, role string, text string").json(path)


@query("S10_chart_export", "d:day f2:F,O,P",
       """SELECT CAST(o_orderdate AS DATE) AS day, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS "F", max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS "O", max(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def s10(spark, d):
    rows = catalog.table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return writers.chart_table(rows, "day", "o_orderstatus", "o_totalprice", ["F", "O", "P"])


@query("S11_upsert", "i:unit_id t:ts f:so2",
       f"""WITH {FACT} SELECT unit_id, ts, CASE WHEN year(ts) = 1998 THEN so2 + 100 ELSE so2 END AS so2 FROM fact""")
def s11(spark, d):
    facts = catalog.readings(spark, d).select("unit_id", "ts", "so2")
    changed = facts.filter(F.year("ts") == 1998).withColumn("so2", F.col("so2") + 100)
    return writers.upsert(facts, changed, ["unit_id", "ts"])


@query("S12_registered_schema", "s:FAC_NAME,STEAMER_NAME,AREA_NAME f:RATING_FH i:ACTIVE_FLAG",
       f"WITH {UNIT}, {PLANT}, {AREA} SELECT plant_name AS \"FAC_NAME\", unit_name AS \"STEAMER_NAME\", area_name AS \"AREA_NAME\", rating AS \"RATING_FH\", active_flag AS \"ACTIVE_FLAG\" FROM unit JOIN plant USING (plant_id) JOIN area USING (area_code)")
def s12(spark, d):
    area, plant, unit = catalog.areas(spark, d), catalog.plants(spark, d), catalog.units(spark, d)
    schemas.register(spark, {
        "TS_AREA": area,
        "TB_FACTORY": plant.withColumnsRenamed({"plant_id": "FAC_ID", "plant_name": "FAC_NAME"}),
        "TB_STEAMER": unit.withColumnsRenamed({"unit_id": "STEAMER_ID", "unit_name": "STEAMER_NAME", "plant_id": "FAC_ID", "rating": "RATING_FH", "unit_type": "STEAMER_TYPE"}),
    })
    return spark.sql("""SELECT f.FAC_NAME, s.STEAMER_NAME, a.AREA_NAME, s.RATING_FH, s.ACTIVE_FLAG
        FROM TB_STEAMER s JOIN TB_FACTORY f ON s.FAC_ID = f.FAC_ID JOIN TS_AREA a ON f.AREA_CODE = a.AREA_CODE""")
