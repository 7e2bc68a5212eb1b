"""File readers. Every reader is one distributed scan with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.sources.schemas import EMISSION_METRICS

MISSING = "-"
REJECT = "_rejected"


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def _parse_ts(name: str, fmt: str | None):
    c = F.trim(F.col(name))
    return (F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)).cast("timestamp_ntz")


def _number(name: str):
    """The column as a number; '-', text that is no number, and the text NaN are missing."""
    x = F.nullif(F.trim(F.col(name)), F.lit(MISSING)).try_cast("double")
    return F.nanvl(x, F.lit(None).cast("double")).alias(name)


def source_file():
    """Name of the file a row came from: the entity key of directory scans."""
    return F.col("_metadata.file_name")


def read_series_tsv(
    spark: SparkSession, path, metrics: list[str], ts_format: str = "yyyy/MM/dd HH:mm", ts_col: str = "time",
    entity=None,
) -> DataFrame:
    """Tab-separated series, time in the first column. Bad stamps are kept and flagged in ``_rejected``.

    A directory is one scan; ``entity`` (default: the file name) names the series a row belongs to.
    """
    raw = (
        spark.read.schema(_strings([ts_col, *metrics])).option("sep", "\t").option("header", True).csv(path)
        .select("*", (source_file() if entity is None else entity).alias("file"))
    )
    return raw.select(
        "file",
        _parse_ts(ts_col, ts_format).alias("ts"),
        *[_number(m) for m in metrics],
    ).withColumn(REJECT, F.col("ts").isNull())


def read_emissions_csv(
    spark: SparkSession,
    path,
    metrics: tuple[str, ...] = EMISSION_METRICS,
    ts_col: str = "RECTIME",
    ts_format: str = "yyyy/MM/dd HH:mm",
) -> tuple[DataFrame, DataFrame]:
    """CSV with a description row under the header of every file.

    Returns (readings, rejects): rejects count the rows per file whose stamp does not parse; a clean
    file has exactly one, its description row.
    """
    raw = (
        spark.read.schema(_strings([ts_col, *metrics])).option("header", True).csv(path)
        .select("*", source_file().alias("file"))
        .withColumn("_ts", _parse_ts(ts_col, ts_format))
    )
    readings = raw.filter(F.col("_ts").isNotNull()).select(
        "file", F.col("_ts").alias("ts"), *[_number(m) for m in metrics]
    )
    rejects = raw.filter(F.col("_ts").isNull()).groupBy("file").agg(F.count("*").alias("rejected"))
    return readings, rejects


def date_like(names: list[str]) -> list[str]:
    return [n for n in names if "date" in n.lower() or "time" in n.lower()]


def promote(df: DataFrame, columns: list[str], to: str) -> DataFrame:
    """Cast string columns to ``to`` only where every non-null value parses (one pass decides all)."""
    if not columns:
        return df
    parsed = {c: F.expr(f"try_cast(`{c}` AS {to})") for c in columns}
    bad = df.agg(*[F.count_if(parsed[c].isNull() & F.col(c).isNotNull()).alias(c) for c in columns]).first()
    return df.withColumns({c: parsed[c] for c in columns if bad[c] == 0})


def read_processed_csv(spark: SparkSession, path, schema: T.StructType | list[str]) -> DataFrame:
    """Processed table; columns named like dates become timestamps when all their values parse."""
    st = _strings(schema) if isinstance(schema, list) else schema
    df = spark.read.schema(st).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    text = {f.name for f in st.fields if isinstance(f.dataType, T.StringType)}
    return promote(df, [c for c in date_like(df.columns) if c in text], "timestamp_ntz")


def read_texts(spark: SparkSession, path, kind: str, column: str = "text", multiline: bool = True) -> DataFrame:
    """External texts: 'csv', 'json' (array or object), 'jsonl' or 'txt' (one text per line)."""
    if kind == "txt":
        return spark.read.text(path).select(F.col("value").alias(column))
    if kind == "csv":
        return spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').csv(path)
    if kind in ("json", "jsonl"):
        return spark.read.option("multiLine", kind == "json").json(path)
    raise ValueError(f"unsupported text format {kind!r}")


def read_pairs(spark: SparkSession, path, kind: str, required: tuple[str, ...] = ("instruction", "response")) -> DataFrame:
    """Training pairs from csv, json or jsonl; fails when a required column is absent."""
    if kind == "csv":
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    elif kind in ("json", "jsonl"):
        df = spark.read.option("multiLine", kind == "json").json(path)
    else:
        raise ValueError(f"unsupported pair format {kind!r}")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(c).cast("string") for c in required])
