"""Sinks and keyed merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_csv_per_key(df: DataFrame, path: str, key: str, mode: str = "errorifexists") -> None:
    """One output folder per key value, as the directory batch writes one output per input."""
    df.write.mode(mode).partitionBy(key).option("header", True).option("escape", '"').csv(path)


def write_dataset(df: DataFrame, path: str, split: str = "split", mode: str = "errorifexists") -> None:
    """Model-ready rows as Parquet with one folder per split."""
    df.write.mode(mode).partitionBy(split).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_facts(df: DataFrame, path: str, ts: str, mode: str = "errorifexists") -> None:
    """Fact table partitioned by year and month, so that date ranges prune folders."""
    (
        df.withColumns({"year": F.year(ts), "month": F.month(ts)})
        .write.mode(mode).partitionBy("year", "month").parquet(path)
    )


def chart_table(df: DataFrame, label: str, series: str, value: str, names: list[str]) -> DataFrame:
    """labels x datasets as one wide table: a row per label, a column per dataset."""
    return df.groupBy(label).pivot(series, names).agg(F.max(value))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT OR REPLACE: the incoming row wins on equal keys.

    Expressed as one aggregation, so rows of a key combine before the shuffle and a hot key cannot
    overload a task.
    """
    cols = [c for c in current.columns if c not in keys]
    both = current.withColumn("_seq", F.lit(0)).unionByName(incoming.withColumn("_seq", F.lit(1)))
    picked = both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("_seq")).alias("_row"))
    return picked.select(*[F.col(k) if k in keys else F.col(f"_row.{k}").alias(k) for k in current.columns])


def latest_by_sequence(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last writer wins over a load sequence number."""
    cols = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("_row"))
    return picked.select(*[F.col(k) if k in keys else F.col(f"_row.{k}").alias(k) for k in df.columns])
