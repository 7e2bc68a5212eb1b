"""Session helpers. Cluster settings win; these are the defaults for local runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, app: str = "plantlens", partitions: int | None = None) -> SparkSession:
    """A single-machine session for tests, the bench and interactive work."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for hand-over tables, inside the folder the cluster shares for checkpoints.

    A machine-local folder is used only where no shared folder is configured (local mode).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="run-")
    return f"{base.rstrip('/')}/plantlens/{name}-{uuid.uuid4().hex}"


def staged(df, name: str, *partition_by: str):
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives executor loss."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
